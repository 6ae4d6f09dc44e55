import math

import pytest
from pyspark.sql import functions as F

from strandflow.functions import attributes as at
from strandflow.functions import numeric as nu
from strandflow.functions import sequence as sq


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (sq.reverse_complement, "AACGNt", "aNCGTT"),
        (sq.category, "acGTn-", "012344"),
        (sq.soft_masked, "aCgN", "1010"),
        (sq.translate, "ATGTAAN", "M*"),
        (sq.translate, "ATNTGG", "XW"),
        (sq.translate, "AT", ""),
        (at.escape, " *~:+,=;%._-é/", "%20%2A~:+%2C%3D%3B%25._-%C3%A9%2F"),
        (lambda c: at.unescape(at.escape(c)), "a+b c%", "a+b c%"),
    ],
)
def test_scalars(spark, f, text, want):
    assert one(spark, f(F.col("s")), s=text) == want


def test_strict_coding(spark):
    body = "ATG" + "GCT" * 19
    cases = {body + "TAA": True, "ATG" + "GCT" * 18 + "TAA": False, "ATG" + "GCT" * 9 + "TAG" + "GCT" * 9 + "TAA": False, body + "GCT": False, body + "GTAA": False, "": False}
    rows = spark.createDataFrame(list(cases.items()) + [(None, False)], "s string, want boolean")
    assert all(r.want == r.got for r in rows.withColumn("got", sq.is_complete_coding(F.col("s"))).collect())


def test_attribute_tokens(spark):
    rows = spark.createDataFrame([('gene_id "g1"; flag; ID=x y; gene_id "g2";',), (".",), (None,)], "s string")
    got = rows.select(at.tokens(F.col("s")).alias("t"), at.last_of(at.tokens(F.col("s")), "gene_id").alias("last"), at.values_of(at.tokens(F.col("s")), "gene_id").alias("all")).collect()
    assert [tuple(t) for t in got[0].t] == [("gene_id", "g1", " ", True), ("flag", "", "", False), ("ID", "x y", "=", False), ("gene_id", "g2", " ", True)]
    assert got[0].last == "g2" and got[0].all == ["g1", "g2"] and got[1].t == got[2].t == [] and got[1].last is None


def test_gff3_attributes(spark):
    assert one(spark, at.gff3_attributes(ID=F.col("a"), Note=F.col("b"), X=F.col("c")), a="alpha beta", b="", c="1;2") == "ID=alpha%20beta;X=1%3B2"
    assert one(spark, at.gff3_list("Parent", F.array(F.col("a"), F.col("b"))), a="g1", b="g2") == "Parent=g1,g2"


def test_numbers(spark):
    assert one(spark, nu.safe_log(F.col("p")), p=0.0) == -1000
    assert math.isclose(one(spark, nu.safe_log(F.col("p")), p=1e-300), math.log(1.17549435e-38), rel_tol=1e-6)
    assert one(spark, nu.adaptive_core(F.col("n"), 640_000, 1), n=1000) == 1024
    assert one(spark, nu.compact_length(F.col("n"), 40_000, 16, 105_600), n=10_000) == 90_112
    p = spark.createDataFrame([([[0.2, 0.8], [0.5, 0.5]],), ([[2.0, 0.0], [1.0, 1.0]],)], "p array<array<double>>")
    got = [r.q for r in p.select(nu.as_probabilities(F.col("p")).alias("q")).collect()]
    assert got[0] == [[0.2, 0.8], [0.5, 0.5]] and math.isclose(got[1][0][0], math.exp(2) / (math.exp(2) + 1)) and got[1][1] == [0.5, 0.5]
    assert one(spark, nu.first_argmax(F.array(*map(F.lit, [1, 3, 3]))), n=0) == 1


def test_flanks(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4, 5],)], "a array<int>")
    assert rows.select(sq.trim_flanks(F.col("a"), 2).alias("x")).first().x == [3]
    with pytest.raises(Exception, match="flanks"):
        rows.select(sq.trim_flanks(F.col("a"), 3)).collect()
