"""What an operator moves and holds: findings of round 3."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from strandflow.operators import annotation, decode, evaluate, intervals, transcripts
from strandflow.plans import annotate, predict
from strandflow.queries import LOOSE, QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merging_deals_more_rows_to_more_tasks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k % 3, s, s + rng.randrange(9)) for k in range(400) for s in [rng.randrange(5000)]]
    df = spark.createDataFrame(rows, "seq long, start long, end long")
    few = [sorted(map(tuple, f(df, ["seq"]).collect())) for f in (intervals.merge_touching, intervals.merge_adjacent)]
    monkeypatch.setattr(intervals, "TASK_ROWS", 10)
    many = [f(df, ["seq"]) for f in (intervals.merge_touching, intervals.merge_adjacent)]
    assert all("hashpartitioning(seq#" in plan(x) and ", 40)" in plan(x) for x in many)
    assert [sorted(map(tuple, x.collect())) for x in many] == few
    once = intervals.merge_adjacent(df.unionAll(df), ["seq"], distinct=True)
    assert plan(once).count("hashpartitioning") == 1
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, intervals.merge_adjacent(df.distinct(), ["seq"]).collect()))


def test_chains_of_a_gene_move_once(spark):
    cds = spark.createDataFrame([(1, 1, "c", "+", 1, 9), (1, 2, "c", "+", 1, 9), (2, 3, "c", "+", 1, 9)], "gene long, tx long, chrom string, strand string, start long, end long")
    keys = evaluate.orf_keys(cds)
    assert plan(keys).count("hashpartitioning") == 1
    assert sorted(map(tuple, keys.collect())) == [(1, "c:+:1:9", 1), (2, "c:+:1:9", 3)]
    # genes of two types, a chain that only one side has, and one rank too many
    more = cds.unionByName(cds.where("gene = 2").select(F.lit(7).cast("long").alias("gene"), "tx", "chrom", "strand", "start", F.lit(8).cast("long").alias("end")))
    named = evaluate.orf_keys(more.withColumn("gene", F.concat(F.lit("g"), F.col("gene").cast("string"))).where("gene <> 'g2'"))
    assert [(r.pred_gene, r.ref_gene) for r in evaluate.match_genes(named, keys).collect()] == [(1, "g1")]


def test_features_stay_where_they_are_when_clipped(spark):
    features = spark.createDataFrame([("a", "t", "CDS", 1, 9)], "seq_name string, tx string, type string, start long, end long").repartition(3)
    lengths = spark.createDataFrame([("a", 5)], "seq_name string, length long").groupBy("seq_name").agg(F.max("length").alias("length"))
    out = transcripts.clip_features(features, lengths)
    assert "hashpartitioning(seq_name" not in plan(out)
    assert [(r.tx, r.start, r.end) for r in out.collect()] == [("t", 1, 5)]


def test_rows_with_nulls_are_lifted_by_bins_too(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "p", 70_000, 70_010, None), (2, "p", 65_000, 66_000, "x"), (2, "p", 65_000, 66_000, "x"), (3, "p", 9, 99_999, "x"), (4, "q", 1, 2, None)], "id long, seq string, start long, end long, note string")
    segs = spark.createDataFrame([("p", "s1", 60_001, 69_000), ("p", "s2", 69_101, 80_000)], "packed_name string, original_name string, packed_start long, packed_end long")
    both = []
    for most in (100_000, 0):
        monkeypatch.setattr(annotation, "BROADCAST_SEGMENTS", most)
        both.append([sorted(map(tuple, f(rows, segs).collect()), key=repr) for f in (annotation.lift_over, annotation.touched_sources)])
    assert both[0] == both[1]
    assert (1, "p", 70_000, 70_010, None, "s2", 900, 910, True) in both[1][0]


def test_merges_equal_their_sql_without_ties(spark):
    """The queries' SQL numbers its islands by a second window of the same order, which leaves the order of equal intervals
    open; here equal intervals are one row, so that it has one result."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet' UNION ALL SELECT * FROM '{DATA}/lineitem.parquet'")
    merged = {}
    for name, keys, gap, source in (
        ("interval_merge", "seq, strand", 1, "loose"), ("stop_merge", "seq, strand", 1, "loose"),
        ("interval_expand_merge", "seq", 0, '(SELECT seq, greatest(0, "start" - 10) AS "start", least(100000, "end" + 10) AS "end", id FROM loose)'),
    ):
        merged[name] = con.sql(f"""WITH {LOOSE}, u AS (SELECT {keys}, "start", "end", count(*) AS n, count(*) FILTER (id % 4 <> 0) AS coding FROM {source} GROUP BY ALL),
m AS (SELECT *, max("end") OVER w AS reach FROM u WINDOW w AS (PARTITION BY {keys} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY "start", "end") AS island FROM m)
SELECT {keys}, min("start"), max("end"){dict(interval_merge=", CAST(sum(n) AS BIGINT)", stop_merge=", sum(coding) > 0").get(name, "")} FROM i GROUP BY {keys}, island""").fetchall()
    class Twice:  # the tables with every row twice, so that every interval has its equal
        read = property(lambda self: self)

        def parquet(self, path):
            df = spark.read.parquet(path)
            return df.unionAll(df)

    for name, want in merged.items():
        assert sorted(map(tuple, QUERIES[name](Twice(), DATA).collect())) == sorted(want), name


def test_models_are_rendered_without_merging_exons_again(spark):
    rng = random.Random(8)
    kinds = ("CDS", "five_prime_UTR", "3UTR", "exon", "start_codon")
    rows = [(t // 2, t, f"c{t // 2 % 2}", "+-"[t // 2 % 2], rng.choice(kinds), s, s + rng.randrange(25)) for t in range(12) for s in (rng.randrange(300) for _ in range(14))]
    rows.append((99, 99, "c0", "+", "exon", 5, 9))  # a transcript without pieces
    features = spark.createDataFrame(rows, "gene long, tx long, chrom string, strand string, feature string, start long, end long")
    out = annotation.render_models(features)
    assert plan(out).count("hashpartitioning(tx") <= 4  # the exons' rows, the coding rows, and the names that each of them meets
    lines = [r.line.split("\t") for r in out.collect()]
    want = sorted((r.start, r.end) for r in annotation.infer_exons(features, ["tx"]).collect())
    assert sorted((int(x[3]), int(x[4])) for x in lines if x[2] == "exon") == want
    counts = [int(p.removeprefix("Num_exons=")) for x in lines for p in x[8].split(";") if p.startswith("Num_exons=")]
    assert sum(counts) == len(want) and len(counts) == 12
    for x in (y for y in lines if y[2] == "exon"):  # exons of a transcript are numbered by position
        parent, number = x[8].split("ID=")[1].split(";")[0].rsplit(".exon", 1)
        same = sorted(int(y[3]) for y in lines if y[2] == "exon" and f"ID={parent}.exon" in y[8])
        assert same[int(number) - 1] == int(x[3])


def test_models_stitch_their_runs_once(spark):
    """Stitching and splitting were worked out again for each of the places that read their result."""
    runs = spark.createDataFrame([("a", "+", 1, "CDS", 1, 9, 7, 14, 1, 1, True)], annotate.RUNS).localCheckpoint()
    assert plan(annotate.models_from_runs(runs)).count("ExistingRDD") <= 3  # 12 before


def test_windows_are_named_where_they_are_or_moved(spark, monkeypatch):
    rng = random.Random(12)
    seqs = spark.createDataFrame([(f"s{i}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(150, 400)))) for i in range(12)], "seq_name string, seq string")
    both = []
    for most in (predict.BROADCAST_NAMED, 0):
        monkeypatch.setattr(predict, "BROADCAST_NAMED", most)
        runs, audit = predict.predicted_runs(seqs, 50)
        both.append([sorted(map(tuple, x.collect()), key=repr) for x in (runs, audit)])
    assert both[0] == both[1] and both[0][0]


def test_rows_with_absent_steps_alone_are_decoded_twice():
    rng = np.random.default_rng(13)
    steps, first = decode.log_or_absent(decode.transitions()), np.full(20, -np.log(20), np.float32)
    calls = []
    for spread in (1.0, 60.0, 400.0):
        scores = rng.normal(0, spread, (40, 30, 20)).astype(np.float32)
        scores[:3] = rng.normal(0, 400, (3, 30, 20))
        column = lambda t: (calls.append(t), scores[:, t].T)[1]  # noqa: B023, E731
        both = [decode.best_paths(column, (40, 30), steps, first, scores.dtype, lazy=lazy).tolist() for lazy in (True, False)]
        assert both[0] == both[1]
    assert len(calls) > 6 * 30  # some were
    assert [list(map(len, decode.side_by_side([7] * 1075, 1024)))] == [[538, 537]]  # not 1024 and 51
