import pytest

from strandflow.operators import transcripts as tr

PIECES = "seq_name string, tx string, strand string, start long, end long"


def test_splicing_over_windows(spark):
    seq = "ACGTTGCAAC" * 5
    rows = [("s", "p", "+", 8, 23), ("s", "p", "+", 2, 3), ("s", "p", "+", 2, 3), ("s", "m", "-", 8, 23), ("s", "m", "-", 2, 3), ("s", "late", "+", 45, 60), ("s", "early", "+", -3, 2), ("s", "far", "+", -9, -2), ("t", "lost", "+", 1, 5), ("s", "void", "+", 9, 4)]
    pieces = spark.createDataFrame(rows, PIECES)
    found = {r.tx: r for r in tr.spliced_cds(pieces, spark.createDataFrame([("s", seq), ("e", ""), ("n", None)], "seq_name string, seq string"), width=7).collect()}
    want = seq[1:3] + seq[7:23]
    assert (found["p"].cds, found["p"].n_pieces, found["p"].n_bases, found["p"].complete) == (want, 2, 18, True)
    assert (found["m"].cds, found["m"].complete) == (want[::-1].translate(str.maketrans("ACGT", "TGCA")), True)
    assert {k: (r.cds, r.complete) for k, r in found.items() if k not in "pm"} == {"late": (seq[44:], False), "early": (seq[:2], False), "far": ("", False), "lost": ("", False)}


def test_filter_modes(spark):
    good = "ATG" + "GCC" * 20 + "TAA"
    sequences = spark.createDataFrame([("s", good + good.replace("GCC", "TGA", 1))], "seq_name string, seq string")
    pieces = spark.createDataFrame([("s", "a", "+", 1, 30), ("s", "a", "+", 31, 66), ("s", "b", "+", 67, 132), ("s", "c", "+", 100, 140), ("x", "d", "+", 1, 66)], PIECES)
    names = lambda df: sorted(r.tx for r in df.collect())
    assert names(tr.strict_transcripts(pieces, sequences)) == ["a"]
    assert names(tr.strict_transcripts(pieces, sequences, "none")) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError, match="unknown filter mode"):
        tr.strict_transcripts(pieces, sequences, "loose")
    assert names(tr.least_coding(pieces, 66)) == ["a", "b", "d"]
    assert names(tr.strict_transcripts(pieces.where("false"), sequences)) == []


def test_clipping_drops_emptied_transcripts(spark):
    rows = [("s", "a", "exon", 90, 120), ("s", "b", "exon", 101, 120), ("s", "b", "intron", 50, 60), ("t", "c", "CDS", 500, 600), ("s", "d", "gene", 1, 2)]
    features = spark.createDataFrame(rows, "seq_name string, tx string, type string, start long, end long")
    out = tr.clip_features(features, spark.createDataFrame([("s", 100)], "seq_name string, length long"))
    assert sorted((r.tx, r.type, r.start, r.end) for r in out.collect()) == [("a", "exon", 90, 100), ("c", "CDS", 500, 600)]
