from strandflow.operators import annotation, evaluate, intervals, planning, stitch, windows

PIECES = "tx string, strand string, start long, end long"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_merging_over_bins(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("a", 11, 12), ("a", 95, 300), ("a", 110, 120), ("a", 301, 302), ("b", 1, 1)], "seq string, start long, end long")
    for size in (10, 100, 1 << 20):
        assert rows(intervals.merge_touching(df, ["seq"], bin_size=size), "seq", "start", "end", "n") == [("a", 1, 9, 2), ("a", 11, 12, 1), ("a", 95, 302, 3), ("b", 1, 1, 1)]
    near = df.where("seq = 'a' AND start < 20").withColumn("start", intervals.F.when(intervals.F.col("start") == 11, 8).otherwise(intervals.F.col("start")))
    assert rows(intervals.merge_adjacent(near, ["seq"]), "start", "end") == [(1, 9), (8, 12)]


def test_runs_clip_introns(spark):
    path = spark.createDataFrame([(1, p, k) for p, k in zip([101, 102, 103, 104, 106], "aabba")], "u int, pos long, k string")
    for size in (2, 1 << 20):
        assert rows(intervals.runs(path, ["u"], "k", bin_size=size), "k", "start", "end") == [("a", 101, 102), ("a", 106, 106), ("b", 103, 104)]
    clip = spark.createDataFrame([(-5, 10, 100), (90, 120, 100), (150, 160, 100), (150, 160, None)], "start long, end long, n long")
    assert rows(intervals.clip(clip, "n"), "start", "end") == [(1, 10), (90, 100), (150, 160)]
    exons = spark.createDataFrame([("t", 1, 10), ("t", 21, 30), ("t", 31, 40)], "tx string, start long, end long")
    assert rows(intervals.introns(exons, ["tx"]), "start", "end") == [(11, 20)]


def test_phase_and_codons(spark):
    plus = spark.createDataFrame([("t", "+", 1, 4), ("t", "+", 11, 15), ("u", "-", 1, 5), ("u", "-", 11, 14)], PIECES)
    phased = intervals.cds_phase(plus, ["tx"])
    assert rows(phased, "tx", "start", "phase") == [("t", 1, 0), ("t", 11, 2), ("u", 1, 2), ("u", 11, 0)]
    codons = intervals.terminal_codon_rows(phased, ["tx"])
    assert rows(codons, "tx", "feature", "start", "end") == [("t", "start_codon", 1, 3), ("t", "stop_codon", 13, 15), ("u", "start_codon", 12, 14), ("u", "stop_codon", 1, 3)]
    pieces = spark.createDataFrame([("t", "+", 1, 9, 0, True), ("t", "+", 10, 12, None, False), ("t", "+", 20, 22, None, False)], PIECES + ", phase int, is_cds boolean")
    assert rows(intervals.merge_stop_codons(pieces, ["tx"]), "start", "end", "phase")[0] == (1, 12, 0)


def test_lift_over_and_groups(spark):
    segments = spark.createDataFrame([("p", "a", 1, 100), ("p", "b", 151, 250)], "packed_name string, original_name string, packed_start long, packed_end long")
    df = spark.createDataFrame([(1, "p", 160, 170, "x"), (2, "p", 90, 160, "x"), (3, "p", 120, 130, "y"), (4, "q", 5, 6, "z"), (5, "p", 1, 2, "w")], "id long, seq string, start long, end long, tx string")
    for most in (100_000, 0):
        annotation.BROADCAST_SEGMENTS = most
        got = {r.id: (r.source, r.source_start, r.mapped) for r in annotation.lift_over(df, segments).collect()}
        assert got == {1: ("b", 10, True), 2: (None, None, False), 3: (None, None, False), 4: ("q", 5, True), 5: ("a", 1, True)}
        assert rows(annotation.touched_sources(df.where("id < 4"), segments), "id", "source") == [(1, "b"), (2, "a"), (2, "b")]
        assert {r.tx: r.source for r in annotation.lift_groups(df, segments, "tx").collect()} == {"x": None, "y": None, "z": "q", "w": "a"}
        assert rows(annotation.recheck_sources(df, segments, "tx"), "source") == [("a",), ("b",)]
    annotation.BROADCAST_SEGMENTS = 100_000


def test_global_numbers(spark):
    df = spark.range(1000).withColumn("k", annotation.F.xxhash64("id"))
    got = annotation.global_numbers(df, ["k"], "n", 7).collect()
    assert [r.n for r in sorted(got, key=lambda r: r.k)] == list(range(1, 1001))
    assert annotation.global_numbers(df.limit(0), ["k"], "n").collect() == []


def test_stitching(spark):
    w = spark.createDataFrame([("s", "+", 1, 4, 0, 18), ("s", "+", 5, 8, 18, 19), ("s", "+", 9, 12, 5, 0), ("s", "+", 20, 23, 0, 0), ("t", "-", 1, 4, 0, 19), ("t", "-", 5, 8, 18, 0)],
        "seq string, strand string, start long, end long, first_state int, last_state int")
    assert [(r.seq, r.start, r.status, r.block) for r in sorted(stitch.seams(w).collect(), key=lambda r: (r.seq, r.start))] == [
        ("s", 1, None, 0), ("s", 5, "joined", 0), ("s", 9, "invalid_transition", 1), ("s", 20, "coordinate_gap", 2), ("t", 1, None, 0), ("t", 5, "joined", 0)]
    ranges = [("s", "+", 1, "5UTR", 1, 2), ("s", "+", 1, "intron", 3, 4), ("s", "+", 5, "intron", 5, 6), ("s", "+", 5, "3UTR", 7, 8), ("s", "+", 9, "CDS", 9, 12), ("s", "+", 20, "CDS", 20, 23)]
    frame = spark.createDataFrame(ranges, "seq string, strand string, win_start long, kind string, start long, end long")
    got = rows(stitch.stitch(w.where("seq = 's'"), frame), "block_start", "kind", "start", "end")
    assert got == [(1, "5UTR", 1, 2), (1, "intron", 3, 4), (5, "3UTR", 7, 8), (5, "intron", 5, 6), (9, "CDS", 9, 12), (20, "CDS", 20, 23)]


def test_utr_markers_and_paths(spark):
    r = spark.createDataFrame([("a", "5UTR", 1, 1), ("a", "UTR_EI", 2, 2), ("a", "intron", 3, 3), ("a", "UTR_IE", 4, 4), ("a", "5UTR", 5, 5), ("b", "UTR_EI", 1, 1)], "k string, kind string, start long, end long")
    assert rows(stitch.resolve_utr(r, ["k"]), "k", "kind", "start", "end") == [("a", "5UTR", 1, 2), ("a", "5UTR", 4, 5), ("a", "intron", 3, 3), ("b", "UTR_EI", 1, 1)]
    p = spark.createDataFrame([("a", "+", i, s) for i, s in enumerate([7, 5, 6, 4, 5, 14])] + [("b", "-", i, s) for i, s in enumerate([14, 5, 7])] + [("c", "+", i, s) for i, s in enumerate([7, 5, 6])], "k string, strand string, pos long, state int")
    assert rows(stitch.complete_paths(p, ["k"]), "k", "complete") == [("a", True), ("b", True), ("c", False)]


def test_plans(spark):
    df = spark.createDataFrame(list(enumerate([("x", 40), ("y", 50), ("z", 200), ("w", 30)])), "ord long, v struct<name:string,length:long>").select("ord", "v.*")
    got = planning.pack(df, 100, 10, 100).collect()
    assert [(r.packed_name, r.original_name, r.packed_start, r.packed_end) for r in got] == [("packed_scaffold_000001", "x", 1, 40), ("packed_scaffold_000001", "y", 51, 100), ("z", "z", 1, 200), ("packed_scaffold_000002", "w", 1, 30)]
    shards = spark.createDataFrame([(i, f"s{i}", n) for i, n in enumerate([10, 20, 30, 40, 50])], "ord long, name string, length long")
    assert rows(planning.shard_balance(shards, 4), "length", "shard") == [(10, 0), (20, 1), (30, 2), (40, 3), (50, 0)]
    assert rows(windows.balanced_slices(shards, ["ord"], 3, 1), "ord", "task") == [(i, i) for i in range(5)]
    assert rows(windows.balanced_slices(shards, ["ord"], 3, 2), "ord", "task") == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)]


def test_windows(spark):
    seqs = spark.createDataFrame([("a", "ACGT" * 62 + "AC"), ("e", "")], "seq_name string, seq string")
    got = {(r.seq_name, r.win_idx): r for r in windows.sequence_windows(seqs, 100, 20).collect()}
    assert [(got["a", i].core_start, got["a", i].core_end) for i in range(3)] == [(1, 100), (101, 200), (201, 250)]
    assert all(len(r.bases) == 140 for r in got.values()) and got["a", 0].bases.startswith("N" * 20 + "A") and got["a", 2].bases.endswith("C" + "N" * 70)
    assert (got["e", 0].core_start, got["e", 0].core_end, got["e", 0].bases) == (1, 0, "N" * 140)
    assert windows.sequence_windows(seqs, 100, 20, pad=False).count() == 2
    values = spark.createDataFrame([(1, i, 1.0 if i < 199 else 0.0) for i in range(200)], "u int, pos long, v double")
    assert windows.has_signal(values, ["u"], "v").first().keep


def test_matching_is_one_to_one(spark):
    ref = spark.createDataFrame([("r1", "A", "t"), ("r1", "B", "t"), ("r2", "A", "t")], "gene string, orf string, first_tx string")
    pred = spark.createDataFrame([("p1", "A", "t1"), ("p2", "B", "t1"), ("p3", "A", "t1"), ("p4", "C", "t1")], "gene string, orf string, first_tx string")
    m = evaluate.match_genes(ref, pred)
    assert rows(m, "pred_gene", "ref_gene") == [("p1", "r1"), ("p3", "r2")]
    assert rows(evaluate.unmatched(pred, m, "pred_gene"), "gene") == [("p2",), ("p4",)]
    one = evaluate.precision_recall(ref, pred, m).first()
    assert (one.matched, one.precision, one.recall) == (2, 0.5, 1.0)


def test_global_numbers_lose_no_rows_when_partitions_are_coalesced(spark):
    from pyspark.sql import functions as F

    from strandflow.operators import annotation

    rows = spark.range(60_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 512).alias("a"), F.sha2(F.col("id").cast("string"), 512).alias("b"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:
        for size in ("64k", "256k", "64m"):
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
            spark.conf.set("spark.sql.shuffle.partitions", "40")
            out = annotation.global_numbers(rows, ["a"], "n")
            assert out.agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max("n")).first()[:] == (60_000, 60_000, 1, 60_000)
            first = {r.n: r.a for r in out.where("n < 200").select("n", "a").collect()}
            assert [first[k] for k in sorted(first)] == sorted(first.values())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
