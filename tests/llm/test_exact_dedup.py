import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from strandflow.llm import exact_dedup as xd


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = rng.choice(1 << 60, n, replace=False).astype(np.uint64) if n else np.empty(0, np.uint64)
        parts = xd.build_filter(keys)
        assert xd.in_filter(keys, *parts).all()
        others = rng.integers(1 << 61, 1 << 62, 20_000).astype(np.uint64)
        assert xd.in_filter(others, *parts).mean() < 0.01
        assert len(parts[2]) <= 1.3 * n + 1000


def brute(rows):
    norm = {}
    out = []
    for i, t in rows:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for i, t in rows:
        body = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        ids = norm[body]
        out.append((i, min(ids), len(ids), i == min(ids), hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out)


def cases():
    long = "x y " * 50_000
    texts = [None, "", " ", "\n", "a b", "a  b", "a\t\n b", "a b", "ä", "Ä", long, long + " ", "c"] * 3
    return list(enumerate(texts + ["hot text"] * 300)) + [(5, "a  b"), (5, "other")]


def test_dedup_matches_brute_force(spark):
    rows = cases()
    docs = spark.createDataFrame([(i, t, b"q", 1) for i, t in rows], "doc_id long, text string, digest binary, old int")
    for old in (F.col("doc_id") % 3 == 0, F.lit(False), F.lit(True), F.lit(None).cast("boolean"), xd.half(F.col("doc_id"))):
        got = xd.dedup_batch(docs, old).withColumn("h", F.lower(F.hex("digest"))).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.h) for r in got) == brute(rows)


def test_only_screened_digests_reach_the_join(spark):
    rows = [(i, f"t{i % 60}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = xd.batch_groups(docs.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), 4)
    old = groups.where("rep < 30")
    passed = {r.rep for r in xd.screen(groups, xd.snapshot_filters(old)).collect()}
    assert set(range(30)) <= passed and len(passed) < 35


def test_byte_check_rejects_other_texts(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    digest = hashlib.sha256(b"a").digest()
    pairs = spark.createDataFrame([(digest, 1, 1)], "digest binary, rep long, kept_rep long")
    assert xd.same_bytes(docs, pairs).count() == 1


def test_empty_and_drop(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert xd.dedup_batch(empty, F.lit(True)).collect() == []
    assert xd.drop_copies(empty).collect() == []
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for i, t in rows:
        first[norm(t)] = min(first.get(norm(t), (i is None, i or 0)), (i is None, i or 0))
    got = [(r.doc_id is None, r.doc_id or 0, norm(r.text)) for r in xd.drop_copies(docs).collect()]
    assert sorted(got) == sorted((*k, t) for t, k in first.items())


def test_rows_go_and_not_ids(spark):
    docs = spark.createDataFrame([(0, "a b", 1), (1, "a  b", 2), (1, "only here", 3), (1, "only here", 4), (None, "a b", 5), (None, "x", 6), (None, "x", 7)], "doc_id long, text string, n int")
    got = xd.drop_copies(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == [(False, 0, "a b"), (False, 1, "only here"), (True, 0, "x")]
