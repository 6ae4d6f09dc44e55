import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from strandflow.llm import simhash
from strandflow.llm.components import components


def slow_fingerprint(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    n = max(1, len(words) - width + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(fps, bits=3):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(fps, 2):
        if bin(fps[a] ^ fps[b]).count("1") <= bits:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def texts():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)] + ["Größe", "ÀÉ"]
    base = " ".join(rng.choice(words) for _ in range(700))
    rows = [None, "", " \t\n", "One", "one", "ONE two", "a b c", base, base.upper(), base + " x", "y " + base]
    rows += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    for _ in range(60):
        copy = base.split()
        copy[rng.randrange(700)] = rng.choice(words)
        rows.append(" ".join(copy))
    rows.append(" ".join(["the"] * 5000))
    return rows + rows[:20]


@pytest.mark.parametrize("split_above", [1024, 3])
def test_groups_match_brute_force(spark, split_above):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "doc_id long, text string, fp int, key string")
    got = simhash.simhash_groups(docs, split_above=split_above).collect()
    fps = {i: slow_fingerprint(t) for i, t in rows}
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == slow_components(fps)


def test_long_lists_are_dealt_again(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, dtype=np.int64)
    fps = {int(base)}
    while len(fps) < 400:
        x = int(base)
        for b in rng.choice(63, rng.integers(1, 9), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = {i: x for i, x in enumerate(sorted(fps))}
    groups = spark.createDataFrame([(x, i) for i, x in fps.items()], "fp long, rep long")
    for split_above in (20, 5000):
        roots = {r.node: r.root for r in components(simhash.near_links(groups, 3, split_above)).collect()}
        assert {i: roots.get(i, i) for i in fps} == slow_components(fps)


def test_partition_walk_in_small_chunks():
    rng = np.random.default_rng(5)
    import pyarrow as pa

    keys = np.sort(rng.integers(0, 6, 500)) + (7 << 40)
    reps, fps = np.arange(500), rng.integers(0, 1 << 60, 500)
    run = simhash._lists(3, 5, 10, chunk=16)
    batches = [
        pa.RecordBatch.from_arrays([pa.array(x[i : i + 7]) for x in (keys, reps, fps)], ["key", "rep", "fp"])
        for i in range(0, 500, 7)
    ]
    out = [b.to_pylist() for b in run(batches)]
    again = [r for b in out for r in b if r["key"]]
    assert sorted({r["a"] for r in again}) == list(range(500)) and len(again) == 2000


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101 + i) for i in range(30)] + [(300, 299), (299, 400), (7, 7), (5, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 51)} | {101 + i: 100 for i in range(30)} | {300: 299, 400: 299}
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(docs).collect() == []
    assert simhash.drop_near_copies(docs).collect() == []


def test_drop_near_copies_keeps_one_of_each_group(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, extra string")
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    want = slow_components({i: slow_fingerprint(t, 5) for i, t in rows})
    assert kept == {i for i, c in want.items() if i == c}
