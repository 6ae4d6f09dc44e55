import random
from itertools import combinations

import numpy as np

from strandflow.llm import minhash as mh

from .test_similar_text import shingles


def slow(rows, percent=85):
    """The result by brute force; row numbers in the order of ids stand for the rows."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    sets, root = [shingles(t) for _, t in rows], {i: i for i in order}
    place = {i: k for k, i in enumerate(order)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(order, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)), key=place.get)
            root[y] = x
    return sorted(((rows[i][0], len(sets[i]), rows[find(i)][0], find(i) == i) for i in order), key=repr)


def families():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(1500)]
    out = [None, "", " \n\x0b", "one", "One", "ONE two", "two one", "a b c d e f", "a b c d e f g", "A b\tc d e f"]
    for n in (24, 90, 400, 1500):
        base = [rng.choice(words) for _ in range(n)]
        out += [" ".join(base)] * 3
        for share in (0.004, 0.01, 0.02, 0.03, 0.2):
            out += [" ".join(rng.choice(words) if rng.random() < share else w for w in base) for _ in range(8)]
        out += [" ".join(base[: n * k // 100]) for k in (95, 88, 86, 85, 84, 80)] + [" ".join(base + base[: n // 9])]
    shared = " ".join(rng.choice(words) for _ in range(60))
    out += [shared + " " + " ".join(rng.choice(words) for _ in range(rng.randint(4, 90))) for _ in range(60)]
    out += ["la " * 5000, "la " * 9000, ("x y z " * 9000)]
    rng.shuffle(out)
    return out


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_components_match_brute_force(spark):
    rows = list(enumerate(families()))
    docs = spark.createDataFrame([(i, t, 1, "r", True) for i, t in rows], "doc_id long, text string, n int, rep string, kept boolean")
    want = slow(rows)
    assert result(mh.minhash_groups(docs.repartition(7))) == want
    assert sum(not r[3] for r in want) > 100
    # blocks far smaller than the lists change nothing
    assert result(mh.minhash_groups(docs, block=3)) == want


def test_rows_without_an_id_or_with_the_same(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "other words"), (None, "A b c d e f"), (None, "lonely one"), (7, None), (7, ""), (2, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(mh.minhash_groups(docs)) == slow(rows)
    assert mh.minhash_groups(docs.limit(0)).collect() == []


def test_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 4000, np.uint64)
    sets, wide = [], pool[:2000]
    for shared in (2000, 1838, 1600, 1000, 0):
        sets.append(np.unique(np.concatenate((wide[:shared], pool[2000 : 4000 - shared]))))
    low = mh.packed(mh.minima(sets))
    assert low.shape == (5, 8)
    for s, row in zip(sets[1:], low[1:], strict=True):
        true = len(np.intersect1d(s, sets[0])) / len(np.union1d(s, sets[0]))
        assert abs(float(mh.estimate(mh.agreeing(low[0], row))) - true) < 0.14
    assert mh.agreeing(low[0], low[0]) == mh.MINIMA
    assert 0.6 < mh.least_estimate(0.85) < 0.75
    assert mh.least_estimate(1.0) == 1.0


def test_the_bit_count_is_exact():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 16, (2, 50, mh.MINIMA))
    pack = lambda x: mh.np.bitwise_or.reduce(x.astype(np.uint64).reshape(50, -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)
    assert (mh.agreeing(pack(a), pack(b)) == (a == b).sum(axis=1)).all()
