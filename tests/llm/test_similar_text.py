import random
from itertools import combinations

import numpy as np

from strandflow.llm import similar_text as st


def shingles(text, width=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def slow_roots(texts, similarity=0.8):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        union = len(sets[a] | sets[b])
        if not union or len(sets[a] & sets[b]) >= similarity * union:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    base = [[rng.choice(words) for _ in range(n)] for n in (60, 200, 900)]
    out = [None, "", " \n", "one", "One", "one two", "two one"]
    for b in base:
        out.append(" ".join(b))
        for share in (0.005, 0.01, 0.015, 0.06, 0.3):
            for _ in range(6):
                out.append(" ".join(rng.choice(words) if rng.random() < share else w for w in b))
        out += [" ".join(b).upper(), " ".join(b) + " tail", " ".join(b[: len(b) * 9 // 10]), " ".join(reversed(b))]
    return out + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(60)] + ["the " * 20_000, "the " * 30_000]


def test_groups_match_brute_force(spark):
    rows = dict(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows.items()], "doc_id long, text string, f1 long, rep long")
    want = {i: r for i, r in slow_roots(rows).items() if i != r}
    got = {r.node: r.root for r in st.similar_roots(docs).collect()}
    assert not set(got) - set(want)  # nothing goes that has no similar text
    assert len(set(want) - set(got)) <= len(want) * 0.03
    kept = {r.doc_id for r in st.drop_similar(docs).collect()}
    assert kept == set(rows) - set(got)


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (2, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in st.drop_similar(docs).collect()) == [1, 3]
    rows = [(0, "a b c d e f"), (1, "a b c d e f"), (1, "only here it stands"), (None, "only here it stands"), (None, "z")]
    got = st.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text[:1]) for r in got) == [(False, 0, "a"), (False, 1, "o"), (True, 0, "z")]
    assert st.drop_similar(docs.limit(0)).collect() == []


def test_the_fingerprint_index_links_near_texts(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(20):  # long texts with one word replaced: nearly all within three bits
        base = [rng.choice(words) for _ in range(3000)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:1500] + ["zz"] + base[1501:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    reps = st.sketches(docs, 5, 0.8).withColumnRenamed("doc_id", "rep")
    pairs = {tuple(r) for r in st.fingerprint_links(reps.select("rep", "fp")).collect()}
    assert pairs <= {(2 * k, 2 * k + 1) for k in range(20)} and len(pairs) >= 12


def test_blocks_and_parts_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(150)]
    rows = {i: " ".join(w if k != i % 149 else f"x{i}" for k, w in enumerate(base)) for i in range(160)}
    rows |= {i + 160: " ".join(base) for i in range(20)}
    rows |= {i + 180: " ".join(rng.choice(words) for _ in range(60)) for i in range(40)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = {(i, r) for i, r in slow_roots(rows).items() if i != r}
    assert {tuple(r) for r in st.similar_roots(docs).collect()} == want
    monkeypatch.setattr(st, "FAN", 3)
    assert {tuple(r) for r in st.similar_roots(docs, block=8).collect()} == want


def test_every_similar_pair_is_found(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows = {}
    for n in (26, 60, 200):
        for _ in range(20):  # an appended or removed block just above 0.8, and chains of such links
            base = [rng.choice(words) for _ in range(n)]
            keep = n - (n - 4) // 5 + (n < 40)
            for w in (base, base[:keep], base[n - keep :], base + [rng.choice(words) for _ in range((n - 4) // 4)]):
                rows[len(rows)] = " ".join(w)
    line = " ".join(words[:12])
    rows |= {len(rows) + i: line + " " + " ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) for i in range(100)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = {(i, r) for i, r in slow_roots(rows).items() if i != r}
    assert len(want) > 100
    assert {tuple(r) for r in st.similar_roots(docs).collect()} == want


def test_the_order_of_shingles_changes_nothing(spark, monkeypatch):
    rows = dict(enumerate(texts()[:70]))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = {i: r for i, r in slow_roots(rows).items() if i != r}
    hashes = np.unique(np.concatenate([st.shingle_hashes(t.encode(), 5) for t in rows.values() if t]))
    orders = {"none": np.empty(0, np.int64), "turned": np.arange(len(hashes), 0, -1), "mixed": np.random.default_rng(2).permutation(len(hashes)) + 1}
    for name, places in orders.items():
        monkeypatch.setattr(st, "common_shingles", lambda docs, width, places=places: (hashes[: len(places)], places))
        assert {r.node: r.root for r in st.similar_roots(docs).collect()} == want, name
