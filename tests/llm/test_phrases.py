import random
import re
from collections import Counter

import numpy as np
import pytest

from strandflow.llm import phrases as ph

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def slow(rows, longest, least, percent, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        n[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, p), a in cand.items():
        longer = [b for (other, q), b in cand.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= percent * a for b in longer):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, found in out.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])}


def corpus():
    rng = random.Random(4)
    words = ["Ab", "ab", "c", "dé", "e", "f g", "𝄞", "x-y"]
    runs = ["new york city hall", "the the the the the", "q r s t u v w"]
    rows = []
    for i in range(150):
        w = [rng.choice(words) if rng.random() < 0.7 else rng.choice(runs) for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(["en", "fr", None]), rng.choice([" ", "\t", "  "]).join(x + rng.choice(["", "", "", ".", ",", "\n"]) for x in w)))
    return [*rows, ("en", None), (None, ""), ("de", " . "), ("en", "the " * 3000), rows[0], rows[0]]


@pytest.mark.parametrize(("longest", "least", "percent", "top"), [(5, 8, 100, 2000), (3, 5, 60, 12), (6, 30, 100, 3)])
def test_against_brute_force(spark, longest, least, percent, top):
    rows = corpus()
    docs = spark.createDataFrame([(i, lang, t, 1, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, a long, phrase string")
    got = ph.mine(docs.repartition(5), longest, least, percent, top)
    assert got.columns == NAMES
    assert {tuple(r) for r in got.collect()} == slow(rows, longest, least, percent, top)


def test_a_prefix_that_goes_on_in_other_rows():
    """Cut anywhere, the parts of each count add up."""
    rng = np.random.default_rng(3)
    rows = np.unique(rng.integers(1, 4, (200, 5)), axis=0)
    f = rng.integers(1, 9, len(rows))
    whole = dict((tuple(p), n) for p, n in ph.grow(list(rows.T), f, 20))
    for k in (1, 7, 50, len(rows) - 1):
        parts = Counter()
        for part in (slice(None, k), slice(k, None)):
            for p, n in ph.grow(list(rows[part].T), f[part], 20):
                parts[tuple(p)] += n
        assert {p: n for p, n in parts.items() if n >= 20} == {p: n for p, n in whole.items() if n >= 20}


def test_exact_beyond_64_bits(spark):
    rows = [([1, 2], 30_000_000_001)]
    phrases = spark.createDataFrame(rows, "phrase array<long>, a long")
    words = spark.createDataFrame([(1, "en", "a", 70_000_000_007), (2, "en", "b", 90_000_000_011)], "h long, lang string, word string, f long")
    totals = spark.createDataFrame([("en", 7_000_000_000_003)], "lang string, n long")
    got = ph.scored(phrases, words, totals).first()
    assert got.score == 1000 * 30_000_000_001 * 7_000_000_000_003 // (70_000_000_007 * 90_000_000_011)


def test_empty_and_colliding_words(spark, monkeypatch):
    docs = spark.createDataFrame([("a b",)] * 6, "text string").selectExpr("text", "CAST(NULL AS STRING) AS lang")
    assert ph.mine(docs.limit(0)).collect() == []
    assert [(r.lang, r.phrase, r.a, r.n) for r in ph.mine(docs, 3, 5).collect()] == [("und", "a b", 6, 12)]
    tables, real = [], ph.word_table

    def colliding(docs, seed):
        tables.append(seed)
        return real(docs, seed) if seed else real(docs, seed).selectExpr("1L AS h", "lang", "word", "f")

    monkeypatch.setattr(ph, "word_table", colliding)
    assert ph.counted_words(docs)[1] == 1 and tables == [0, 1]


def test_short_ids_keep_frequent_words_apart(spark):
    rows = [(5 << 40 | 7, 200), (7, 1), (1 << 40 | 9, 1), (9, 1)]
    words = spark.createDataFrame(rows, "h long, f long")
    assert ph.enough_bits(words, 100) == 48  # a frequent word and a rare one share 40 bits
    assert ph.enough_bits(words.where("f = 1"), 100) == 40  # rare ones may
    assert ph.enough_bits(spark.createDataFrame([(1 << 60, 500), (1 << 61, 500)], "h long, f long"), 100) == 64
