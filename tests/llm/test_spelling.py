import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.llm import spelling as sp


def edits(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    return out - {word}


def vocabulary(seed=5, n=900):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        words.add(w)
        words.add(rng.choice(sorted(edits(w, "abcé"))))
    return {w: rng.randint(5, 500) for w in words if len(w) >= 6} | {"a" * 300: 7, "a" * 299: 90, "b" + "a" * 299: 8, "ab" * 100: 5, "ab" * 99 + "b": 6, "naïveté": 9, "naiveté": 60, "𝄞𝄞𝄞𝄞𝄞𝄞": 5, "𝄞𝄞𝄞𝄞𝄞𝄞𝄞": 5}


def slow_pairs(words):
    letters = sorted({c for w in words for c in w})
    return {(w, v) for w in words for v in edits(w, letters) if v in words}


def slow_forms(words, pairs):
    near = {w: [] for w in words}
    for w, v in pairs:
        near[w].append((-words[v], v))
    form = {w: min(v)[1] if v and -min(v)[0] >= 5 * words[w] else None for w, v in near.items()}
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def test_automaton_numbers_words_and_is_minimal():
    words = sorted({"tap", "taps", "top", "tops", "tip", "tips", "stop", "stops", ""})
    a = sp.Automaton(words)
    for n, w in enumerate(words):
        q, number = a.accept(a.letters(sp.spelled([w])[0]), np.array([len(w)]), np.array([0]), np.array([0]), np.array([a.start]), np.array([0]))
        assert (q.tolist(), number.tolist()) == ([0], [n])
    # start, s-, st-, t-, (a|i|o)-, p-, s-end, and sto- that has no words of its own
    assert len(a.final) == 7
    assert sp.Automaton([]).one_error(["abc"], np.array([1]))[0].tolist() == []


@pytest.mark.parametrize("shard_words", [sp.SHARD_WORDS, 50])
def test_near_pairs_match_brute_force(spark, shard_words):
    words = vocabulary()
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [(r.word, r.near) for r in sp.near_pairs(df, 6, shard_words).collect()]
    assert len(got) == len(set(got))
    assert set(got) == slow_pairs(words)


def test_forms_and_roots(spark):
    words = vocabulary(6, 400) | {"reference": 1000, "referance": 40, "referrance": 6, "refference": 7, "references": 900}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in sp.variants(df).collect()}
    assert got == slow_forms(words, slow_pairs(words))
    assert got["referrance"][:2] == ("referance", "reference")


def test_ties_go_to_the_first_in_code_point_order(spark):
    df = spark.createDataFrame([("abcdef", 5), ("abcdez", 50), ("abcdeé", 50), ("abcdeo", 50)], "word string, n long")
    got = {r.word: r.form for r in sp.variants(df).collect()}
    assert got["abcdef"] == "abcdeo" and got["abcdez"] is None


def test_word_counts(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Straße", "straße", "ÉCOLES", "écoles", "abcdefg", "short", "UPPER-CASE×÷", "x1secondly9"]) for _ in range(400)) for _ in range(30)]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, "abcdefg " * 300, "z"), (99, None, "z"), (98, "", None), (0, texts[0], "z")]
    want = Counter()
    letters = {chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]}
    for i, t, _ in rows:
        run = ""
        for c in (t or "") + " ":
            if c in letters:
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
            run = ""
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = {r.word: r.n for r in sp.word_counts(docs).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5 and len(w) >= 6}
    assert sp.variants(sp.word_counts(docs.where(F.lit(False)))).collect() == []
