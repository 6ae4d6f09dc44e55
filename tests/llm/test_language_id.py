import random
from itertools import product

import numpy as np

from strandflow.llm import language_id as li

WORDS = {"aa": ["bar", "baba", "abra", "rab"], "ee": ["lele", "ell", "elle", "tel"], "oo": ["zozo", "ozon", "zoo", "ño"]}


def sample(n, seed=1):
    rng = random.Random(seed)
    return [(" ".join(rng.choice(WORDS[x]) for _ in range(rng.randint(1, 90))), x) for x in WORDS for _ in range(n)]


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    scores, steps = rng.normal(size=(2, 5, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    real = np.ones((2, 5), bool)
    real[1, 3:] = False
    scores[1, 3:] = 0
    got = li.forward_backward(scores, real, steps)[0]
    for c, n in ((0, 5), (1, 3)):
        want = np.zeros((n, 3))
        for path in product(range(3), repeat=n):
            p = np.exp(sum(scores[c, i, y] for i, y in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                want[i, y] += p
        assert np.allclose(got[c, :n], want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_words_of_switched_text(spark):
    data = sample(60)
    model = li.train([t for t, _ in data], [x for _, x in data])
    held = sample(20, seed=5)
    names, scores = li.predict([t for t, _ in held], model)
    assert np.mean([a == b for a, (_, b) in zip(names, held)]) > 0.97 and ((scores >= 0) & (scores <= 1)).all()
    text = "bar baba abra rab bar baba lele ell elle tel lele ell zozo ozon zoo zozo"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    spans = li.language_spans(docs, model).orderBy("first_word").collect()
    assert [(r.first_word, r.last_word, r.lang) for r in spans] == [(0, 5, "aa"), (6, 11, "ee"), (12, 15, "oo")]


def test_odd_texts_and_keys(spark):
    data = sample(30)
    texts = [None, "", " \n", "12 34 !!", "bar " * 30_000, "x" * 50_000, "BAR, baba.", "日本語 テキスト", "\x00 bar \U0001d4d0"]
    rows = [(i, t, x, "s") for i, (t, x) in enumerate(data)] + [(500 + i, t, "aa", "s") for i, t in enumerate(texts)] + [(900, "bar", None, "s")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = li.fit(docs)
    got = li.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[500 + i].lang_pred for i in range(4)] == ["und"] * 4 and by[500].score == 0
    assert by[504].lang_pred == "aa" and by[506].lang_pred == "aa" and by[507].lang_pred in WORDS
    kept = li.keep_identified(docs)
    assert kept.columns == docs.columns
    assert not {500, 501, 502, 503} & {r.doc_id for r in kept.collect()} and {r.doc_id for r in kept.collect()} >= {504, 900}
    empty = docs.limit(0)
    assert li.identify(empty, li.fit(empty)).collect() == [] and li.keep_identified(empty).collect() == []
    assert {r.lang_pred for r in li.identify(docs, li.fit(empty)).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(2)
    letters = [chr(c) for c in range(0x561, 0x581)]
    names = [f"l{k:03}" for k in range(130)]
    speech = {n: ["".join(rng.choice(letters, 6)) for _ in range(8)] for n in names}
    rows = [(i, " ".join(rng.choice(speech[n], 12)), n) for i, n in enumerate(n for n in names for _ in range(8))]
    docs = spark.createDataFrame(rows + [(None, rows[0][1], names[0])] * 50, "doc_id long, text string, lang string")
    model = li.fit(docs)
    assert model.languages == names
    got = {r.doc_id: r.lang_pred for r in li.identify(docs.where("doc_id IS NOT NULL"), model).collect()}
    assert np.mean([got[i] == n for i, _, n in rows]) > 0.97
    texts, langs = li.labelled_sample(docs, 5, 10_000)
    assert set(langs) == set(names) and max(map(langs.count, names)) <= 5
    assert max(map(li.labelled_sample(docs, 200, 100)[1].count, names)) <= 20


def test_long_words_score_whole():
    data = sample(30)
    model = li.train([t for t, _ in data], [x for _, x in data])
    words = np.array(["bar", "bar" * 40 + "zozo"], dtype=object)
    both, _ = li.emissions(words, model)
    alone, _ = li.emissions(words[1:], model)
    assert np.allclose(both[1], alone[0]) and not np.allclose(both[1], li.emissions(np.array(["bar" * 40], dtype=object), model)[0][0])
