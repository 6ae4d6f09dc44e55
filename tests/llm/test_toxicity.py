import random
import tracemalloc

import numpy as np

from strandflow.llm import common
from strandflow.llm import toxicity as tx


def sample(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ba", "de", "fo") for b in ("li", "mu", "no") for c in ("ra", "su", "ti")]
    rows = []
    for i in range(n):
        ws = [rng.choice(words) for _ in range(rng.randint(3, 150))]
        if i % 3 == 0:
            for _ in range(max(1, len(ws) // 25)):
                ws[rng.randrange(len(ws))] = rng.choice(["grumph", "Zlotch!", "vexx"])
        rows.append((" ".join(ws), int(i % 3 == 0)))
    return rows


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = tx.new_network({b"a": 1, b"bb": 2}, 0.3, 1)
    net = net._replace(p={k: np.asarray(v, np.float64) for k, v in net.p.items()})
    words = [b"a", b"bb", b"ccc", b"dddd"]
    grid, real = rng.integers(0, 4, (5, tx.WINDOW)), np.ones((5, tx.WINDOW), bool)
    real[1, 4:] = real[2, 1:] = False
    y, weight = np.array([0, 1, 1, 0, 1.0]), np.array([1, 2, 1, 3, 1.0])
    _, g = tx.gradients(net, words, grid, real, y, weight)
    for key in net.p:
        flat, grad = net.p[key].reshape(-1), np.asarray(g[key]).reshape(-1)
        for i in {int(np.abs(grad).argmax()), len(flat) - 1}:
            old, losses = flat[i], []
            for d in (1e-3, -1e-3):
                flat[i] = old + d
                losses.append(tx.gradients(net, words, grid, real, y, weight)[0])
            flat[i] = old
            assert abs((losses[0] - losses[1]) / 2e-3 - grad[i]) < 2e-3 + 0.05 * abs(grad[i]), key


def test_windows_cover_every_word():
    counts = np.array([0, 1, 31, 32, 33, 48, 49, 500])
    owner, at = tx.windows(counts)
    first = np.cumsum(counts) - counts
    for i, n in enumerate(counts):
        own = at[owner == i]
        assert set(own[own >= 0] - first[i]) == set(range(n)) if n else not len(own)
        assert len(own) == (0 if not n else 1 if n <= 32 else -(-(n - 32) // 16) + 1)


def test_trigram_slots():
    slots, n = tx.trigram_slots([b"", b"a", b"ab", "é".encode()])
    assert n.tolist() == [1, 1, 2, 2] and len(slots) == 6
    assert slots[1] == tx.trigram_slots([b"a"])[0][0]


def drawn_windows(sizes, seed=0):
    rng = np.random.default_rng(seed)
    net = tx.new_network({b"a": 1, b"bb": 2}, 0.3, 1)
    net = net._replace(p={k: (v if k == "chars" else v + rng.normal(0, 0.5, v.shape)).astype(np.float32) for k, v in net.p.items()})
    words = [b"w%d" % i for i in range(500)] + [b"a", b"bb"]
    return net, tx.word_inputs(words, net)[0], rng.integers(0, len(words), sum(sizes)), tx.windows(np.array(sizes))[1]


def test_scores_are_those_of_training():
    net, inputs, ids, at = drawn_windows([1, 2, 31, 32, 33, 48, 49, 500, 0, 5])
    real = at >= 0
    want = tx.forward(net, inputs, np.where(real, ids[np.maximum(at, 0)], 0), real)[0]
    for step in (1, 7, 1024):
        assert np.abs(tx.window_scores(net, inputs, ids, at, step=step) - want).max() < 1e-5
    assert want.std() > 0.01


def test_scoring_stays_near_the_cache():
    """Whatever the number of windows, a block's arrays are a few megabytes (69.5 MB in all before)."""
    args = drawn_windows([40_000] * 4)
    tracemalloc.start()
    tx.window_scores(*args)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6


def test_numbered_words_are_the_tokens():
    texts = [None, "", " \n", "!!!", "a", "A b-a\tB\x0bc_c", "\u0130\u03a3 \u039f\u03a3\u2028x \xa0\u3000y", "\U0001f600 9\x000", "\ud800z", "end ", " a", "x" * 1000]
    counts, ids, words = common.numbered_words(texts)
    split = [common.tokens(t) for t in texts]
    assert counts.tolist() == [len(ws) for ws in split]
    words = words.to_pylist()
    assert [words[i] for i in ids] == [w for ws in split for w in ws] and len(set(words)) == len(words)
    for odd in ([], [None], ["?", ""]):
        counts, ids, words = common.numbered_words(odd)
        assert counts.tolist() == [0] * len(odd) and len(ids) == len(words) == 0


def test_inputs_of_arrays_and_lists():
    net = tx.new_network({b"a": 1, b"long" * 40: 2, b"ab": 3}, 0.3, 1)
    texts = ["a zz ab a", "long" * 40 + " " + "q" * 64 + " " + "q" * 65 + " " + "r" * 5000]
    words = common.numbered_words(texts)[2]
    listed, ids, slots, n = tx.word_inputs(words.to_pylist(), net)
    assert np.array_equal(tx.array_inputs(words, net), listed) and ids.tolist() == [1, 0, 3, 2, 0, 0, 0]
    ends = np.cumsum(n)
    for i, end in enumerate(ends):
        assert np.allclose(listed[i, tx.WORD :], net.p["chars"][slots[end - n[i] : end]].astype(float).mean(axis=0), atol=1e-6)
        assert np.array_equal(listed[i, : tx.WORD], net.p["words"][ids[i]])


def test_very_long_words_keep_their_mean():
    net = tx.new_network({}, 0.3, 1)
    found, _, slots, n = tx.word_inputs([b"x" * 2_000_000, b"y"], net)
    exact = net.p["chars"].astype(float)[slots[: n[0]]].mean(axis=0)
    assert np.abs(found[0, tx.WORD :] - exact).max() < 1e-6


def test_held_out_accuracy_and_odd_texts(spark):
    data = sample(240, 1)
    net = tx.train([t for t, _ in data], [y for _, y in data], least_docs=3, epochs=6)
    held = sample(150, 2)
    score = tx.score_texts([t for t, _ in held], net)
    y = np.array([y for _, y in held], bool)
    assert (score[y] >= 0.7).mean() > 0.9 and (score[~y] >= 0.7).mean() < 0.05
    long = " ".join(t for t, y in held if not y) * 20
    texts = [None, "", " \n", "!!!", "grumph", long, "\U0001f600", "x" * 100_000]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)] * 2, "doc_id long, text string, score double")
    rows = tx.score_documents(docs, net).collect()
    assert len(rows) == 2 * len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id < 4}) == 1
    assert tx.score_documents(docs.limit(0), net).collect() == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    rows = tx.score_documents(docs, tx.fit(docs, labels)).collect()
    assert len(rows) == 2 and all(0 <= r.score <= 1 for r in rows)
