"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Every overlapping window of WINDOW words (each STRIDE words one) of a text is scored.
A logistic head turns the windows' scores into the text's: it sees the highest score,
the mean score and the number of windows, so one odd word in a long text weighs less
than the same word again and again. A word enters as the vector of its entry in
the training vocabulary (zero for other words) beside the mean vector of its character
trigrams. Two gated recurrent units read the window from both ends; attention weighs
their states into one vector, which a logistic output scores.

Training windows carry their document's label. Labels come from a bounded sample of
documents; everything that is scored is read whole.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_texts, numbered_words, table, tokens
from .language_id import chunks

WINDOW, STRIDE = 32, 16
WORD, CHAR, HIDDEN = 8, 16, 8
TRIGRAMS = 1 << 13
LONG = 64  # trigrams of a word that are added up side by side with those of other words
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Network(NamedTuple):
    vocabulary: dict[bytes, int]  # ids from 1; 0 is every other word
    p: dict[str, np.ndarray]
    head: np.ndarray  # weights over head_inputs()


def head_inputs(owner: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Per text with windows: 1, log odds of the highest and of the mean score, log of the windows."""
    top, total = np.zeros(n), np.bincount(owner, minlength=n)
    np.maximum.at(top, owner, y)
    mean = np.bincount(owner, y, minlength=n) / np.maximum(total, 1)

    def odds(x):
        x = np.clip(x, 1e-3, 1 - 1e-3)
        return np.log(x / (1 - x))

    return np.stack([np.ones(n), odds(top), odds(mean), np.log(np.maximum(total, 1))], axis=1)


def fit_head(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (weight * (y - q)) - ridge * w)
    return w


def flat_slots(letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of '<word>', flat, and how many each word has; words are one run of bytes, cut by sizes."""
    wide = sizes + 2
    first = np.cumsum(wide) - wide
    b = np.zeros(len(letters) + 2 * len(sizes) + 2, np.uint8)
    b[first], b[first + sizes + 1] = 2, 3
    b[np.arange(len(letters)) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes)] = letters
    b = b.astype(np.uint64)
    grams = (b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) * _MUL >> np.uint64(64 - 13)
    n = np.maximum(sizes, 1)  # an empty word still has one
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return grams[np.repeat(first, n) + nth].astype(np.int64), n


def trigram_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """flat_slots of a list of words."""
    return flat_slots(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))


def mean_vectors(chars: np.ndarray, slots: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean of each word's n trigram vectors: all words' first ones are added up, then all second ones and so on; what
    a word has beyond LONG is added on its own."""
    order = np.argsort(-n, kind="stable")
    first = (np.cumsum(n) - n)[order]
    over = len(n) - np.searchsorted(n[order[::-1]], np.arange(LONG + 1), "right")  # words with over 0, 1, ... trigrams
    total = np.zeros((len(n), chars.shape[1]), chars.dtype)
    for nth, k in enumerate(over[:LONG]):
        total[:k] += chars[slots[first[:k] + nth]]
    for i in range(over[LONG]):
        total[i] += chars[slots[first[i] + LONG : first[i] + n[order[i]]]].sum(axis=0, dtype=np.float64)
    out = np.empty_like(total)
    out[order] = total
    return out / n[:, None]


def _inputs(net: Network, ids: np.ndarray, slots: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.concatenate([net.p["words"][ids], mean_vectors(net.p["chars"], slots, n)], axis=1).astype(np.float32)


def word_inputs(words: list[bytes], net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Input vectors of distinct words, with the vocabulary ids and trigrams they come from."""
    ids = np.fromiter((net.vocabulary.get(w, 0) for w in words), np.int64, len(words))
    slots, n = trigram_slots(words)
    return _inputs(net, ids, slots, n), ids, slots, n


def array_inputs(words: pa.LargeBinaryArray, net: Network) -> np.ndarray:
    """Input vectors of an Arrow array of distinct words, without a Python object for each."""
    known = pa.array(list(net.vocabulary), pa.large_binary())
    ids = np.array([0, *net.vocabulary.values()], np.int64)[pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy() + 1]
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    letters = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return _inputs(net, ids, *flat_slots(letters, np.diff(ends)))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, word index or -1 by position) of all windows of texts of so many words."""
    n = np.where(counts > 0, np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1, 0)
    owner = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (nth * STRIDE)[:, None] + np.arange(WINDOW)
    first = np.cumsum(counts) - counts
    return owner, np.where(at < counts[owner][:, None], at + first[owner][:, None], -1)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _read(inputs: np.ndarray, grid: np.ndarray, real: np.ndarray, u: np.ndarray, order):
    """States (WINDOW, n, HIDDEN) and tape of one direction; inputs are words' projected vectors."""
    n = len(grid)
    h, states, tape = np.zeros((n, HIDDEN), np.float32), np.empty((WINDOW, n, HIDDEN), np.float32), []
    for t in order:
        x = inputs[grid[:, t]]
        a = h @ u
        zr = _sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        new = np.where(real[:, t, None], c + z * (h - c), h)
        tape.append((t, h, z, r, c, a[:, 2 * HIDDEN :]))
        h = states[t] = new
    return states, tape


def forward(net: Network, inputs: np.ndarray, grid: np.ndarray, real: np.ndarray):
    """Scores of windows (grid: rows of inputs) that have a word each, with what their gradients need."""
    p = net.p
    f, tf = _read(inputs @ p["wf"] + p["bf"], grid, real, p["uf"], range(WINDOW))
    b, tb = _read(inputs @ p["wb"] + p["bb"], grid, real, p["ub"], reversed(range(WINDOW)))
    h = np.concatenate([f, b], axis=2)
    act = np.tanh(h @ p["wa"])
    e = np.where(real.T, act @ p["va"], -1e9)
    alpha = np.exp(e - e.max(axis=0))
    alpha /= alpha.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", alpha, h)
    return _sigmoid(pooled @ p["wo"] + p["bo"]), (h, act, alpha, pooled, tf, tb)


def _back_read(dstates, tape, grid, real, u, n_words):
    """Gradients of one direction: of the words' projected inputs and of u."""
    dx_words, du, dh = np.zeros((n_words, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros(dstates.shape[1:], np.float32)
    for t, h, z, r, c, ac in reversed(tape):
        d = dh + dstates[t]
        live = real[:, t, None]
        dc = np.where(live, d * (1 - z), 0) * (1 - c * c)
        dz = np.where(live, d * (h - c), 0) * z * (1 - z)
        dr = dc * ac * r * (1 - r)
        dx = np.concatenate([dz, dr, dc], axis=1)
        da = np.concatenate([dz, dr, dc * r], axis=1)
        dh = np.where(live, d * z, d) + da @ u.T
        du += h.T @ da
        np.add.at(dx_words, grid[:, t], dx)
    return dx_words, du


def gradients(net: Network, words, grid, real, y, weight):
    """Loss and gradients of a batch over distinct words (grid indexes them)."""
    p = net.p
    inputs, ids, slots, n = word_inputs(words, net)
    out, (h, act, alpha, pooled, tf, tb) = forward(net, inputs, grid, real)
    do = ((out - y) * weight / weight.sum()).astype(np.float32)
    g = {"wo": pooled.T @ do, "bo": np.array(do.sum(), np.float32)}
    dpooled = do[:, None] * p["wo"]
    dalpha = np.einsum("nh,tnh->tn", dpooled, h)
    de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
    dact = de[:, :, None] * p["va"] * (1 - act * act)
    g["va"] = np.einsum("tn,tnk->k", de, act)
    g["wa"] = np.einsum("tnh,tnk->hk", h, dact)
    dh = alpha[:, :, None] * dpooled + dact @ p["wa"].T
    df, g["uf"] = _back_read(dh[:, :, :HIDDEN], tf, grid, real, p["uf"], len(words))
    db, g["ub"] = _back_read(dh[:, :, HIDDEN:], tb, grid, real, p["ub"], len(words))
    g["wf"], g["wb"], g["bf"], g["bb"] = inputs.T @ df, inputs.T @ db, df.sum(axis=0), db.sum(axis=0)
    dinput = df @ p["wf"].T + db @ p["wb"].T
    g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
    np.add.at(g["words"], ids, dinput[:, :WORD])
    g["words"][0] = 0
    np.add.at(g["chars"], slots, np.repeat(dinput[:, WORD:] / n[:, None], n, axis=0))
    loss = -np.average(np.where(y > 0, np.log(out + 1e-7), np.log(1 - out + 1e-7)), weights=weight)
    return loss, g


def new_network(vocabulary: dict[bytes, int], prior: float, seed: int) -> Network:
    rng = np.random.default_rng(seed)

    def draw(*shape, scale=0.3):
        return rng.normal(0, scale, shape).astype(np.float32)

    p = {"words": draw(len(vocabulary) + 1, WORD, scale=0.05), "chars": draw(TRIGRAMS, CHAR)}
    for d in "fb":
        p |= {f"w{d}": draw(WORD + CHAR, 3 * HIDDEN), f"u{d}": draw(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
    p |= {"wa": draw(2 * HIDDEN, 2 * HIDDEN), "va": draw(2 * HIDDEN), "wo": draw(2 * HIDDEN), "bo": np.array(np.log(prior / (1 - prior)), np.float32)}
    p["words"][0] = 0
    return Network(vocabulary, p, np.array([0.0, 1.0, 0.0, 0.0]))


def train(texts: list[str], labels: list[int], per_class: int = 16_000, epochs: int = 6, rate: float = 0.01, least_docs: int = 20, clean_ratio: float = 4.0, seed: int = 3) -> Network:
    """Adam over at most ``per_class`` windows of each label, drawn with a seed.

    All windows of a clean text are clean. Of a toxic text's windows, from the second epoch
    on, only those that score at least the text's median stay toxic examples; the others
    are left out. The vocabulary is the words of at least ``least_docs`` texts; half its
    entries are hidden in each step, so the characters must explain words too. Clean
    windows weigh ``clean_ratio`` times as much as toxic ones in all, whatever their
    numbers in the sample; so do clean texts for the head. Every fourth text teaches only
    the head."""
    split = [tokens(t) for t in texts]
    seen: dict[bytes, int] = {}
    for ws in split:
        for w in set(ws):
            seen[w] = seen.get(w, 0) + 1
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w, c in seen.items() if c >= least_docs))}
    word_ids, distinct = pd.factorize(np.array([w for ws in split for w in ws] or [b""], dtype=object))
    distinct = list(distinct)
    owner, at = windows(np.array([len(ws) for ws in split], np.int64))
    y = np.asarray(labels, np.float32)[owner] if len(owner) else np.zeros(0, np.float32)
    net = new_network(vocabulary, 1 / (1 + clean_ratio), seed)
    rng = np.random.default_rng(seed)
    toxic, clean = (rng.permutation(np.flatnonzero((y == v) & (owner % 4 > 0)))[:per_class] for v in (1, 0))
    if not len(toxic) or not len(clean):
        return net
    clean_weight = clean_ratio * len(toxic) / len(clean)
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    for epoch in range(epochs):
        if epoch:
            now = pd.Series(window_scores(net, word_inputs(distinct, net)[0], word_ids, at[toxic]))
            stay = now >= now.groupby(owner[toxic]).transform("median")
        chosen = np.concatenate([toxic[stay.to_numpy()] if epoch else toxic, clean])
        for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 128)):
            place = at[part]
            real = place >= 0
            used, grid = np.unique(np.where(real, word_ids[np.maximum(place, 0)], word_ids[0]), return_inverse=True)
            words = [distinct[i] for i in used]
            shown = {w: vocabulary[w] for w in words if w in vocabulary and rng.random() < 0.5}
            weight = np.where(y[part] > 0, 1, clean_weight).astype(np.float32)
            g = gradients(net._replace(vocabulary=shown), words, grid.reshape(place.shape), real, y[part], weight)[1]
            step += 1
            for k, x in net.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] * g[k] - v[k])
                x -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                if k in ("words", "chars"):
                    x *= 1 - 3e-4
    x = head_inputs(owner, window_scores(net, word_inputs(distinct, net)[0], word_ids, at), len(split))
    some = np.array([len(ws) > 0 and i % 4 == 0 for i, ws in enumerate(split)])
    x, label = x[some], np.asarray(labels, np.float64)[some]
    return net._replace(head=fit_head(x, label, np.where(label > 0, 1, clean_ratio * label.sum() / max((1 - label).sum(), 1))))


def window_scores(net: Network, inputs: np.ndarray, word_ids: np.ndarray, at: np.ndarray, step: int = 1024) -> np.ndarray:
    """forward()'s scores of all windows over the distinct words' inputs, without a tape.

    So few windows are read at a time that the arrays of a step fit a core's cache, both directions in one pass. Units are rows
    and windows columns, so every gate is one run of memory. A gate 1 / (1 + exp(-x)) is (tanh(x / 2) + 1) / 2; its halves are in the
    weights. A place without a word has a row of its own after the words' whose update gate is 1, so the state stays as it is."""
    p, none = net.p, len(inputs)
    half = np.repeat(np.array([0.5, 0.5, 1], np.float32), HIDDEN)
    tables, ids = [], np.append(word_ids, none)  # at -1 is the last
    for d in "fb":
        stay = np.repeat(np.array([[50, 0, 0]], np.float32), HIDDEN, axis=1)
        tables.append(np.concatenate([(inputs @ p[f"w{d}"] + p[f"b{d}"]) * half, stay]).astype(np.float32))
    u = np.stack([0.5 * p["uf"].T, 0.5 * p["ub"].T])
    out = np.zeros(len(at), np.float32)
    for s in range(0, len(at), step):
        grid = ids[at[s : s + step].T]
        n = grid.shape[1]
        h, states = np.zeros((2, HIDDEN, n), np.float32), np.empty((2, HIDDEN, WINDOW, n), np.float32)
        x, a = np.empty((2, 3 * HIDDEN, n), np.float32), np.empty((2, 3 * HIDDEN, n), np.float32)
        gates, z, r, c = a[:, : 2 * HIDDEN], a[:, :HIDDEN], a[:, HIDDEN : 2 * HIDDEN], x[:, 2 * HIDDEN :]
        for t in range(WINDOW):
            for i, place in enumerate((t, WINDOW - 1 - t)):
                x[i] = tables[i].take(grid[place], axis=0).T
            np.matmul(u, h, out=a)
            gates += x[:, : 2 * HIDDEN]
            np.tanh(gates, out=gates)
            gates += 1
            r *= a[:, 2 * HIDDEN :]
            c += r
            np.tanh(c, out=c)
            z *= 0.5
            h -= c
            h *= z
            h += c
            states[0, :, t], states[1, :, WINDOW - 1 - t] = h
        states = states.reshape(2 * HIDDEN, WINDOW * n)
        act = p["wa"].T @ states
        e = (p["va"] @ np.tanh(act, out=act)).reshape(WINDOW, n)
        e[grid == none] = -1e9
        alpha = np.exp(e - e.max(axis=0))
        alpha /= alpha.sum(axis=0)
        pooled = np.multiply(states.reshape(2 * HIDDEN, WINDOW, n), alpha, out=act.reshape(2 * HIDDEN, WINDOW, n)).sum(axis=1)
        out[s : s + step] = _sigmoid(p["wo"] @ pooled + p["bo"])
    return out


def score_texts(texts: list[str | None], net: Network) -> np.ndarray:
    """Score of each text; a text without words gets the output's base rate."""
    counts, word_ids, distinct = numbered_words(texts)
    out = np.full(len(texts), float(_sigmoid(net.p["bo"])))
    if not counts.sum():
        return out
    inputs = array_inputs(distinct, net)
    owner, at = windows(counts)
    x = head_inputs(owner, window_scores(net, inputs, word_ids, at), len(texts))
    return np.where(counts > 0, 1 / (1 + np.exp(-np.clip(x @ net.head, -30, 30))), out)


FOLDS, FOLD = 3, 1


def fit(docs: DataFrame, labels: DataFrame, docs_per_class: int = 1200) -> Network:
    """labels: doc_id, toxic; rows of the held-out fold or without a label teach nothing."""
    rows = labelled_texts(docs, labels, "toxic", FOLDS, FOLD, docs_per_class)
    return train(rows["text"].tolist(), rows["label"].tolist())


def score_documents(docs: DataFrame, net: Network, cut_at: float = 0.7) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 from ``cut_at`` on).

    Null, empty and wordless texts get the network's base rate; rows that repeat stay."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in chunks(texts):
                score = score_texts(texts[part], shared.value)
                own = batch.column(0)[part]
                yield pa.RecordBatch.from_arrays([own, pa.array(score), pa.array((score >= cut_at).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", "predicted")
