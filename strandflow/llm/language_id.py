"""Language identification of code-switched text with a linear-chain CRF.

Each white-space word is a position of the chain and each learned language a label.
Word features are affixes (first and last one to three characters), character bigrams
and trigrams, and membership in a lexicon of the words that recur in the training
documents; label-to-label transitions are learned with them. Marginal label
probabilities come from forward-backward over chains of CHAIN words; a document's
language is the label with the largest mean marginal over its words that have a letter.

Training uses a bounded sample of documents, chosen by a hash, of every language that has
a label, and spans spliced in from other languages, so that transitions see switches.
Scoring reads every text whole.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, table
from .crf import forward_backward, pair_expectations

CHAIN = 64
BITS = 16
#: Characters of text scored at a time inside a task, which bounds its memory.
CHUNK_CHARS = 2_000_000
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # (2 ** BITS, languages); row 0 is no feature
    steps: np.ndarray  # (languages, languages) log transition scores
    lexicon: np.ndarray  # sorted 64-bit hashes of the lexicon's words


_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """By code point, built once a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind * 0x632BE5AB)) * _MUL
    return (h >> np.uint64(64 - BITS)).astype(np.int64) | 1  # odd slots only, so never 0


def _word_hash(chars: np.ndarray) -> np.ndarray:
    h = np.zeros(len(chars), np.uint64)
    for column in chars.T:
        h = np.where(column > 0, (h ^ column) * _MUL, h)
        h ^= h >> np.uint64(29)
    return h


def features(words: np.ndarray, lexicon: np.ndarray):
    """Yield (positions, slots, has_letter) for distinct words, by length class."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    classes = np.maximum(3, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    for k in np.unique(classes):
        at = np.flatnonzero(classes == k)
        width = 1 << int(k)
        step = max(1, (1 << 20) // width)
        for part in np.split(at, range(step, len(at), step)):
            raw = np.array(words[part].tolist(), dtype=f"U{width}")
            code = raw.view(np.uint32).reshape(len(part), width)
            chars = code.astype(np.uint64)
            n = np.maximum(sizes[part], 1)
            rows = np.arange(len(part))
            two = chars[:, :-1] << np.uint64(21) | chars[:, 1:]
            three = two[:, :-1] << np.uint64(21) | chars[:, 2:]
            cols = [np.where(chars[:, 1:] > 0, _slot(two, 1), 0), np.where(chars[:, 2:] > 0, _slot(three, 2), 0)]
            last = [np.where(n > j, chars[rows, np.maximum(n - 1 - j, 0)], 0).astype(np.uint64) for j in range(3)]
            heads = [chars[:, 0], two[:, 0], three[:, 0]]
            tails = [last[0], last[1] << np.uint64(21) | last[0], (last[2] << np.uint64(21) | last[1]) << np.uint64(21) | last[0]]
            h = _word_hash(chars)
            known = np.zeros(len(part), bool)
            if len(lexicon):
                spot = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
                known = lexicon[spot] == h
            single = [_slot(x, 3 + i) for i, x in enumerate(heads + tails)] + [np.where(known, _slot(h, 9), 0)]
            yield part, np.column_stack([*cols, *single]), _is_letter()[code].any(axis=1)


def emissions(words: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Label scores of distinct words, and whether each has a letter (if not: zeros)."""
    out = np.zeros((len(words), len(model.languages)), np.float32)
    letters = np.zeros(len(words), bool)
    for at, slots, has in features(words, model.lexicon):
        total = np.zeros((len(at), out.shape[1]), np.float32)
        for column in slots.T:
            total += model.weights[column]
        out[at] = np.where(has[:, None], total, 0)
        letters[at] = has
    return out, letters


def _chains(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chain and position of every word, for documents of so many words."""
    chains = -(-counts // CHAIN)
    first = np.concatenate(([0], np.cumsum(chains)[:-1])) if len(counts) else np.zeros(0, np.int64)
    start = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)
    nth = np.arange(counts.sum()) - np.repeat(start, counts)
    return np.repeat(first, counts) + nth // CHAIN, nth % CHAIN


def marginals(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of all words, whether each has a letter, and the words a text."""
    split = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    k = len(model.languages)
    if not counts.sum():
        return np.zeros((0, k), np.float32), np.zeros(0, bool), counts
    ids, words = pd.factorize(np.array([w for ws in split for w in ws], dtype=object))
    scores, letters = emissions(words, model)
    chain, nth = _chains(counts)
    grid = np.zeros((chain[-1] + 1, CHAIN, k), np.float32)
    real = np.zeros((chain[-1] + 1, CHAIN), bool)
    grid[chain, nth] = scores[ids]
    real[chain, nth] = True
    return forward_backward(grid, real, model.steps)[0][chain, nth], letters[ids], counts


def predict(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; a text without a letter gets UNKNOWN and 0. Of
    languages that tie, the first in alphabetical order counts."""
    probs, letters, counts = marginals(texts, model)
    owner = np.repeat(np.arange(len(texts)), counts)
    sums = np.stack([np.bincount(owner, p * letters, minlength=len(texts)) for p in probs.T.astype(np.float64)], axis=1)
    total = np.bincount(owner, letters, minlength=len(texts))
    score = sums.max(axis=1) / np.maximum(total, 1)
    best = sums.argmax(axis=1)
    names = [model.languages[b] if t else UNKNOWN for b, t in zip(best, total, strict=True)]
    return names, np.clip(np.where(total > 0, score, 0), 0, 1)


def train(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 0.2, lexicon_docs: int = 4, seed: int = 7) -> Model:
    """Fit weights and transitions by Adagrad on the conditional likelihood of the chains."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    split = [t.lower().split() for t in texts]
    gold_doc = np.array([languages.index(x) for x in labels], np.int64)
    seen: dict[str, int] = {}
    for ws in split:
        for w in set(ws):
            seen[w] = seen.get(w, 0) + 1
    ids, words = pd.factorize(np.array([w for ws in split for w in ws] or ["a"], dtype=object))
    known = np.array([w for w in words if seen.get(w, 0) >= lexicon_docs], dtype=object)
    hashes = [_word_hash(np.array([w], dtype=f"U{1 << max(3, int(np.ceil(np.log2(max(len(w), 1)))))}").view(np.uint32).reshape(1, -1).astype(np.uint64))[0] for w in known]
    lexicon = np.unique(np.array(hashes, np.uint64))
    weights = np.zeros((1 << BITS, len(languages)), np.float32)
    model = Model(languages, weights, np.zeros((len(languages),) * 2, np.float32), lexicon)
    if len(languages) < 2:
        return model
    most = max(s.shape[1] for _, s, _ in features(words, lexicon))
    slots, letter = np.zeros((len(words), most), np.int32), np.zeros(len(words), bool)
    for at, s, has in features(words, lexicon):
        slots[at, : s.shape[1]] = np.where(has[:, None], s, 0)
        letter[at] = has
    counts = np.array([len(w) for w in split], np.int64)
    chain, nth = _chains(counts)
    n = int(chain[-1]) + 1
    grid, gold = np.full((n, CHAIN), -1, np.int64), np.zeros((n, CHAIN), np.int64)
    grid[chain, nth] = ids
    gold[chain, nth] = np.repeat(gold_doc, counts)
    past, past_steps = np.full(weights.shape, 1e-6, np.float32), np.full(model.steps.shape, 1e-6, np.float32)
    steps = model.steps
    for _ in range(epochs):
        for pick in np.array_split(rng.permutation(n), max(1, n // 64)):
            g, y = grid[pick].copy(), gold[pick].copy()
            other = rng.permutation(n)[: len(pick)]  # splice a span of another chain into half of them
            for i in np.flatnonzero(rng.random(len(pick)) < 0.5):
                a, b = sorted(rng.integers(0, CHAIN + 1, 2))
                ok = (g[i, a:b] >= 0) & (grid[other[i % len(other)], a:b] >= 0)
                g[i, a:b] = np.where(ok, grid[other[i % len(other)], a:b], g[i, a:b])
                y[i, a:b] = np.where(ok, gold[other[i % len(other)], a:b], y[i, a:b])
            real = g >= 0
            used, inv = np.unique(g[real], return_inverse=True)
            scores = np.zeros((len(g), CHAIN, len(languages)), np.float32)
            scores[real] = weights[slots[used]].sum(axis=1)[inv]
            probs, ahead, back, e, t = forward_backward(scores, real, steps)
            err = (np.eye(len(languages), dtype=np.float32)[y] - probs)[real]
            by_word = np.stack([np.bincount(inv, err[:, c], minlength=len(used)) for c in range(err.shape[1])], axis=1)
            flat = slots[used].ravel()
            grad = np.stack([np.bincount(flat, np.repeat(by_word[:, c], most), minlength=1 << BITS) for c in range(err.shape[1])], axis=1)
            grad = (grad / len(pick)).astype(np.float32)
            grad[0] = 0
            past += grad * grad
            weights += rate * grad / np.sqrt(past)
            pair = np.zeros_like(steps)
            np.add.at(pair, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
            step = (pair - pair_expectations(ahead, back, e, t, real)) / len(pick)
            past_steps += step * step
            steps += (rate * step / np.sqrt(past_steps)).astype(np.float32)
    return model


def labelled_sample(docs: DataFrame, docs_per_language: int, docs_in_all: int) -> tuple[list[str], list[str]]:
    """Labelled texts of every language: at most docs_per_language each and, where there are so
    many languages that this is more than docs_in_all, an equal share of that (20 at least).
    The sample is drawn by a hash of id and text; rows that repeat both count once."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    counts = known.groupBy("lang").count()
    languages = max(1, counts.count())
    each = min(docs_per_language, max(20, docs_in_all // languages))
    ticket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.join(F.broadcast(counts), "lang").where(ticket < F.least(F.lit(1.0), F.lit(1.2 * each) / F.col("count")))
    rows = drawn.select("doc_id", "lang", "text").distinct().toPandas().sort_values(["doc_id", "text"])
    rows = rows.groupby("lang").head(each)
    return rows["text"].tolist(), rows["lang"].tolist()


def fit(docs: DataFrame, docs_per_language: int = 200, docs_in_all: int = 4000) -> Model:
    """docs: doc_id, text, lang; rows without a text or language teach nothing, all others may:
    every language is learned, from a sample of bounded size."""
    return train(*labelled_sample(docs, docs_per_language, docs_in_all))


def chunks(texts: list, size: int = CHUNK_CHARS):
    """Consecutive slices of whole texts of about so many characters."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t or "") > size:
            yield slice(start, i)
            start, total = i, 0
        total += len(t or "")
    if start < len(texts):
        yield slice(start, len(texts))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, lang_pred, score. Null, empty and letterless texts,
    and any text when nothing was learned, get 'und' and 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in chunks(texts):
                own = texts[part]
                names, score = predict(own, m) if m.languages else ([UNKNOWN] * len(own), np.zeros(len(own)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part].cast(pa.int64()), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_spans(docs: DataFrame, model: Model) -> DataFrame:
    """Runs of words of one language: doc_id, first_word, last_word (from 0), lang, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for part in chunks(texts):
                probs, _, counts = marginals(texts[part], m)
                label, best = probs.argmax(axis=1), probs.max(axis=1)
                rows, at = [], 0
                for doc, n in zip(ids[part], counts, strict=True):
                    own, p = label[at : at + n], best[at : at + n]
                    edges = np.flatnonzero(np.diff(own)) + 1
                    for a, b in zip([0, *edges], [*edges, n], strict=True) if n else []:
                        rows.append((doc, int(a), int(b) - 1, m.languages[own[a]], float(p[a:b].mean())))
                    at += n
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "first_word", "last_word", "lang", "score"]), preserve_index=False, schema=pa.schema([("doc_id", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("lang", pa.string()), ("score", pa.float64())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, first_word long, last_word long, lang string, score double")


FOLDS, FOLD = 4, 2


def learn(docs: DataFrame) -> Model:
    """The queries' model: from the documents outside the held-out fold."""
    return fit(docs.where(~held_out(F.col("doc_id"), FOLDS, FOLD)))


def keep_identified(docs: DataFrame, least: float = 0.05) -> DataFrame:
    """docs without those of no language or with a mean word posterior so near to chance (one
    in the number of learned languages) that it goes less than the share ``least`` of the way
    from there to certainty. With one language or none, only texts without a letter go.

    The model is learned from docs itself; each text is scored where it is read, so the
    rows are not joined or shuffled. Null and empty texts go, rows that repeat or lack an id
    are judged each, the first of languages that tie counts, an empty table gives no rows."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches):
        m = model.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in chunks(texts):
                own = texts[part]
                if m.languages:
                    names, score = predict(own, m)
                    chance = 1 / len(m.languages)
                    keep = np.array([n != UNKNOWN for n in names], bool) & (score >= chance + least * (1 - chance))
                else:
                    keep = np.array([bool(LETTER.search(t)) for t in own], bool)
                yield batch.slice(part.start, part.stop - part.start).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "lang_pred", "score")
