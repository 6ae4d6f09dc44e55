"""Quality by nearest-neighbour voting in a latent-semantic space.

The terms of a text are its hashed byte trigrams (damped counts times inverse document
frequency) and a few surface terms: shares of capitals, digits, symbols, repeated words
and the like, by level. A truncated singular value decomposition of the labelled sample
gives the latent axes. The labelled vectors are broadcast (their number is a parameter);
every document's vector is multiplied with all of them in blocks, and the ``k`` most
similar labels vote with their cosines as weights.
"""

from __future__ import annotations

from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_texts, table
from .language_id import chunks

BITS, LEVELS, SHARES = 12, 8, 7
TERMS = (1 << BITS) + LEVELS * SHARES
SURFACE_WEIGHT = 0.35
_MUL = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.full(256, 3, np.int8)  # 0 lower or beyond ASCII, 1 capital, 2 digit, 3 symbol, 4 white space
_KIND[[*range(97, 123), *range(128, 256)]] = 0
_KIND[65:91], _KIND[48:58], _KIND[[*range(9, 14), 32]] = 1, 2, 4


class Space(NamedTuple):
    idf: np.ndarray  # by term
    axes: np.ndarray  # (TERMS, dimensions)
    vectors: np.ndarray  # (labelled texts, dimensions), unit length
    labels: np.ndarray  # 0 / 1
    k: int


def term_counts(texts: list[bytes]) -> np.ndarray:
    """(texts, TERMS): damped trigram counts, then surface levels."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, t in enumerate(texts):
        b = np.frombuffer(t, np.uint8)
        if len(b) >= 3:
            w = b.astype(np.uint64)
            h = (w[:-2] << np.uint64(16) | w[1:-1] << np.uint64(8) | w[2:]) * _MUL >> np.uint64(64 - BITS)
            out[i, : 1 << BITS] = np.log1p(np.bincount(h.astype(np.int64), minlength=1 << BITS))
        kinds = np.bincount(_KIND[b], minlength=5)[:5]
        n, words = max(len(b), 1), t.split()
        solid = max(n - kinds[4], 1)
        repeated = sum(map(eq, words, words[1:])) / max(len(words) - 1, 1)
        mean = solid / max(len(words), 1) / 20
        bare = sum(len(x) == 1 for x in words) / max(len(words), 1)
        shares = (kinds[1] / solid, kinds[2] / solid, kinds[3] / solid, repeated, mean, bare, min(1.0, len(words) / 64))
        for j, x in enumerate(shares):
            out[i, (1 << BITS) + j * LEVELS + min(LEVELS - 1, int(np.sqrt(min(x, 1.0)) * LEVELS))] = 1
    return out


def weighted(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    """Term vectors: trigrams of unit length beside the surface terms at SURFACE_WEIGHT each."""
    x = term_counts(texts) * idf
    grams = x[:, : 1 << BITS]
    grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
    x[:, 1 << BITS :] *= SURFACE_WEIGHT
    return x


def _unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit_space(texts: list[str], labels: list[int], dimensions: int = 64, k: int = 15, seed: int = 5) -> Space:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    counts = term_counts(raw)
    idf = np.ones(TERMS, np.float32)
    idf[: 1 << BITS] = np.log((1 + len(raw)) / (1 + (counts[:, : 1 << BITS] > 0).sum(axis=0))) + 0.1
    x = weighted(raw, idf)
    n = min(dimensions, *x.shape) if len(raw) else 1
    rng = np.random.default_rng(seed)
    basis = rng.normal(size=(TERMS, n + 10)).astype(np.float32)  # randomised range finder
    for _ in range(3):
        basis = np.linalg.qr(x.T @ (x @ basis))[0] if len(raw) else np.linalg.qr(basis)[0]
    _, _, v = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ v.T)[:, :n].astype(np.float32)
    return Space(idf, axes, _unit(x @ axes), np.asarray(labels, np.float32), k)


def vote(texts: list[str | None], space: Space, block: int = 512) -> np.ndarray:
    """Share of the similarity-weighted votes for label 1; the labels' mean where no
    neighbour is similar, 0.5 where nothing was learned. Of neighbours that tie at the k-th
    place the ones learned first vote, so equal texts get equal scores."""
    out = np.full(len(texts), float(space.labels.mean()) if len(space.labels) else 0.5)
    if not len(space.labels):
        return out
    k = min(space.k, len(space.labels))
    for s in range(0, len(texts), block):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[s : s + block]]
        similar = _unit(weighted(raw, space.idf) @ space.axes) @ space.vectors.T
        near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(similar, near, axis=1).min(axis=1)
        for i in np.flatnonzero((similar >= least[:, None]).sum(axis=1) > k):  # ties at the k-th place
            near[i] = np.argsort(-similar[i], kind="stable")[:k]
        weight = np.maximum(np.take_along_axis(similar, near, axis=1), 0)
        total = weight.sum(axis=1)
        votes = (weight * space.labels[near]).sum(axis=1) / np.maximum(total, 1e-9)
        out[s : s + block] = np.where(total > 1e-9, votes, out[s : s + block])
    return np.clip(out, 0, 1)


FOLDS, FOLD = 4, 2


def fit(docs: DataFrame, labels: DataFrame, docs_per_class: int = 1000) -> Space:
    """labels: doc_id, quality; rows of the held-out fold or without a label teach nothing."""
    rows = labelled_texts(docs, labels, "quality", FOLDS, FOLD, docs_per_class)
    return fit_space(rows["text"].tolist(), rows["label"].tolist())


def score_documents(docs: DataFrame, space: Space, cut_at: float = 0.7) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 from ``cut_at`` on).

    Null and empty texts are scored as the empty text; rows that repeat stay."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in chunks(texts):
                score = vote(texts[part], shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(score), pa.array((score >= cut_at).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", "predicted")
