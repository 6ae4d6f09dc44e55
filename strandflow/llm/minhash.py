"""Near-duplicates by b-bit MinHash: bands of minima propose pairs, packed low bits weigh them.

Of a text's set of word shingles 128 random orders each keep the least hash. Two sets agree in one
of these minima with the probability of their Jaccard similarity J, so 32 bands of four minima
put two texts at 0.85 into a common list with a probability of 1 - 5e-11. Of the minima themselves only the
low four bits stay, packed into 64 bytes: two of them agree by chance once in 16, so
J is estimated as (agreeing / 128 - 1/16) / (1 - 1/16), and counting agreeing minima is an
exclusive or and a bit count. A pair goes no further if its estimate is so low that a
pair at the wanted similarity would be that low once in 1e10 times, or if its sets' sizes, or the
parities of the shingles that fall on each of 512 bits, rule it out for certain; all others are confirmed on
the full shingle sets.

Texts of one shingle set are one group from the start. In the lists, every text first meets one
other; lists whose rows are joined by then are done with, and in the others pairs are tried with the first
row, with near ones, then with all (the rounds of similar_text.py, which also deals lists
longer than a block to several tasks), so large families of copies need few pairs and
no candidate is left out.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, join_ids, table, told_apart
from .components import components
from .similar_text import ROUNDS, candidate_links, cells, least_shared, mixed_lists, parities, posting_lists, some_texts, verified
from .simhash import shingle_hashes

#: Minima of a text, minima of a band, and low bits that are kept of each.
MINIMA, BAND, BITS = 128, 4, 4
#: How seldom a similar pair may have so low an estimate that it isn't confirmed.
MISS = 1e-10

_RNG = np.random.default_rng(20)
_ODD = _RNG.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, MINIMA, np.uint64)
_NIBBLES = np.uint64(0x1111111111111111)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least hash of each nonempty set in each of the orders, a row a set."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    hashes = np.concatenate(sets)
    out = np.empty((len(sets), MINIMA), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(MINIMA):
            out[:, i] = np.minimum.reduceat(hashes * _ODD[i] + _ADD[i], starts)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A hash of each band's minima and its place, a column a band."""
    bands = np.ascontiguousarray(least).reshape(len(least), -1, BAND)
    keys = [[xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(row)] for row in bands]
    return np.array(keys, np.uint64).reshape(len(least), -1)


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of each minimum, after mixing, 16 to a word."""
    with np.errstate(over="ignore"):
        mixed = (least ^ (least >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    low = (mixed >> np.uint64(60)).reshape(len(least), -1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima of packed rows a and b have equal low bits."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return MINIMA - np.bitwise_count(x & _NIBBLES).sum(axis=-1, dtype=np.int64)


def estimate(agree, by_chance: float = 2.0**-BITS):
    """The similarity that so many agreeing minima speak for, less what agrees by chance."""
    return (np.asarray(agree) / MINIMA - by_chance) / (1 - by_chance)


def least_estimate(similarity: float, miss: float = MISS) -> float:
    """The estimate that a pair of this similarity falls short of with a probability of at most ``miss``."""
    p = similarity + (1 - similarity) * 2.0**-BITS
    below = 0.0
    for agree in range(MINIMA + 1):
        below += math.comb(MINIMA, agree) * p**agree * (1 - p) ** (MINIMA - agree)
        if below > miss:
            return float(estimate(agree))
    return 1.0


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (size of the shingle set), f1 and f2 (a digest of it), signature (packed low bits), parity
    (on 512 bits) and bands; texts without words have an n of 0 and no bands."""

    def run(batches):
        for batch, texts in some_texts(batches, 1):
            sets = [np.unique(shingle_hashes(t, width)) for t in texts]
            live = [i for i, s in enumerate(sets) if len(s)]
            digests = np.array([[xxhash.xxh64_intdigest(s.tobytes(), seed) for seed in (1, 2)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            signature, bands = [b""] * len(sets), [[]] * len(sets)
            if live:
                least = minima([sets[i] for i in live])
                for i, low, keys in zip(live, packed(least), band_keys(least).view(np.int64), strict=True):
                    signature[i], bands[i] = low.tobytes(), keys
            parity = [parities(s, 9).tobytes() for s in sets]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(signature, pa.binary()), pa.array(parity, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "f1", "f2", "signature", "parity", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, f1 long, f2 long, signature binary, parity binary, bands array<long>")


def signature_bounds(similarity: float):
    """bounds(n, signatures, parity) -> possible(a, b) for candidate_links()."""
    num, den = Fraction(str(similarity)).as_integer_ratio()
    floor = least_estimate(similarity)

    def bounds(n, signatures, parity):
        def possible(a, b):
            keep = den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])
            near = np.flatnonzero(keep)
            keep[near] = estimate(agreeing(signatures[a[near]], signatures[b[near]])) >= floor
            near = np.flatnonzero(keep)
            total = n[a[near]] + n[b[near]]
            spare = total - 2 * least_shared(total.astype(float), similarity / (1 + similarity))
            keep[near] = np.bitwise_count(parity[a[near]] ^ parity[b[near]]).sum(axis=1, dtype=np.int64) <= spare
            return keep

        return possible

    return bounds


def set_roots(docs: DataFrame, groups: DataFrame, width: int, similarity: float, block: int) -> DataFrame:
    """node, root of the representatives in groups(rep, n, signature, parity, bands) that are similar to a smaller one."""
    lists = cut(posting_lists(groups.select("rep", "n", F.col("bands").alias("prefix"))))
    signatures = groups.select("rep", "signature", "parity")
    bounds = signature_bounds(similarity)
    good = roots = None
    for one, span in ((True, None), (False, None), *((False, s) for s in ROUNDS)):
        lists = cut(mixed_lists(lists, roots)) if roots is not None else lists.withColumn("root", F.col("rep"))
        if not lists.take(1):
            break
        ids = cut(lists.select("rep").distinct())
        dealt = cells(lists.join(join_ids(signatures, ids, "rep", "inner"), "rep"), block, "root", "n", "signature", "parity")
        links = candidate_links(dealt, bounds, span)
        links = cut(links.groupBy("b").agg(F.min("a").alias("a")).select("a", "b") if one else links)
        if links.take(1):
            found = verified(docs, links, width, similarity)
            good = cut(found if good is None else good.unionByName(found))
            roots = components(good)
    if roots is None:
        return groups.select(F.col("rep").alias("node"), F.col("rep").alias("root")).limit(0)
    return roots


def minhash_groups(docs: DataFrame, width: int = 5, similarity: float = 0.85, block: int = 8192) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Rows whose shingle sets have at least this Jaccard similarity are linked; component_id is the smallest id
    of all rows that links lead to, and the row that has it is kept. Null, empty and blank texts
    have no shingles and link with nothing; a text of fewer words than a shingle is its own shingle. Where ids are
    null or repeated each row is told apart, null ids come last, and one row of a component is kept.
    An empty table gives no rows."""
    docs, own = told_apart(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = cut(sketches(docs, width))
    first = [F.first(c).alias(c) for c in ("n", "signature", "parity", "bands")]
    groups = cut(rows.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), *first))
    roots = set_roots(docs, groups, width, similarity, block)
    named = groups.join(roots, groups.rep == roots.node, "left").select("f1", "f2", "size", F.coalesce("root", "rep").alias("root"))
    found = attach(rows.where("n > 0").select("doc_id", "n", "f1", "f2"), cut(named), ["f1", "f2"], "size").select("doc_id", "n", "root")
    found = found.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("root")))
    found = found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("root").alias("component_id"))
    found = found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if own is None:
        return found
    ids = cut(docs.select("doc_id", own))
    found = cut(found).join(ids, "doc_id").drop("doc_id").withColumnRenamed(own, "doc_id")
    at_root = ids.select(F.col("doc_id").alias("component_id"), F.col(own).alias("root_id"))
    return found.join(at_root, "component_id").select("doc_id", "n_shingles", F.col("root_id").alias("component_id"), "kept")


def op13_minhash(spark, sf_dir: str) -> DataFrame:
    return minhash_groups(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
shingles AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s
  FROM split WHERE len(w) > 0
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
),
near AS MATERIALIZED (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
),
links AS MATERIALIZED (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach AS (
  SELECT DISTINCT x AS doc_id, x AS other FROM links
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
