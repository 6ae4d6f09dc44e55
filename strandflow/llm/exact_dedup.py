"""Exact dedup of an incoming batch against an immutable snapshot.

Static binary-fuse filters, one a digest bucket of the snapshot, screen the distinct
digests of the batch. Digests the filters let through are joined to the snapshot's
exact buckets, and the texts behind each match are compared byte for byte. Duplicates
inside the batch are grouped on their own, by digest, before any of this, so a text
that makes up a third of all rows is one row from the first aggregation on.

Texts are equal when they are the same bytes after each run of ASCII white space has
become one blank; a null text counts as empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, attach, by_row, cut, join_ids, table

#: Distinct digests a bucket, by which the number of buckets is chosen.
BUCKET_ROWS = 50_000
FILTER = "bucket long, seed long, segment long, cells binary"


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, seeded."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def _cells(keys: np.ndarray, seed: int, segment: int, n_cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The three cells of each key, in consecutive segments, and its 8-bit fingerprint."""
    h = _mix(keys, seed)
    starts = n_cells - 2 * segment
    first = ((h >> np.uint64(32)) * np.uint64(starts) >> np.uint64(32)).astype(np.int64)
    mask = np.uint64(segment - 1)
    second = (first + segment) ^ (h >> np.uint64(18) & mask).astype(np.int64)
    third = (first + 2 * segment) ^ (h & mask).astype(np.int64)
    return np.stack([first, second, third]), (_mix(h, 7) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray, seed: int = 1) -> tuple[int, int, bytes]:
    """A 3-wise binary-fuse filter over distinct 64-bit keys: (seed, segment, cells).

    Cells are peeled in rounds; all keys that are alone in some cell leave together, and
    cells are filled from the last round to the first. A seed whose keys don't peel is
    followed by the next one."""
    n = len(keys)
    segment = 4 if n < 2 else 1 << min(18, int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
    size = int(np.floor(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))))
    n_cells = segment * (max(1, -(-size // segment) - 2) + 2)
    while True:
        at, prints = _cells(keys, seed, segment, n_cells)
        count = np.bincount(at.ravel(), minlength=n_cells)
        owner = np.zeros(n_cells, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        order, left, alone = [], n, np.flatnonzero(count == 1)
        while len(alone):
            key, where = np.unique(owner[alone], return_index=True)
            order.append((key, alone[where]))
            left -= len(key)
            touched = at[:, key]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, key)
            alone = np.unique(touched)
            alone = alone[count[alone] == 1]
        if not left:
            break
        seed += 1
    cells = np.zeros(n_cells, np.uint8)
    for key, cell in reversed(order):
        a, b, c = cells[at[:, key]]
        cells[cell] = prints[key] ^ a ^ b ^ c
    return seed, segment, cells.tobytes()


def in_filter(keys: np.ndarray, seed: int, segment: int, cells: bytes) -> np.ndarray:
    table_ = np.frombuffer(cells, np.uint8)
    at, prints = _cells(keys, seed, segment, len(table_))
    a, b, c = table_[at]
    return (a ^ b ^ c) == prints


def _body():
    return F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ")


def _digest(body):
    return F.unhex(F.sha2(body.cast("binary"), 256))


def batch_groups(rows: DataFrame, n_buckets: int) -> DataFrame:
    """One row a digest: bucket, key (its first 64 bits), rep (smallest doc_id), size."""
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    key = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    return groups.withColumn("key", key).withColumn("bucket", F.col("key") % n_buckets)


def snapshot_filters(snapshot: DataFrame) -> DataFrame:
    """The static filters of a snapshot's digest groups, one a bucket."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(pdf["key"].to_numpy(np.int64)).view(np.uint64)
        return pd.DataFrame([(pdf["bucket"].iloc[0], *build_filter(keys))], columns=["bucket", "seed", "segment", "cells"])

    return snapshot.select("bucket", "key").groupBy("bucket").applyInPandas(build, FILTER)


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The incoming digest groups that the filters of their buckets let through."""
    columns = ["digest", "key", "bucket", "rep"]

    def test(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or found.empty:
            return rows.iloc[:0][columns]
        f = found.iloc[0]
        keys = rows["key"].to_numpy(np.int64).view(np.uint64)
        return rows[in_filter(keys, int(f["seed"]), int(f["segment"]), f["cells"])][columns]

    pairs = incoming.select(columns).groupBy("bucket").cogroup(filters.groupBy("bucket"))
    return pairs.applyInPandas(test, "digest binary, key long, bucket long, rep long")


def same_bytes(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """digest of the pairs (digest, rep, kept_rep) whose two normalised texts are the same bytes."""
    ids = cut(pairs.select(F.explode(F.array("rep", "kept_rep")).alias("doc_id"), "digest").distinct())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = join_ids(own, ids, "doc_id", "inner").select("digest", _body().alias("body"))
    texts = texts.where(_digest(F.col("body")) == F.col("digest"))  # a doc_id may have further rows
    return texts.groupBy("digest").agg((F.min("body") == F.max("body")).alias("same")).where("same").select("digest")


def dedup_batch(docs: DataFrame, in_snapshot) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    in_snapshot: a column that says which rows of docs form the immutable snapshot; the
    others, and those where it is null, are the new batch. Of equal texts the row with the
    smallest doc_id is kept, on whichever side it is. Rows that repeat a doc_id give a row
    each and share its fate. A row without an id is kept only where no equal text has one.
    An empty snapshot, batch or table is allowed. Should two different texts ever share a
    digest across the sides, the byte check keeps both."""
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), _digest(_body()).alias("digest"),
            F.coalesce(in_snapshot, F.lit(False)).alias("old"),
        )
    )
    n_buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    old = cut(batch_groups(rows.where("old"), n_buckets))
    new = cut(batch_groups(rows.where("not old"), n_buckets))
    positives = screen(new, snapshot_filters(old))
    exact = positives.join(old.select("bucket", "digest", F.col("rep").alias("kept_rep")), ["bucket", "digest"])
    matched = same_bytes(docs, cut(exact.select("digest", "rep", "kept_rep"))).withColumn("same", F.lit(True))
    none = F.lit(None).cast("long")
    sides = old.select("digest", F.col("rep").alias("old_rep"), F.col("size").alias("old_size"), none.alias("new_rep"), none.alias("new_size"))
    sides = sides.unionByName(
        new.select("digest", none.alias("old_rep"), none.alias("old_size"), F.col("rep").alias("new_rep"), F.col("size").alias("new_size"))
    )
    sides = sides.groupBy("digest").agg(*[F.max(c).alias(c) for c in ("old_rep", "old_size", "new_rep", "new_size")])
    sides = sides.join(matched, "digest", "left").withColumn(
        "rows", F.coalesce("old_size", F.lit(0)) + F.coalesce("new_size", F.lit(0))
    )
    both = attach(rows, cut(sides), "digest", "rows")
    joined, mine = F.coalesce("same", F.lit(False)), lambda kind: F.when(F.col("old"), F.col(f"old_{kind}")).otherwise(F.col(f"new_{kind}"))
    out = both.select(
        "doc_id", "digest",
        F.when(joined, F.least("old_rep", "new_rep")).otherwise(mine("rep")).alias("keep_id"),
        F.when(joined, F.col("rows")).otherwise(mine("size")).alias("group_size"),
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def half(doc_id):
    """The rows that the queries treat as the immutable snapshot: about half, by a hash of the id."""
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(2)) == 0


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each text, whatever the ids: of equal texts the row with the smallest
    doc_id stays, a row without an id only where no equal text has one, and of rows that tie
    one stays. Null and empty texts are equal. An empty table gives no rows."""

    def drop(rows: DataFrame) -> DataFrame:
        gone = cut(dedup_batch(rows, half(F.col("doc_id"))).where("not kept").select("doc_id").distinct())
        return join_ids(rows, gone, "doc_id", "left_anti").select(rows.columns)

    return by_row(docs, drop)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_batch(table(spark, sf_dir, "documents"), half(F.col("doc_id")))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
