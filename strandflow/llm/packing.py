"""Packing into optimal length buckets.

The global histogram of document lengths (in words) has at most ``budget`` + 1 entries,
however many documents there are. A dynamic program over it chooses the upper lengths of
``n_buckets`` buckets that minimise the padding when every document is padded to its
bucket's length. Inside a bucket, batches take budget // length documents each, so a
padded batch never exceeds the token budget. A document longer than the budget makes an
unpadded batch of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one numbering task sees, by which shards of a bucket are counted.
SHARD_ROWS = 50_000


def optimal_buckets(lengths, counts, n_buckets: int) -> list[int]:
    """Upper lengths of at most n_buckets buckets with the least total padding.

    best(k, j), the least padding of the first j lengths in k buckets, is the lower
    envelope of one line per last cut; lengths ascend, so each layer is one sweep."""
    lengths, counts = [int(x) for x in lengths], [int(x) for x in counts]
    n = len(lengths)
    if not n:
        return []
    docs = [0, *np.cumsum(counts, dtype=object).tolist()]
    words = [0, *np.cumsum([a * b for a, b in zip(lengths, counts, strict=True)], dtype=object).tolist()]
    layer = [0] + [lengths[j - 1] * docs[j] - words[j] for j in range(1, n + 1)]
    cuts = [[0] * (n + 1)]
    for _ in range(1, min(n_buckets, n)):
        nxt, cut_at, hull, head = [0] * (n + 1), [0] * (n + 1), [], 0

        def value(i, x, layer=layer):
            return layer[i] + words[i] - x * docs[i]

        for j in range(1, n + 1):
            i = j - 1  # a new line of slope -docs[i], steeper than all before
            b = layer[i] + words[i]
            while len(hull) - head >= 2:
                (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                if (b - b1) * (m2 - m1) <= (b2 - b1) * (docs[i] - m1):
                    hull.pop()
                else:
                    break
            hull.append((docs[i], b, i))
            x = lengths[j - 1]
            while len(hull) - head >= 2 and value(hull[head + 1][2], x) <= value(hull[head][2], x):
                head += 1
            best = hull[head][2]
            nxt[j] = value(best, x) + x * docs[j] - words[j]
            cut_at[j] = best
        layer, cuts = nxt, [*cuts, cut_at]
    out, j = [], n
    for cut_at in reversed(cuts):
        if j <= 0:
            break
        out.append(lengths[j - 1])
        j = cut_at[j]
    return sorted(set(out))


def word_lengths(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens: words of the whole text; 0 for null, empty and blank texts."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n_tokens"))


def pack(rows: DataFrame, budget: int = 16_384, n_buckets: int = 16) -> DataFrame:
    """rows(doc_id, n_tokens), materialised -> one row each: doc_id, n_tokens, bucket,
    padded_to, batch (from 0 inside its bucket), slot (from 0 inside its batch).

    Bucket numbers ascend with length; oversized documents have the last, one above the
    others. Ranks run by (shard, length, id): shards are hash-dealt so that a bucket with
    most of the rows is numbered by many tasks, and their offsets are added up. Every
    batch of a bucket but its last is full. Empty texts count as length 0. Repeated rows
    take a slot each. An empty table gives no rows."""
    histogram = rows.where(F.col("n_tokens") <= budget).groupBy("n_tokens").count().orderBy("n_tokens").collect()
    tops = optimal_buckets([r["n_tokens"] for r in histogram], [r["count"] for r in histogram], n_buckets)
    bucket, padded = F.lit(len(tops)), F.col("n_tokens")
    for k in reversed(range(len(tops))):
        fits = F.col("n_tokens") <= tops[k]
        bucket, padded = F.when(fits, F.lit(k)).otherwise(bucket), F.when(fits, F.lit(tops[k])).otherwise(padded)
    shards = rows.count() // SHARD_ROWS + 1
    placed = rows.select("doc_id", "n_tokens", bucket.cast("int").alias("bucket"), padded.cast("long").alias("padded_to"))
    unnamed = F.when(F.col("doc_id").isNull(), F.spark_partition_id())  # rows without an id are dealt by where they lie
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", unnamed), F.lit(shards)))
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sizes.select("bucket", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("bucket", "shard").orderBy("n_tokens", "doc_id")
    ranked = placed.withColumn("nth", F.row_number().over(inside)).join(offsets, ["bucket", "shard"])
    rank = F.col("offset") + F.col("nth") - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_to"), F.lit(1)))).cast("long")
    return ranked.withColumn("rank", rank).withColumn("room", room).select(
        "doc_id", "n_tokens", "bucket", "padded_to",
        F.floor(F.col("rank") / F.col("room")).cast("long").alias("batch"), (F.col("rank") % F.col("room")).alias("slot"),
    )


def pack_documents(docs: DataFrame, budget: int = 16_384, n_buckets: int = 16) -> DataFrame:
    """One row per document as in pack(). Null, empty and blank texts have length 0, rows that
    repeat or lack an id take a slot each, texts beyond the budget are batches of one, and an
    empty table gives no rows."""
    return pack(cut(word_lengths(docs)), budget, n_buckets)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
