"""Greedy plans over sequence lengths: groups, packs and shards.

Each is order dependent by definition, so it is an ordered fold. Only names and lengths
pass through the fold, batch by batch, with constant state; no bases do.
"""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import adaptive_core, window_cost
from .annotation import running_total
from .components import cut


def group_plan(lengths: DataFrame, target: int = 51_200_000, chunk: int = 640_000, factor: int = 1, flank: int = 0) -> DataFrame:
    """lengths(name, length) -> name, length, core, cost, group (from 0 inside its core size).

    In the order of length and name, a group closes when the next sequence would take its
    cost over the target; a sequence above the target makes a group of its own. Core sizes
    are folded apart."""
    core = adaptive_core(F.col("length"), chunk, factor)
    rows = lengths.select("name", F.col("length").cast("long").alias("length"), core.alias("core"))
    rows = rows.withColumn("cost", window_cost(F.col("length"), F.col("core"), flank))

    def fold(batches):
        core, total, group = None, 0, -1
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if r.core != core:
                    core, total, group = r.core, 0, 0
                elif total + r.cost > target:
                    total, group = 0, group + 1
                total += r.cost
                out.append(group)
            yield pdf.assign(group=out)

    kind = dict(rows.dtypes)["name"]
    dealt = rows.repartition("core").sortWithinPartitions("core", "length", "name")
    return dealt.mapInPandas(fold, f"name {kind}, length long, core long, cost long, group long")


def pack(lengths: DataFrame, threshold: int, spacer: int = 100, target: int = 640_000, prefix: str = "packed_scaffold_") -> DataFrame:
    """lengths(ord, name, length) -> packed_name, original_name, packed_start, packed_end, length.

    In input order: a sequence of at least ``threshold`` closes the open pack and stays by
    itself under its own name; a short one joins it, after a spacer, unless the pack would
    exceed the target, which closes it first. Names of packs that inputs already have get
    a suffix.

    Packs never go beyond a long sequence, so the stretches of short ones between these are folded
    apart, and their packs are numbered on from one another; only a stretch depends on one task."""
    rows = lengths.select("ord", "name", F.col("length").cast("long").alias("length"))
    rows = running_total(rows.withColumn("_long", (F.col("length") >= threshold).cast("long")), ["ord"], "_long", "_stretch")
    native = rows.where("_long = 1").select("ord", F.col("name").alias("packed_name"), F.col("name").alias("original_name"), F.lit(1).cast("long").alias("packed_start"), F.col("length").alias("packed_end"), "length")
    kinds = dict(rows.dtypes)

    def fold(batches):
        stretch, number, at = None, 0, 0
        for pdf in batches:
            out = []
            for ord_, s, name, n in zip(pdf["ord"], pdf["_stretch"], pdf["name"], pdf["length"], strict=True):
                if s != stretch:
                    stretch, number, at = s, 0, 0
                if not number or at + spacer + n > target:
                    number, at = number + 1, 0
                start = at + spacer + 1 if at else 1
                at = start + n - 1
                out.append((ord_, s, number, name, start, at, n))
            yield pd.DataFrame(out, columns=["ord", "_stretch", "_pack", "original_name", "packed_start", "packed_end", "length"])

    dealt = rows.where("_long = 0").repartition("_stretch").sortWithinPartitions("_stretch", "ord")
    short = cut(dealt.mapInPandas(fold, f"ord {kinds['ord']}, _stretch long, _pack long, original_name {kinds['name']}, packed_start long, packed_end long, length long"))
    first = running_total(short.groupBy("_stretch").agg(F.max("_pack").alias("_packs")), ["_stretch"], "_packs", "_before")
    short = short.join(first.select("_stretch", "_before"), "_stretch")
    short = short.withColumn("_base", F.concat(F.lit(prefix), F.format_string("%06d", F.col("_before") + F.col("_pack"))))
    # the suffixes that inputs' names have taken of each base; a base itself counts as the first
    pattern = f"^({re.escape(prefix)}\\d+)(?:_([2-9]|[1-9]\\d+))?$"
    parsed = [F.regexp_extract("name", pattern, k).alias(c) for k, c in ((1, "_base"), (2, "_n"))]
    taken = lengths.where(F.col("name").startswith(prefix)).select(*parsed).where("_base <> ''")
    taken = taken.select("_base", F.coalesce(F.expr("try_cast(_n AS INT)"), F.lit(1)).alias("_n"))
    taken = taken.groupBy("_base").agg(F.collect_set("_n").alias("_used"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("_used") + 1), "_used"))
    again = F.when(F.array_contains("_used", 1), free)
    name = F.when(again.isNull(), F.col("_base")).otherwise(F.concat("_base", F.lit("_"), again.cast("string")))
    short = short.join(taken, "_base", "left").select("ord", name.alias("packed_name"), "original_name", "packed_start", "packed_end", "length")
    return native.unionByName(short).orderBy("ord").drop("ord")


def pack_sequences(seqs: DataFrame, segments: DataFrame, spacer: int = 100) -> DataFrame:
    """The packed sequences themselves: packed_name, seq, members joined by N spacers in order."""
    placed = seqs.select(F.col("seq_name").alias("original_name"), "seq").join(segments, "original_name")
    members = F.array_sort(F.collect_list(F.struct("packed_start", "seq")))
    return placed.groupBy("packed_name").agg(F.array_join(F.transform(members, lambda x: x["seq"]), "N" * spacer).alias("seq"))


def packing_summary(segments: DataFrame, seqs: DataFrame) -> DataFrame:
    """One row: packs, packed members and bases, and what stays native."""
    packed = F.col("packed_name") != F.col("original_name")
    return segments.agg(
        F.count_distinct(F.when(packed, F.col("packed_name"))).alias("packs"), F.count_if(packed).alias("members"),
        F.coalesce(F.sum(F.when(packed, F.col("length"))), F.lit(0)).cast("long").alias("packed_bases"),
        F.count_if(~packed).alias("native"), F.coalesce(F.sum(F.when(~packed, F.col("length"))), F.lit(0)).cast("long").alias("native_bases"),
    )


def shard_balance(lengths: DataFrame, shards: int) -> DataFrame:
    """lengths(ord, name, length) -> with shard: each goes, in order, to the shard with the
    fewest bases, then records, then the lowest number."""

    def fold(batches):
        heap = [(0, 0, i) for i in range(shards)]
        for pdf in batches:
            out = []
            for n in pdf["length"]:
                bases, records, i = heap[0]
                heapq.heapreplace(heap, (bases + int(n), records + 1, i))
                out.append(i)
            yield pdf.assign(shard=out)

    kind = dict(lengths.dtypes)["name"]
    ordered = lengths.select(F.col("ord").cast("long").alias("ord"), "name", F.col("length").cast("long").alias("length")).coalesce(1).sortWithinPartitions("ord")
    return ordered.mapInPandas(fold, f"ord long, name {kind}, length long, shard long")
