"""Transcripts put together from their pieces: spliced bases, the strict coding filter, clipping.

Sequences are cut into windows once, and each piece meets only the windows it lies in, so no row
holds a chromosome and a chromosome's pieces are spread over its windows' tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as sq
from . import intervals
from .components import cut

#: Bases in a row while pieces are cut from them.
WIDTH = 1 << 16
#: Sequences whose lengths may be broadcast.
BROADCAST_LENGTHS = 1_000_000
TRANSCRIPT = ["seq_name", "tx", "strand"]


def base_windows(sequences: DataFrame, width: int = WIDTH) -> DataFrame:
    """sequences(seq_name, seq) -> seq_name, bin, bases, in one walk along each sequence."""
    parts = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{width}}}"), 0)
    return sequences.select("seq_name", F.posexplode(parts).alias("bin", "bases"))


def spliced_cds(pieces: DataFrame, sequences: DataFrame, width: int = WIDTH) -> DataFrame:
    """pieces(seq_name, tx, strand, start, end; from 1, inclusive) and sequences(seq_name, seq) ->
    seq_name, tx, strand, n_pieces, n_bases, cds, complete.

    cds holds the pieces' bases in the direction of the transcript. Repeated pieces count once;
    pieces that end before they start count for nothing. A transcript isn't complete if its
    sequence is unknown or a piece lies partly outside of it; cds is then what there is."""
    start, end = F.col("start"), F.col("end")
    first = F.floor((F.greatest(start, F.lit(1)) - 1) / width)
    last = F.greatest(first, F.floor((end - 1) / width))
    parts = pieces.where("end >= start").select(*TRANSCRIPT, start.cast("long"), end.cast("long"), F.explode(F.sequence(first, last)).alias("bin"))
    at = F.greatest(start - F.col("bin") * width, F.lit(1))
    n = F.greatest(F.least(end - F.col("bin") * width, F.lit(width)) - at + 1, F.lit(0))
    pieced = parts.join(base_windows(sequences, width), ["seq_name", "bin"], "left").select(
        *TRANSCRIPT, F.struct("start", "end", "bin", n.alias("n"), F.col("bases").substr(at.cast("int"), n.cast("int")).alias("bases")).alias("part")
    )
    whole = pieced.groupBy(*TRANSCRIPT).agg(F.array_sort(F.collect_set("part")).alias("parts"))
    field = lambda name: F.transform("parts", lambda p: p[name])
    bases = sq.oriented(F.array_join(field("bases"), ""), F.col("strand"))
    n_pieces = F.size(F.array_distinct(F.transform("parts", lambda p: F.struct(p["start"], p["end"]))))
    n_bases = F.aggregate(field("n"), F.lit(0).cast("long"), lambda a, b: a + b)
    out = whole.select(*TRANSCRIPT, n_pieces.cast("long").alias("n_pieces"), n_bases.alias("n_bases"), bases.alias("cds"), F.array_min(field("start")).alias("least"))
    return out.withColumn("complete", (F.col("least") >= 1) & (F.length("cds") == F.col("n_bases"))).drop("least")


def strict_transcripts(pieces: DataFrame, sequences: DataFrame, mode: str = "strict", least: int = 61) -> DataFrame:
    """seq_name, tx, strand of the transcripts to keep: all of them in the mode none; in the mode
    strict those whose whole CDS lies in a known sequence and passes the strict coding test."""
    if mode == "none":
        return pieces.select(*TRANSCRIPT).distinct()
    if mode != "strict":
        raise ValueError(f"unknown filter mode {mode!r}: none or strict")
    return spliced_cds(pieces, sequences).where(F.col("complete") & sq.is_complete_coding(F.col("cds"), least)).select(*TRANSCRIPT)


def least_coding(pieces: DataFrame, least: int = 201) -> DataFrame:
    """seq_name, tx, strand of the transcripts whose pieces have so many bases together."""
    return pieces.groupBy(*TRANSCRIPT).agg(F.sum(F.col("end") - F.col("start") + 1).alias("n")).where(F.col("n") >= least).select(*TRANSCRIPT)


def with_pieces(features: DataFrame) -> DataFrame:
    """features(tx, type, ...) without the transcripts that have neither a CDS nor an exon."""
    return features.join(features.where(F.col("type").isin("CDS", "exon")).select("tx"), "tx", "left_semi")


def clip_features(features: DataFrame, lengths: DataFrame) -> DataFrame:
    """features(seq_name, tx, type, start, end, ...) cut to their sequences, without emptied ones and
    without transcripts left with neither a CDS nor an exon. An unknown length cuts nothing. Features don't move
    to their sequence's length while lengths can be broadcast, so few long sequences don't make few large tasks."""
    sizes = cut(lengths.select("seq_name", F.col("length").alias("_length")))
    known = features.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_LENGTHS else sizes, "seq_name", "left")
    return with_pieces(intervals.clip(known, "_length").drop("_length"))
