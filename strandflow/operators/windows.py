"""Windows over positions, with flanks and padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from .annotation import global_numbers


def sequence_windows(seqs: DataFrame, core: int, flank: int = 0, pad: bool = True) -> DataFrame:
    """Tile sequences(seq_name, seq): seq_name, strand '+', win_idx, core_start, core_end, bases.

    Each window has core + 2 * flank bases, filled with N outside the sequence; coordinates
    are clipped to it. An empty sequence has one window, 1 to 0. pad=False leaves out the
    incomplete last window. A long sequence is cut where it is read, without a shuffle."""
    n = F.length("seq")
    count = F.greatest(F.lit(1), F.ceil(n / core)) if pad else F.floor(n / core)
    index = F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    tiles = seqs.select("seq_name", "seq", n.alias("_n"), F.explode(index).alias("win_idx"))
    first = F.col("win_idx") * core + 1 - flank
    head = F.greatest(F.lit(0), 1 - first)
    body = F.substring("seq", F.greatest(first, F.lit(1)), core + 2 * flank - head)
    bases = F.rpad(F.concat(F.repeat(F.lit("N"), head.cast("int")), body), core + 2 * flank, "N")
    return tiles.select(
        "seq_name", F.lit("+").alias("strand"), "win_idx", (F.col("win_idx") * core + 1).cast("long").alias("core_start"),
        F.least(F.col("_n"), (F.col("win_idx") + 1) * core).cast("long").alias("core_end"), bases.alias("bases"),
    )


def both_strands(windows: DataFrame) -> DataFrame:
    """The plus windows and their reverse complements, over the same tiles."""
    minus = windows.withColumn("strand", F.lit("-")).withColumn("bases", reverse_complement(F.col("bases")))
    return windows.unionByName(minus)


def has_signal(values: DataFrame, keys: list[str], value: str, width: int = 200, least: float = 0.8) -> DataFrame:
    """keys, best, keep: the best mean over complete frames of ``width`` positions (the plain
    mean of a shorter window) and whether it reaches ``least``."""
    order = Window.partitionBy(*keys).orderBy("pos")
    frame = order.rowsBetween(-(width - 1), 0)
    mean, full = F.avg(value).over(frame), F.count(value).over(frame) == width
    rows = values.select(*keys, value, F.when(full, mean).alias("_mean"))
    best = F.coalesce(F.max("_mean"), F.avg(value))
    return rows.groupBy(*keys).agg(best.alias("best")).withColumn("keep", F.coalesce(F.col("best") >= least, F.lit(False)))


def genic_regions(values: DataFrame, keys: list[str], value: str, step: int = 50, mean: float = 0.1, above: float = 0.5, least: int = 50) -> DataFrame:
    """Regions of likely genes over positions from 0: keys, start, end (half-open).

    Runs of ``step``-wide buckets whose mean reaches ``mean``, kept if ``least`` of their
    values exceed ``above``. The bucket that closes a run belongs to it."""
    bucket = values.withColumn("_b", F.floor(F.col("pos") / step)).groupBy(*keys, "_b").agg(
        F.avg(value).alias("_mean"), F.count_if(F.col(value) > above).alias("_high"), F.max("pos").alias("_last")
    )
    order = Window.partitionBy(*keys).orderBy("_b")
    on = F.col("_mean") >= mean
    # a bucket below the mean ends the run before it and is counted with it
    flagged = bucket.withColumn("_on", on).withColumn("_run", F.coalesce(F.sum((~on).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    region = flagged.groupBy(*keys, "_run").agg(F.min("_b").alias("_b"), F.max("_last").alias("_last"), F.sum("_high").alias("_high"), F.bool_or("_on").alias("_any"))
    return region.where(F.col("_any") & (F.col("_high") >= least)).select(*keys, (F.col("_b") * step).alias("start"), (F.col("_last") + 1).alias("end"))


def balanced_slices(items: DataFrame, order: list[str], workers: int, size: int) -> DataFrame:
    """Add task: contiguous slices in order, as many as whole waves of workers need."""
    n = items.count()
    waves = max(1, -(-n // max(workers * size, 1)))
    tasks = max(1, min(n, workers * waves))
    ranked = global_numbers(items, order, "_rank").withColumn("_rank", F.col("_rank") - 1)
    return ranked.withColumn("task", F.floor((F.col("_rank") * tasks + tasks - 1) / max(n, 1)).cast("long")).drop("_rank")
