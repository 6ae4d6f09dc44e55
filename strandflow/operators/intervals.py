"""Interval and run-length operators: gaps and islands over positions.

Positions are 1-based and closed. Merging is associative, so the operators that merge
work in two steps: inside position bins first, then over the bins' islands, so one
sequence with most of the rows is first merged by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions a bin spans in the first step.
BIN = 1 << 20
#: Rows that one task sorts, about; more rows make more tasks.
TASK_ROWS = 500_000


def tasks(df: DataFrame) -> int:
    """Among how many tasks df's rows are dealt, so that what one of them holds doesn't grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // TASK_ROWS)


def _islands(df: DataFrame, keys: list[str], gap: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col("start") > reach + gap)).cast("int")
    marked = df.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_island")


def merge_touching(df: DataFrame, keys: list[str], gap: int = 1, bin_size: int = BIN) -> DataFrame:
    """Coalesce intervals that overlap or lie within ``gap`` of each other: keys, start, end, n.

    Input order doesn't matter. gap=1 joins neighbours, gap=0 only what shares a position."""
    rows, n = df.select(*keys, "start", "end", F.lit(1).cast("long").alias("n")), tasks(df)
    binned = rows.withColumn("_bin", F.floor(F.col("start") / bin_size)).repartition(n, *keys, "_bin")
    return _islands(_islands(binned, [*keys, "_bin"], gap).drop("_bin").repartition(n, *keys), keys, gap)


def merge_adjacent(df: DataFrame, keys: list[str], distinct: bool = False) -> DataFrame:
    """Join each interval to the previous one (by start, end) when it starts just after it; overlaps stay apart.
    With ``distinct`` equal intervals count once; they meet where they are merged, without a shuffle of their own."""
    rows = df.select(*keys, "start", "end").repartition(tasks(df), *keys)
    rows = rows.distinct() if distinct else rows
    order = Window.partitionBy(*keys).orderBy("start", "end")
    fresh = F.coalesce((F.col("start") != F.lag("end").over(order) + 1).cast("int"), F.lit(1))
    marked = rows.withColumn("_fresh", fresh)
    marked = marked.withColumn("_island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")


def _runs(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start")
    fresh = ~(F.lag(kind).over(order).eqNullSafe(F.col(kind)) & (F.lag("end").over(order) + 1 == F.col("start")))
    marked = df.withColumn("_fresh", F.coalesce(fresh, F.lit(True)).cast("int"))
    marked = marked.withColumn("_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run", kind).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def runs(path: DataFrame, keys: list[str], label: str, position: str = "pos", bin_size: int = BIN) -> DataFrame:
    """Run-length encode a path: keys, label, start, end. A gap in position ends a run."""
    one = path.select(*keys, label, F.col(position).alias("start"), F.col(position).alias("end"))
    binned = one.withColumn("_bin", F.floor(F.col("start") / bin_size))
    return _runs(_runs(binned, [*keys, "_bin"], label).drop("_bin"), keys, label)


def merge_runs(ranges: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Join touching ranges of one kind."""
    return _runs(ranges.select(*keys, kind, "start", "end"), keys, kind)


def clip(df: DataFrame, length: str) -> DataFrame:
    """Cut intervals to [1, length] and drop what is left empty; a null length leaves the row as it is."""
    known = F.col(length).isNotNull()
    cut = df.withColumn("start", F.when(known, F.greatest(F.col("start"), F.lit(1))).otherwise(F.col("start")))
    cut = cut.withColumn("end", F.when(known, F.least(F.col("end"), F.col(length))).otherwise(F.col("end")))
    return cut.where(F.col("start") <= F.col("end"))


def expand_merge(df: DataFrame, keys: list[str], length: str, buffer: int = 100) -> DataFrame:
    """Half-open regions grown by ``buffer`` within [0, length], merged where they touch."""
    grown = df.withColumn("start", F.greatest(F.lit(0), F.col("start") - buffer)).withColumn("end", F.least(F.col(length), F.col("end") + buffer))
    return merge_touching(grown.where(F.col("start") < F.col("end")), keys, gap=0).select(*keys, "start", "end")


def introns(exons: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps between consecutive exons; adjacent or overlapping ones have none."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    gap = exons.select(*keys, (F.col("end") + 1).alias("_from"), (F.lead("start").over(order) - 1).alias("_to"))
    return gap.where(F.col("_from") <= F.col("_to")).select(*keys, F.col("_from").alias("start"), F.col("_to").alias("end"))


def transcript_order(keys: list[str], strand: str = "strand"):
    """Window over a transcript's pieces in the direction of transcription."""
    sign = F.when(F.col(strand) == "-", -1).otherwise(1)
    return Window.partitionBy(*keys).orderBy(F.col("start") * sign, F.col("end") * sign)


def bases_before(keys: list[str], strand: str = "strand"):
    """Bases of the pieces transcribed before this one."""
    order = transcript_order(keys, strand).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(order), F.lit(0)).cast("long")


def cds_phase(cds: DataFrame, keys: list[str], strand: str = "strand") -> DataFrame:
    """Add phase: bases to skip to the next codon; the first piece always has 0."""
    return cds.withColumn("phase", F.pmod(-bases_before(keys, strand), F.lit(3)).cast("long"))


def cds_position(cds: DataFrame, keys: list[str], strand: str = "strand") -> DataFrame:
    """Add cds_type: single, initial, internal or terminal, by rank along the transcript."""
    nth, n = F.row_number().over(transcript_order(keys, strand)), F.count("*").over(Window.partitionBy(*keys))
    kind = F.when(n == 1, "single").when(nth == 1, "initial").when(nth == n, "terminal").otherwise("internal")
    return cds.withColumn("cds_type", kind)


def terminal_codon_rows(cds: DataFrame, keys: list[str], phase: str = "phase", strand: str = "strand") -> DataFrame:
    """Rows of start and stop codons along the spliced CDS: keys, strand, feature, start, end, phase.

    A codon is an interval on the spliced axis and may fall on several pieces. A start codon
    needs first phase 0; a stop codon needs whole codons after the first phase."""
    order, whole = transcript_order(keys, strand), Window.partitionBy(*keys)
    size = F.col("end") - F.col("start") + 1
    laid = cds.select(*keys, strand, "start", "end", bases_before(keys, strand).alias("_at"), F.sum(size).over(whole).alias("_total"), F.first(phase).over(order).cast("int").alias("_first"))
    start = F.when(F.col("_first") == 0, F.struct(F.lit("start_codon").alias("feature"), F.lit(0).cast("long").alias("a"), F.lit(3).cast("long").alias("b")))
    stop_ok = F.col("_first").isin(0, 1, 2) & ((F.col("_total") - F.col("_first")) % 3 == 0)
    stop = F.when(stop_ok, F.struct(F.lit("stop_codon").alias("feature"), (F.col("_total") - 3).alias("a"), F.col("_total").alias("b")))
    both = laid.where("_total >= 3").withColumn("_c", F.explode(F.filter(F.array(start, stop), lambda x: x.isNotNull())))
    left = F.greatest(F.col("_c.a"), F.col("_at"))
    right = F.least(F.col("_c.b"), F.col("_at") + F.col("end") - F.col("start") + 1)
    cut = both.withColumn("_l", left).withColumn("_r", right).where("_l < _r")
    minus = F.col(strand) == "-"
    return cut.select(
        *keys, strand, F.col("_c.feature").alias("feature"),
        F.when(minus, F.col("end") - (F.col("_r") - F.col("_at")) + 1).otherwise(F.col("start") + F.col("_l") - F.col("_at")).alias("start"),
        F.when(minus, F.col("end") - (F.col("_l") - F.col("_at"))).otherwise(F.col("start") + F.col("_r") - F.col("_at") - 1).alias("end"),
        F.pmod(F.col("_c.a") - F.col("_l"), F.lit(3)).cast("long").alias("phase"),
    )


def merge_stop_codons(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """pieces(keys, strand, start, end, phase, is_cds): the union of CDS and stop-codon rows;
    an island's phase is that of its first CDS piece in transcript direction, null if it has none."""
    order = Window.partitionBy(*keys, "strand").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("_fresh", (reach.isNull() | (F.col("start") > reach + 1)).cast("int"))
    marked = marked.withColumn("_island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.when(F.col("is_cds"), F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start")))
    out = marked.groupBy(*keys, "strand", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("phase", at).alias("phase"))
    return out.drop("_island")
