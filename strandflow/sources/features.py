"""Nine-column annotation files (GFF3, GTF) as DataFrame sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("seqid", "source", "feature", "start", "end", "score", "strand", "phase", "attributes")


def read_features(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The nine columns, with '.' as null in score and phase. Blank lines and comments are
    skipped; strict: a line without exactly nine columns is an error, else lines with fewer
    are skipped, further columns cut and start and end put in order."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    cells = lines.select(F.split("value", "\t").alias("c"), "value")
    if strict:
        bad = F.raise_error(F.concat(F.lit("not nine columns: "), F.col("value")))
        cells = cells.select(F.when(F.size("c") == 9, F.col("c")).otherwise(bad).alias("c"))
    else:
        cells = cells.where(F.size("c") >= 9)
    cols = {name: F.col("c")[i] for i, name in enumerate(COLUMNS)}
    a, b = cols["start"].cast("long"), cols["end"].cast("long")
    cols |= {"start": a, "end": b} if strict else {"start": F.least(a, b), "end": F.greatest(a, b)}
    cols |= {"score": F.nullif(cols["score"], F.lit(".")).cast("double"), "phase": F.nullif(cols["phase"], F.lit(".")).cast("int")}
    return cells.select(*[c.alias(n) for n, c in cols.items()])


def feature_lines(rows: DataFrame) -> DataFrame:
    """One tab-joined line per row; nulls are dots."""
    return rows.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in COLUMNS]).alias("line"))


def is_gff3(path: str) -> bool:
    name = path.lower().removesuffix(".gz")
    return name.endswith((".gff", ".gff3"))


def repeat_path(path: str) -> str:
    """The path of the repeat file beside an output: .repeat before its extension, .gz kept."""
    zipped = ".gz" if path.endswith(".gz") else ""
    stem = path.removesuffix(".gz")
    head, dot, ext = stem.rpartition(".")
    return (f"{head}.repeat.{ext}" if dot and "/" not in ext else f"{stem}.repeat.gff") + zipped


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Write lines in a total order, as range-sorted part files; GFF3 paths get their header
    in a first part of its own. .gz compresses."""
    key = [F.col(c) for c in order]
    body = lines.select("line", F.lit(1).alias("_head"), *key)
    if is_gff3(path):
        head = body.limit(0).sparkSession.range(1).select(F.lit("##gff-version 3").alias("line"), F.lit(0).alias("_head"))
        body = body.unionByName(head, allowMissingColumns=True)
    out = body.orderBy("_head", *order).select("line").write.mode("overwrite")
    (out.option("compression", "gzip") if path.endswith(".gz") else out).text(path)


def repeat_rows(runs: DataFrame) -> DataFrame:
    """Repeat runs (seq, start, end, strand) numbered r1, r2, ... in (seq, start, end, strand) order."""
    from ..operators.annotation import global_numbers

    rows = global_numbers(runs, ["seq", "start", "end", "strand"], "nth")
    return rows.select("seq", "start", "end", "strand", F.concat(F.lit("r"), F.col("nth").cast("string")).alias("repeat_id"))
