"""FASTA as a DataFrame source and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str, upper: bool = True, min_length: int = 0) -> DataFrame:
    """seq_name (first word of the header), description (the rest), seq, length.

    The file is split at line starts of '>', so one record is one row and a plain file is
    read by many tasks; .gz and .bz2 are read by their suffix. A file begins with its first
    record, after blank lines at most."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "").alias("b"))
    header = F.trim(F.substring_index("b", "\n", 1))
    seq = F.regexp_replace(F.substring(F.col("b"), F.length(F.substring_index("b", "\n", 1)) + 1, F.length("b")), r"\s", "")
    rows = raw.select(
        F.regexp_extract(header, r"^(\S*)", 1).alias("seq_name"), F.trim(F.regexp_replace(header, r"^\S*", "")).alias("description"),
        (F.upper(seq) if upper else seq).alias("seq"),
    )
    return rows.where(F.col("seq_name") != "").withColumn("length", F.length("seq").cast("long")).where(F.col("length") >= min_length)


def duplicate_names(seqs: DataFrame) -> DataFrame:
    """Names that more than one record has; a genome has none."""
    return seqs.groupBy("seq_name").agg(F.count("*").alias("n")).where("n > 1")


def count_records(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.col("value").startswith(">")).count()


def too_many_records(spark: SparkSession, path: str, most: int) -> bool:
    """Should a run over this file be skipped? A limit of zero or less never skips."""
    return most > 0 and count_records(spark, path) > most


def write_fasta(seqs: DataFrame, path: str) -> None:
    line = F.concat_ws("\n", F.concat_ws(" ", F.concat(F.lit(">"), F.col("seq_name")), F.nullif(F.col("description"), F.lit(""))), F.col("seq"))
    seqs.select(line.alias("value")).write.mode("overwrite").text(path)
