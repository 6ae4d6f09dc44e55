"""Lookup of a vector by a name in any of its usual spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find_vectors(names: DataFrame, vectors: DataFrame) -> DataFrame:
    """names(name) left-joined with vectors(key, embedding): exact spelling first, then with
    blanks and underscores exchanged, then folded to letters and digits."""
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    same = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    rank = F.when(F.col("name") == F.col("key"), 0).when(same(F.col("name")) == same(F.col("key")), 1).otherwise(2)
    joined = names.withColumn("_f", fold(F.col("name"))).join(vectors.withColumn("_f", fold(F.col("key"))), "_f", "left")
    best = joined.groupBy("name").agg(F.min_by(F.struct("key", "embedding"), F.struct(rank, F.col("key"))).alias("v"))
    return best.select("name", "v.key", "v.embedding")
