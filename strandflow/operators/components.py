"""Connected components of links between text nodes, and the tables written for them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the session has one, else, on one machine only, a temporary folder."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path and sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = path or tempfile.mkdtemp(prefix="strandflow-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage there; rows keep their partitions."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df written in the shared folder and read again, with its true size. Loops that join their
    own results use it: the size estimates that a checkpoint hands on multiply with every join."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def label_components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, root (the smallest node of its component), for every linked node.

    Every step takes the smallest label among a node and its neighbours, then that label's
    own label, so distances to the smallest node shrink by doubling."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both)
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("root", "near"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "near").alias("low"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("lower"))
        step = written(step.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("root"), "old"))
        labels = step.select("node", "root")
        if not step.where("root <> old").take(1):
            return labels
