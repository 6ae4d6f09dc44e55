"""Connected components of a link table by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def follow(parent: DataFrame) -> DataFrame:
    """parent(node, root) with root < node, jumped until every root is final."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = written(
            parent.join(up, "root", "left").select(
                "node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")
            ),
            "jumped",
        )
        parent = jumped.select("node", "root")
        if not jumped.where("moved").take(1):
            return parent


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> node, root for every linked node that isn't the smallest
    of its component; root is that smallest node.

    Each round hooks every node to its smallest neighbour, follows the hooks to their
    ends and contracts the links to those ends, so each round at least halves the nodes
    of a component. Links, hooks and labels stay Spark tables, written after each step;
    the driver sees only whether a table is empty."""
    links = written(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    labels = None
    while links.take(1):
        hooks = (
            links.select(F.col("b").alias("node"), F.col("a").alias("root"))
            .groupBy("node").agg(F.min("root").alias("root"))
        )
        ends = follow(written(hooks, "hooks"))
        at_a = ends.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        at_b = ends.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = links.join(at_a, "a", "left").join(at_b, "b", "left")
        ra, rb = F.coalesce("ra", "a"), F.coalesce("rb", "b")
        links = written(
            moved.select(F.least(ra, rb).alias("a"), F.greatest(ra, rb).alias("b")).where("a <> b").distinct(),
            "links",
        )
        if labels is None:
            labels = ends
        else:
            later = ends.select(F.col("node").alias("root"), F.col("root").alias("final"))
            labels = written(
                labels.join(later, "root", "left").select("node", F.coalesce("final", "root").alias("root"))
                .unionByName(ends),
                "labels",
            )
    if labels is None:
        return links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return labels
