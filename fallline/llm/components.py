"""Connected components of a graph of links, by contraction. No link or label is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links(a, b); a component is named by its least node.

    In each round a node goes to its least neighbour if that is less, those that went there follow
    it one step, and links are drawn anew between what remains. A round leaves less than half of the
    nodes of a chain and makes a star of near copies one node after two. Hot nodes are met by
    aggregates with partial sums and by joins whose partitions the planner may split.
    """
    links = checkpointed(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = checkpointed(links.select("a").union(links.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("component")))
    while not links.isEmpty():
        least = links.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("up"))
        up = least.alias("x").join(least.alias("y"), F.col("x.up") == F.col("y.u"), "left").select("x.u", F.coalesce("y.up", "x.up").alias("up"))
        up = checkpointed(up)
        moved = labels.join(up, F.col("component") == F.col("u"), "left").select("node", F.coalesce("up", "component").alias("component"))
        labels = checkpointed(moved)
        one = links.join(up, F.col("a") == F.col("u"), "left").select(F.coalesce("up", "a").alias("a"), "b")
        both = one.join(up.withColumnRenamed("u", "w").withColumnRenamed("up", "to"), F.col("b") == F.col("w"), "left").select("a", F.coalesce("to", "b").alias("b"))
        links = checkpointed(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    return labels
