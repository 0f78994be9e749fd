"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.session import store


def _least(edges: DataFrame) -> DataFrame:
    """(child, least): the smallest neighbour below each node that has one."""
    return store(edges.groupBy(F.col("b").alias("child")).agg(F.min("a").alias("least")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a < b) that is not the smallest of its component.

    A round moves the upper end of every link to the parent of its lower end, then hangs all smaller neighbours of a
    node below the smallest. Links never leave the cluster's tables; the driver sees one count a round, and every
    round is a written table, so a lost executor costs a round at most. Nodes with many links are the lower end of
    joins between stored tables, which adaptive execution splits.
    """
    edges = store(edges.select("a", "b").filter("a < b").distinct())
    while True:
        least = _least(edges)
        lifted = store(
            edges.join(least, F.col("a") == F.col("child"), "left")
            .select(F.coalesce("least", "a").alias("a"), "b", F.col("least").isNotNull().alias("moved")).distinct())
        least = _least(lifted)
        met = lifted.join(least, F.col("b") == F.col("child")).select("a", "b", "least", "moved")
        turned = store(
            met.select(F.explode(F.when(F.col("a") == F.col("least"), F.array(F.struct("a", "b", "moved")))
                                 .otherwise(F.array(F.struct(F.col("least").alias("a"), F.col("a").alias("b"), F.lit(True).alias("moved"))))
                                 ).alias("e")).select("e.*")
            .groupBy("a", "b").agg(F.max("moved").alias("moved")))
        edges = turned.select("a", "b")
        if turned.filter("moved").isEmpty():
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
