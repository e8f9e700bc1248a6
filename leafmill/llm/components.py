"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, release


def _are_stars(edges: DataFrame) -> bool:
    """Every node has one smaller neighbour, and that has none: each component is a star."""
    if edges.groupBy("a").count().where("count > 1").take(1):
        return False
    return not edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").take(1)


def components(links: DataFrame) -> DataFrame:
    """``a, b`` to ``node, comp``: each linked node and the smallest node it is connected to.

    Large-star hooks a node's larger neighbours to its smallest one, small-star its smaller ones and
    itself; the end is reached when each component is a star around its smallest node. The number of
    rounds grows with the logarithm of the longest path.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a <> b").distinct())
        del both, least, large, down, small
        release(edges.sparkSession)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots.select("node", F.col("node").alias("comp")))
