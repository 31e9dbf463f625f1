"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import settled


def _settled_stars(now: DataFrame) -> bool:
    """Whether every node hangs once, below a node that hangs nowhere."""
    ends = now.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(now.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 OR hangs + holds > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of a link; columns a, b in, in any direction, repeated or not.

    Each step hangs the neighbours of a node below the smallest of them; the number of steps grows with the logarithm of the
    longest path, and links that are stars already take none. Minima are combined before the shuffle, so the many links of a hub do not meet in one task for them.
    """
    now = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _settled_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settled(hung.union(root.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
