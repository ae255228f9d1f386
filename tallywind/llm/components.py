"""Connected components by alternating star contractions, on DataFrames that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywind.session import stage


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v). Minima are aggregated before they are joined, so a hub is no hot group."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("m", "u").alias("m"))
    large = stage(edges.join(least, "v").select("u", F.col("m").alias("v")).distinct(), "large-star")
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return stage(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (two long columns ``a, b``): the root is the smallest node of its component."""
    now = stage(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == state:
            break
        state, now = after, _round(now)
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
