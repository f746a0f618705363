"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.session import stage


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node of the
    edges (``a``, ``b``; longs, no self loops needed). Each step is two grouped
    minima and joins; its result is staged, and the steps end when nothing
    changes, after about the logarithm of the longest path. A node with very
    many edges is pre-aggregated and joined by AQE's skew split."""
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest.select(F.col("u").alias("_u"), "m"), F.col("u") == F.col("_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(joined.unionByName(smallest.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
