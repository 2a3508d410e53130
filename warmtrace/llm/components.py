"""Connected components by alternating stars: every round is a few shuffles, and rounds grow with the logarithm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warmtrace.llm.common import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for every node of ``links`` the smallest node that it is connected to.

    Repeated links, loops and either direction are allowed; a link with a null end is none.
    Each round points every node's larger neighbours at the smallest of its neighbourhood, then
    every node's smaller neighbours.  A smallest neighbour is found by a pre-aggregated minimum,
    and given back by a join whose hot side Spark can split, so a node with most links is no task's load.
    """
    edges = (links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
             .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    edges = materialise(edges)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(lowest.withColumnRenamed("m", "v")).distinct())
        # Stars are reached when a round changes nothing: one number for all edges, whatever their order.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
