"""Connected components of an edge table, by alternating large-star and small-star steps, all as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.functions.storage import checkpointed as cut
from tarnfield.functions.storage import shared_folder

__all__ = ["components", "cut", "shared_folder"]


def components(edges: DataFrame) -> DataFrame:
    """``edges``: long columns a and b. Returns (node, component): each node's smallest reachable node, itself included.

    Null ends, loops and repeated edges are ignored; nodes without a remaining edge don't appear.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = cut(edges.where("a is not null and b is not null and a <> b").select(high.alias("a"), low.alias("b")).distinct())
    state = None
    while True:
        # Large star: each node's larger neighbours point to the smallest node around it.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        edges = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node and its smaller neighbours point to the smallest of them.
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        edges = cut(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
