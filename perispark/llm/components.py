"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perispark.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the least node reachable over the edges (a, b), for the nodes that have one.

    Each round is joins and minima over the edges, written to the shared folder; the
    rounds grow with the logarithm of the longest chain. Edges never reach the driver;
    of the rounds' tables only the last one stays.
    """
    rounds = Scratch(scratch.spark)
    now = rounds.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = larger.union(now.join(least, "u").select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        smaller = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = smaller.union(small_least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        now = rounds.result(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    scratch.paths += rounds.paths
    # a fixed point is a star around each least node
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres)
