"""The domain-to-nameserver graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perispark.functions.scalars import registrable_domain
from perispark.operators.ordering import numbered

NO_NS = "(no-ns)"


def ns_edges(pairs: DataFrame) -> DataFrame:
    """(source, target, type) for each (domain, host) pair, repeated ones kept."""
    host = F.trim(F.coalesce("host", F.lit("")))
    target = F.when(host == "", NO_NS).otherwise(registrable_domain(F.lower(host)))
    return pairs.select(F.col("domain").alias("source"), target.alias("target"), F.lit("uses_ns").alias("type"))


def ns_nodes(edges: DataFrame) -> DataFrame:
    """(id, label, type), a row for each id; an id that is both is a domain."""
    ends = (
        edges.select(F.col("source").alias("id"),
        F.lit("domain").alias("type")).unionByName(edges.select(F.col("target").alias("id"), F.lit("ns").alias("type"))))
    return ends.groupBy("id").agg(F.min("type").alias("type")).select("id", F.col("id").alias("label"), "type")


def index_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with a dense idx from 0 in order of id."""
    return numbered(nodes.select("id", "label", "type"), "id")


def index_edges(edges: DataFrame, indexed: DataFrame) -> DataFrame:
    """Edges with both ends' idx; edges with an unknown end are dropped."""
    end = lambda c, n: indexed.select(F.col("id").alias(c), F.col("idx").alias(n))
    return (
        edges.join(end("source", "sourceidx"), "source").join(end("target", "targetidx"), "target").select("source", "target", "type",
        "sourceidx", "targetidx"))


def dropped_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many edges index_edges() drops."""
    ids = nodes.select("id", F.lit(1).alias("_hit")).distinct()
    s = ids.select(F.col("id").alias("source"), F.col("_hit").alias("_s"))
    t = ids.select(F.col("id").alias("target"), F.col("_hit").alias("_t"))
    return edges.join(s, "source", "left").join(t, "target",
        "left").agg(F.count_if(F.col("_s").isNull() | F.col("_t").isNull()).alias("dropped"))


def cap_graph(nodes: DataFrame, edges: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    return nodes.filter(F.col("idx") < cap), edges.filter((F.col("sourceidx") < cap) & (F.col("targetidx") < cap))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(idx, degree, hub): both ends count; hub is 0, or 1 over two, or 2 over a hundred."""
    ends = edges.select(F.explode(F.array("sourceidx", "targetidx")).alias("idx")).groupBy("idx").agg(F.count("*").alias("degree"))
    d = F.coalesce("degree", F.lit(0)).cast("long")
    return nodes.select("idx").join(ends, "idx", "left").select("idx", d.alias("degree"),
        F.when(d > 100, 2).when(d > 2, 1).otherwise(0).alias("hub"))


def neighbours(edges: DataFrame, idx: int) -> DataFrame:
    here = F.col("sourceidx") == idx
    return (
        edges.filter(here | (F.col("targetidx") == idx)).select(
        F.when(here, F.col("targetidx")).otherwise(F.col("sourceidx")).alias("idx")).distinct())
