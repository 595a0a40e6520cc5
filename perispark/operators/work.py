"""Which rows still need work: filters and anti-joins over observation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perispark.functions.rules import BANNER_PORTS


def pending_http(domains: DataFrame) -> DataFrame:
    return domains.filter("updated_at IS NULL").orderBy("domain")


def pending(domains: DataFrame, table: DataFrame, ts_col: str | None = None, key: str = "domain") -> DataFrame:
    """Domains without a row in table, or, with ts_col, whose row has no time yet."""
    done = table if ts_col is None else table.filter(F.col(ts_col).isNotNull())
    return domains.join(done.select(key).distinct(), key, "left_anti")


def retry_targets(table: DataFrame, kind: str) -> DataFrame:
    return table.filter(F.col("error_kind") == kind)


def pending_ports(domains: DataFrame, targeted: bool = False) -> DataFrame:
    return domains.filter(F.col("ports_targeted_at" if targeted else "ports_scanned_at").isNull())


def banner_backlog(ports: DataFrame, key: str = "domain") -> DataFrame:
    """Open ports with a usable address and no banner yet, as one sorted list for each domain."""
    todo = ports.filter(F.col("banner").isNull() & F.col("ip").isNotNull() & (F.col("ip") != "127.0.0.1")
        & F.col("port").isin(*BANNER_PORTS))
    return todo.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("port", "ip"))).alias("targets"))


def unclassified(domains: DataFrame, classes: DataFrame, key: str = "domain") -> DataFrame:
    return pending(domains, classes, None, key)


def geocode_backlog(domains: DataFrame) -> DataFrame:
    return domains.filter("ip IS NOT NULL AND country_code IS NULL")


def unresolved_operators(samples: DataFrame, operators: DataFrame) -> DataFrame:
    return samples.join(operators.select("operator"), "operator", "left_anti")
