"""Merges of a current table with new rows; each returns the whole next table.

Keys with null parts never match. Snapshots are written to a new path and swapped; a
merge is idempotent, so a job that fails half-way can run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perispark.functions.rules import LEGACY_PORTS, SERVICES


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"c.{k}") == F.col(f"n.{k}") for k in keys])


def latest(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The row of the greatest seq for each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def merge_replace(cur: DataFrame, new: DataFrame, keys: Sequence[str], seq: str | None = None) -> DataFrame:
    """New rows replace those of their key whole, nulls included; of several new rows the one of
    the greatest seq counts."""
    new = latest(new, keys, seq) if seq else new.dropDuplicates(list(keys))
    return cur.join(new.select(*keys), list(keys), "left_anti").select(*cur.columns).unionByName(new.select(*cur.columns))


def merge_coalesce(cur: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """As merge_replace(), but a null in a keep column leaves the old value."""
    other = [c for c in cur.columns if c not in keys]
    there = F.col("_n").isNotNull()
    joined = cur.alias("c").join(new.withColumn("_n", F.lit(1)).alias("n"), _same(keys), "full_outer")
    value = (lambda c: F.coalesce(f"n.{c}", f"c.{c}") if c in keep else F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"c.{c}")))
    return (
        joined.select(*[F.coalesce(f"c.{k}", f"n.{k}").alias(k) for k in keys], *[value(c).alias(c) for c in other]).select(*cur.columns))


def merge_ignore(cur: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of keys that the table lacks are added, one for each."""
    fresh = new.dropDuplicates(list(keys)).join(cur.select(*keys), list(keys), "left_anti")
    return cur.unionByName(fresh.select(*cur.columns))


def merge_abort(cur: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union; the job fails where a key of new is there already."""
    clash = new.join(cur.select(*keys).distinct().withColumn("_there", F.lit(True)), list(keys), "left")
    first = new.columns[0]
    checked = clash.withColumn(first, F.when(F.col("_there"), F.raise_error(F.lit("duplicate key"))).otherwise(F.col(first)))
    return cur.unionByName(checked.select(*cur.columns))


def merge_update(cur: DataFrame, new: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """The given columns of known keys take the new values; unknown keys are ignored."""
    n = new.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_hit"))
    return cur.join(n, key,
        "left").select(
        *[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in cur.columns])


def usable_ip(c: Column) -> Column:
    return c.isNotNull() & (c != "127.0.0.1")


def backfill_port_ip(ports: DataFrame, domains: DataFrame, key: str = "domain") -> DataFrame:
    d = domains.select(key, F.col("ip").alias("_ip"))
    value = F.when(~F.coalesce(usable_ip(F.col("ip")), F.lit(False)) & usable_ip(F.col("_ip")), F.col("_ip")).otherwise(F.col("ip"))
    return ports.join(d, key, "left").withColumn("ip", value).select(*ports.columns)


def unpivot_ports(legacy: DataFrame, key: str = "domain") -> DataFrame:
    """One row for each set flag of the wide table: key, port, service."""
    cols = [f"p{p}" for p in LEGACY_PORTS if f"p{p}" in legacy.columns]
    long = (
        legacy.select(key, *[F.col(c).cast("int").alias(c) for c in cols]).unpivot([key], cols, "flag", "is_open").filter("is_open = 1"))
    port = F.substring("flag", 2, 9).cast("int")
    names = F.create_map(*[x for p in LEGACY_PORTS for x in (F.lit(p), F.lit(SERVICES[p]))])
    return long.select(key, port.alias("port"), names[port].alias("service"))


def backfill_ports_scanned(domains: DataFrame, ports: DataFrame, key: str = "domain") -> DataFrame:
    last = ports.groupBy(key).agg(F.max("scanned_at").alias("ports_scanned_at"))
    return domains.drop("ports_scanned_at").join(last, key, "left")


def open_only(ports: DataFrame) -> DataFrame:
    return ports.filter(F.col("open").cast("int") == 1).drop("open")


def denormalise_whois(domains: DataFrame, whois: DataFrame, key: str = "domain") -> DataFrame:
    w = whois.select(key, F.col("registrar").alias("whois_registrar"), "whois_created")
    return domains.drop("whois_registrar", "whois_created").join(w, key, "left")
