"""Rows dealt by key over as many tasks as they need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a task of the joins by key takes; their rows of all tables are sorted in it at once.
KEYS = 250_000


def parts(df: DataFrame, keys: int = KEYS) -> int:
    """How many parts df's rows need, at least the session's shuffle partitions. Counts df, so pass one that is cheap to count."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // keys))


def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    """df in n parts by key. Joins and groups by key on top run in as many: adaptive execution joins small parts, but
    splits none of those that a fixed number of partitions makes too large."""
    return df.repartition(n, F.col(key))
