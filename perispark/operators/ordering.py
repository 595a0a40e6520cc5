"""Dense numbers in order without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perispark.sources.scratch import written

#: How monotonically_increasing_id() puts a partition's number above its rows' numbers.
_LOCAL = 33


def sorted_ranges(df: DataFrame, order: Sequence[Column | str], label: str = "ranges") -> DataFrame:
    """df with the columns ``_range`` and ``_at``: rows are dealt to ranges of about one size by ``order``,
    sorted there, and numbered within their range from 0. Written once as a table, so that the numbers hold
    when a task runs again.

    order must tell rows apart for ranges of one size: rows that are equal in it share a range.
    """
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", at)
    below = F.lit((1 << _LOCAL) - 1)
    table = written(dealt, label)
    return table.withColumns({"_range": F.shiftright("_id", _LOCAL).cast("int"), "_at": F.col("_id").bitwiseAND(below)}).drop("_id")


def numbered(df: DataFrame, order: str | Sequence[Column | str], within: Sequence[str] = (), out: str = "idx") -> DataFrame:
    """df with the column ``out``: each row's place, from 0, in ``order`` (a column or a list of them that
    tells the rows apart) within the groups of ``within`` (not null).

    One range-partitioned sort, written once; a row's place is its place in its range and the rows of its
    group in the ranges before. Only the counts of ranges and groups are added up, never rows, so names with
    a common beginning, one large group or many small ones spread evenly over the tasks.
    """
    order, within = [order] if isinstance(order, (str, Column)) else list(order), list(within)
    rows = sorted_ranges(df, [*within, *order])
    counts = rows.groupBy(*within, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*within, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    if not within:
        offsets = F.broadcast(offsets)  # a row for each range, as many as tasks
    return rows.join(offsets, [*within, "_range"]).select(*df.columns, (F.col("_at") + F.col("_offset")).cast("long").alias(out))
