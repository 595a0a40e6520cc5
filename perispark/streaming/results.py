"""Arriving scan results as streams, with batch twins for what SQL can state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from perispark.operators.merge import latest
from perispark.sources.versions import BucketTable


def progress(results: DataFrame, every: str = "1 hour") -> DataFrame:
    """For each interval: results, those that are fine, errors, results a second and their mean time; on a
    stream, with a watermark set before."""
    n = results.groupBy(F.window("ts", every).alias("w")).agg(F.count("*").alias("completed"), F.count("error_kind").alias("errors"),
        F.round(F.avg("elapsed"), 4).alias("mean_elapsed"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    rate = F.round(F.col("completed").cast("double") / seconds, 4)
    return n.select(F.col("w.start").alias("start"), "completed", (F.col("completed") - F.col("errors")).alias("ok"), "errors",
        rate.alias("rate"), "mean_elapsed")


def stream_progress(results: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return progress(results.withWatermark("ts", late), every)


def stream_dedupe(results: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return results.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stream_upsert(results: DataFrame, folder: str, keys: list[str], seq: str, buckets: int = 64, tidy: int = 20) -> DataStreamWriter:
    """Keep the latest row of each key in a table of hash buckets under folder, which upserted() reads.

    A micro-batch reads and writes only the buckets that its keys fall in, as the version of its number: a batch
    that runs again replaces its own version, so nothing counts twice. Every ``tidy`` batches, files that no bucket
    is at any more are deleted.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        table = BucketTable(batch.sparkSession, folder, keys, buckets)
        table.merge(latest(batch, keys, seq), version=batch_id)
        if batch_id % tidy == tidy - 1:
            table.vacuum()

    return results.writeStream.foreachBatch(merge)


def upserted(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The table that stream_upsert() keeps."""
    rows = BucketTable(spark, folder, keys).read()
    if rows is None:
        raise ValueError(f"no batch under {folder}")
    return rows


#: transformWithState keeps its state there.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _stateful(rows: DataFrame, key: str, late: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """rows by key through a processor with event-time timers; rows later than ``late`` are dropped by Spark."""
    rows.sparkSession.conf.set(*STATE_STORE)  # the only store for it, read when the stream starts
    dealt = rows.withWatermark("ts", late).groupBy(key)
    return dealt.transformWithStateInPandas(processor, schema, "append", "eventTime")


class _Forgetful(StatefulProcessor):
    """State of a key that ends ``forget`` seconds of event time after its last row: ``last`` is that row's time,
    and a timer at its end clears the state once the watermark has passed it."""

    def __init__(self, forget: int):
        self.forget = 1000 * forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def seen(self) -> int | None:
        return self.last.get()[0] if self.last.exists() else None

    def see(self, at: int) -> None:
        before = self.seen()
        if before is None or at > before:
            if before is not None:
                self.handle.deleteTimer(before + self.forget)
            self.last.update((at,))
            self.handle.registerTimer(at + self.forget)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        return iter(())

    def clear(self) -> None:
        self.last.clear()

    def close(self) -> None:
        pass


def _times(rows: pd.DataFrame) -> pd.Series:
    """Event times in milliseconds."""
    return rows["ts"].astype("datetime64[ms]").astype("int64")


class ErrorGuard(_Forgetful):
    def __init__(self, threshold: float, least: int, forget: int):
        super().__init__(forget)
        self.threshold, self.least = threshold, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.totals = handle.getValueState("totals", "completed long, errors long, told boolean")

    def clear(self) -> None:
        super().clear()
        self.totals.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        done, errors, told = self.totals.get() if self.totals.exists() else (0, 0, False)
        for part in rows:
            done, errors = done + len(part), errors + int(part["error_kind"].notna().sum())
            self.see(int(_times(part).max()))
        over = done >= self.least and errors / done > self.threshold
        self.totals.update((done, errors, told or over))
        if over and not told:
            yield pd.DataFrame({"module": [key[0]], "completed": [done], "errors": [errors]})


def stream_error_guard(
    results: DataFrame, threshold: float = 0.5, min_samples: int = 100, late: str = "10 minutes", forget: int = 7 * 86400
) -> DataFrame:
    """A row for each module once its error rate passes the threshold; state is two counts a module, which end when
    the module was silent for ``forget`` seconds."""
    rows = results.select("module", F.col("ts").cast("timestamp").alias("ts"), "error_kind").filter("module IS NOT NULL AND ts IS NOT NULL")
    return _stateful(rows, "module", late, ErrorGuard(threshold, min_samples, forget), "module string, completed long, errors long")


def changes(rows: pd.DataFrame, cols: list[str], forget: int) -> pd.DataFrame:
    """(change, column, before, after) from row to row of one key, in order of time: the first row, and one that comes
    over ``forget`` milliseconds after the one before it, adds the key, others change columns."""
    gap = rows["at"].diff()
    added = gap.isna() | (gap > forget)
    parts = [pd.DataFrame({"i": rows.index[added], "c": -1, "change": "added", "column": None, "before": None, "after": None})]
    for c, name in enumerate(cols):
        now, before = rows[name], rows[name].shift()
        differs = ~added & (now.ne(before) & ~(now.isna() & before.isna()))
        parts.append(pd.DataFrame({"i": rows.index[differs], "c": c, "change": "changed", "column": name, "before": before[differs], "after": now[differs]}))
    out = pd.concat([p for p in parts if len(p)] or parts[:1]).sort_values(["i", "c"])
    return out[["i", "change", "column", "before", "after"]].astype(object).where(lambda x: x.notna(), None)


class ChangeLog(_Forgetful):
    """State: the key's last row as a map from column to value; columns that are null have no entry."""

    def __init__(self, cols: list[str], forget: int):
        super().__init__(forget)
        self.cols = cols

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.values = handle.getMapState("values", "column string", "value string")

    def clear(self) -> None:
        super().clear()
        self.values.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new["at"] = _times(new)
        new = new.sort_values(["at", *self.cols], kind="stable", na_position="first")[["at", *self.cols]]
        before = self.seen()
        if before is not None:
            new = new[new["at"] >= before]  # what is older than the last row says nothing any more
            old = {k[0]: v[0] for k, v in self.values.iterator()}
            new = pd.concat([pd.DataFrame([[before, *map(old.get, self.cols)]], columns=new.columns), new])
        new = new.reset_index(drop=True)
        out = changes(new, self.cols, self.forget)
        if before is not None:
            out = out[out["i"] > 0]  # the row of the state was told before
        last = new.iloc[-1]
        self.see(int(last["at"]))
        self.values.clear()
        for c in self.cols:
            if pd.notna(last[c]):
                self.values.updateValue((c,), (last[c],))
        if len(out):
            out = out.drop(columns="i")
            out.insert(0, "key", key[0])
            yield out


def stream_changelog(results: DataFrame, key: str, cols: list[str], late: str = "10 minutes", forget: int = 7 * 86400) -> DataFrame:
    """Added and changed values of each key as its rows arrive, by time; rows of one time come in order of cols.

    State is the key's last row and ends ``forget`` seconds of event time after it; a later row adds the key anew, as
    does one that comes after so long a silence before the state has ended. Rows later than ``late`` are dropped; others
    that are older than the last row of their key in an earlier micro-batch say nothing. Null keys and times are left out.
    changelog() is the batch form.
    """
    rows = results.select(F.col(key).cast("long").alias(key), F.col("ts").cast("timestamp").alias("ts"), *[F.col(c).cast("string").alias(c) for c in cols])
    rows = rows.filter(F.col(key).isNotNull() & F.col("ts").isNotNull())
    schema = "key long, change string, column string, before string, after string"
    return _stateful(rows, key, late, ChangeLog(cols, forget), schema)


def changelog(results: DataFrame, key: str, cols: list[str], forget: int = 7 * 86400) -> DataFrame:
    """(key, change, column, before, after): what stream_changelog() tells of rows that come in order."""
    order = [F.col("ts"), *[F.col(c).asc_nulls_first() for c in cols]]
    rows = results.select(F.col(key).cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"), *[F.col(c).cast("string").alias(c) for c in cols])
    w = Window.partitionBy("key").orderBy(*order)
    rows = rows.filter("key IS NOT NULL AND ts IS NOT NULL").select("*", F.lag("ts").over(w).alias("_ts"), *[F.lag(c).over(w).alias(f"_{c}") for c in cols])
    gap = F.unix_millis("ts") - F.unix_millis("_ts")
    added = F.col("_ts").isNull() | (gap > 1000 * forget)
    none = F.lit(None).cast("string")
    entry = lambda change, column, before, after: F.struct(F.lit(change).alias("change"), column.alias("column"), before.alias("before"), after.alias("after"))
    changed = [F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), entry("changed", F.lit(c), F.col(f"_{c}"), F.col(c))) for c in cols]
    told = F.when(added, F.array(entry("added", none, none, none))).otherwise(F.array_compact(F.array(*changed)))
    return rows.select("key", F.inline(told))
