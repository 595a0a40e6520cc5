"""A keyed table in hash buckets: a merge writes the buckets that it hits, and readers see whole versions.

Below the folder, data/v=<version>/bucket=<b> holds the rows of a bucket as of the version that last
changed it, and manifest/v=<version>.json says which version each bucket is at. The manifest is renamed
into place last, so a writer that is killed leaves the version before it as it was, and a version that is
written again replaces its own files alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perispark.operators import merge

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class BucketTable:
    """keys tell the rows apart; a bucket is merged in one task, so choose buckets for that size when the table begins."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), list(keys), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        where = self._path(f"{self.folder}/manifest")
        names = [s.getPath().getName() for s in self._files.listStatus(where)] if self._files.exists(where) else []
        return sorted(int(n[2:-5]) for n in names if n.startswith("v=") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """The newest manifest up to a version: buckets (number: version), how many they are, the rows' schema."""
        have = [v for v in self.versions() if version is None or v <= version]
        if not have:
            return None
        text = self.spark.read.text(f"{self.folder}/manifest/v={have[-1]}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame | None:
        """The rows of a version (the newest), of some buckets if ``only`` names them; None before the first."""
        found = self.manifest(version)
        if found is None:
            return None
        at = {int(b): v for b, v in found["buckets"].items() if only is None or int(b) in only}
        schema = T.StructType.fromJson(found["schema"])
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/data/v={v}/bucket={b}" for b, v in sorted(at.items())])

    def merge(self, new: DataFrame, how: Merge | None = None, version: int | None = None) -> list[int]:
        """Merge new rows by how(current, new), merge_replace() unless told; the buckets that were written.

        how() sees the current rows of the buckets that new falls in, and must keep rows in theirs. A version
        that exists is built again from the one before it, as when a stream runs a batch again.
        """
        have = self.versions()
        version = (have[-1] + 1 if have else 0) if version is None else version
        before = self.manifest(version - 1)
        buckets = before["n"] if before else self.buckets
        bucket = lambda: F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")
        hit = sorted(r.b for r in new.select(bucket().alias("b")).distinct().collect())  # at most the buckets
        if not hit:
            return []
        current = self.read(version - 1, hit) if before else self.spark.createDataFrame([], new.schema)
        rows = (how or (lambda cur, n: merge.merge_replace(cur, n, self.keys)))(current, new)
        out = rows.withColumn("bucket", bucket()).repartition("bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/v={version}")
        at = (before["buckets"] if before else {}) | {str(b): version for b in hit}
        self._put(f"{self.folder}/manifest/v={version}.json", {"n": buckets, "buckets": at, "schema": json.loads(rows.schema.json())})
        return hit

    def _put(self, name: str, manifest: dict) -> None:
        part, place = self._path(f"{name}.part"), self._path(name)
        out = self._files.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._files.delete(place, False)
        self._files.rename(part, place)

    def vacuum(self, keep: int = 2) -> None:
        """Delete what none of the last ``keep`` versions reads; the last but one is needed to build the last again."""
        have = self.versions()
        used = {(int(b), v) for m in map(self.manifest, have[-keep:]) for b, v in m["buckets"].items()}
        for v in have[:-keep]:
            self._files.delete(self._path(f"{self.folder}/manifest/v={v}.json"), False)
        for s in self._files.listStatus(self._path(f"{self.folder}/data")) if have else ():
            v = int(s.getPath().getName()[2:])
            for part in self._files.listStatus(s.getPath()):
                name = part.getPath().getName()
                if name.startswith("bucket=") and (int(name[7:]), v) not in used:
                    self._files.delete(part.getPath(), True)


def save_bucketed(tables: dict[str, DataFrame], key: str, buckets: int, prefix: str, folder: str | None = None) -> dict[str, DataFrame]:
    """Tables <prefix>_<name> of the catalogue, each in as many buckets of key with one file a bucket; their
    files lie under folder, or in the warehouse.

    Joins and groups by key of tables saved alike need no shuffle: bucket meets bucket.
    """
    out = {}
    for name, df in tables.items():
        saved = f"{prefix}_{name}"
        writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
        (writer.option("path", f"{folder}/{saved}") if folder else writer).saveAsTable(saved)
        out[name] = df.sparkSession.table(saved)
    return out


def drop_bucketed(spark: SparkSession, tables: Sequence[str], prefix: str) -> None:
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{name}")
