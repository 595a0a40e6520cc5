"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The setting that bounds what Spark hands to Python at a time, its default, and what texts need.
BATCH, USUAL, SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, "8m"


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand rows to Python 8 MB at a time instead of 64, so that neither side of a task holds
    several times 64 MB of texts; a session that sets another size keeps it."""
    if spark.conf.get(BATCH, f"{USUAL}b") == f"{USUAL}b":
        spark.conf.set(BATCH, SMALL)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir). Where none is
    named, a temporary one is set on a local master, as in tests; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="perispark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables that an operator writes in the shared folder on the way to its result."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        small_batches(spark)

    def written(self, df: DataFrame, label: str) -> DataFrame:
        """Write df as a table and read it again: cuts the lineage, so that a lost executor
        costs no more than the tasks it ran, and runs the plan once."""
        path = f"{shared_folder(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame, label: str) -> DataFrame:
        """Write df, then delete all tables written before: only the result's stays."""
        before, self.paths = self.paths, []
        out = self.written(df, label)
        self.delete(before)
        return out

    def delete(self, paths: list[str]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def slices(texts: pa.Array, most: int = 1_000_000) -> Iterator[slice]:
    """Runs of about so many bytes of an array of strings, one at least, so that what a task
    builds for them in Python is bounded."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most)))
        yield slice(lo, hi)
        lo = hi


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def words(text: str | None) -> list[bytes]:
    """UTF-8 words between the ASCII white space 09-0D and 20 (what bytes.split() splits on)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """As words(), with A-Z in lower case and other letters as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def list_array(values: pa.Array, offsets) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
