"""Tables written on the way to a result, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Where that is unset, a temporary folder is
    set on a local master, as in tests; on a cluster that is an error."""
    root = spark.conf.get(FOLDER, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{FOLDER} must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="perispark-")
        spark.conf.set(FOLDER, root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table and read it: its plan runs once, and a lost executor costs only the tasks it ran.

    Results read the table when they are used, so it stays until clear().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written here; results that read them are void afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
