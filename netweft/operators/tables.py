"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(1)
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="netweft-")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A session on one machine may leave it unset and gets a temporary folder; on a cluster that is
    an error, as executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder()


def cut(df: DataFrame, name: str, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = path or new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


TASK_ROWS = 500_000  # fixed value: rows of a dealt table that one task holds


def dealt(df: DataFrame, *keys: str, rows: int | None = None, within: int = TASK_ROWS) -> DataFrame:
    """``df`` by its keys in as many partitions as ``rows`` rows (a count or an upper bound) need to hold some ``within`` each, so
    that a larger table has more of them, not larger ones. Without ``rows`` the session's own number. What is grouped by the keys
    (and more columns) needs no further shuffle, and nothing is gathered in a map before it is dealt."""
    if rows is None:
        return df.repartition(*keys)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // within)), *keys)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete the tables of ``cut`` that these DataFrames read, once all that was computed from them is written; a table that
    doesn't lie in the shared folder under a name of ``new_path`` stays."""
    for spark in {df.sparkSession for df in tables}:
        own = re.compile(re.escape(shared_folder(spark).rsplit(":", 1)[-1]) + r"/[\w-]+-[0-9a-f]{32}$")
        for folder in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
            if own.search(folder):
                drop(spark, folder)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of DataFrames that the driver holds no more: its cleaner follows collections."""
    spark._jvm.System.gc()
