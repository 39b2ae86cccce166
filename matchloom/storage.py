"""Tables in the folder that driver and executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows times their width up to which a table is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset a temporary folder is made and set, but only if the master is local: on a cluster executors would
    each write to a folder of their own, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="matchloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/matchloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write the rows to the shared folder as Parquet, by folders of some columns if named, and read them back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._matchloom_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_matchloom_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shipped(df: DataFrame, row_bytes: int) -> DataFrame:
    """The table with a broadcast hint if its rows, counted, times `row_bytes` are BROADCAST_BYTES at most, else to be merged.

    Without the second hint a table could still be broadcast for the small size of its compressed files.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def sink(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table as Parquet with Zstandard and column statistics, to `path` or the shared folder, and read it back."""
    where = path or fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
