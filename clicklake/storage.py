"""Where jobs keep tables of their own: the folder that all machines share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="clicklake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there; a failing store raises instead of looking empty."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds; none for a folder that is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def put_in_order(spark: SparkSession, path: str) -> int:
    """Give the part files of a folder times in the order of their names, a second apart, the last one now; returns their number.

    A stream takes files in order of time, and tasks that write a range each end in any order.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [n for n in names(spark, path) if n.startswith("part-")]
    first = int((time.time() - len(files)) * 1000)
    for n, name in enumerate(files):
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(p, name), first + 1000 * n, -1)
    return len(files)


def stored(spark: SparkSession, df: DataFrame, label: str, **options) -> DataFrame:
    """Write as Parquet and read again with the same schema."""
    path = shared_folder(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
