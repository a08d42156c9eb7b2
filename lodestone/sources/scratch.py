"""Where temporary tables and stream state go."""

from __future__ import annotations

import os
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

LOCAL = "/tmp/checkpoints/lodestone"


def folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where that is unset and all
    tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = LOCAL
        os.makedirs(found, exist_ok=True)
    return found.rstrip("/")


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have a scratch table removed when the driver's JVM ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def drop(spark: SparkSession, used: list[str]) -> None:
    """Delete scratch tables that no result depends on any more."""
    for path in used:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    used.clear()


def kept(df: DataFrame, most: int = 0, used: list[str] | None = None) -> DataFrame:
    """A table written to the shared folder and read back: computed once, however often it is used. ``most``: rows
    of a file, if bounded. The files go when the application ends, or, by their paths in ``used``, with ``drop``."""
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/kept-{uuid4().hex}"
    drop_at_exit(spark, path)
    df.write.option("maxRecordsPerFile", most).parquet(path)
    if used is not None:
        used.append(path)
    return spark.read.schema(df.schema).parquet(path)
