"""Sinks: each write is one job of Spark's commit protocol; tables that are replaced keep their versions, and
streams write a folder a batch, so that neither a crash nor a replay loses or doubles rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluation import upsert


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_index(docs: DataFrame, metadata: DataFrame, path: str) -> int:
    """The vector index table; fails if a document has no metadata or rows are lost."""
    missing = docs.join(metadata.select("id"), "id", "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"documents without metadata: {[r[0] for r in missing.select('id').limit(5).collect()]}")
    n = docs.count()
    docs.join(metadata, "id").write.mode("overwrite").parquet(path)
    written = docs.sparkSession.read.parquet(path).count()
    if written != n:
        raise ValueError(f"{written} rows written of {n}")
    return n


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of a versioned table's rows: the newest version whose writing ended. Versions are numbered
    folders, each written whole and closed by Spark's ``_SUCCESS``; none is ever changed."""
    if not exists(spark, path):
        return None
    fs, Path = _fs(spark, path)
    numbers = sorted((int(s.getPath().getName()[2:]) for s in fs.listStatus(Path(path)) if s.getPath().getName().startswith("v=")), reverse=True)
    return next((f"{path}/v={n}" for n in numbers if fs.exists(Path(f"{path}/v={n}/_SUCCESS"))), None)


def replace_table(df: DataFrame, path: str, keep: int = 2) -> str:
    """Make ``df``, which may read the table itself, the table's new version. Readers go on with the version
    they opened; a crash at any point leaves the last whole version the current one. The ``keep`` newest
    versions stay. One writer at a time."""
    spark = df.sparkSession
    fs, Path = _fs(spark, path)
    numbers = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(Path(path)) if s.getPath().getName().startswith("v=")) if exists(spark, path) else []
    new = f"{path}/v={(numbers[-1] if numbers else 0) + 1}"
    df.write.parquet(new)
    whole = [n for n in numbers if fs.exists(Path(f"{path}/v={n}/_SUCCESS"))]
    for n in numbers:
        if n not in whole[len(whole) - keep + 1 :]:
            fs.delete(Path(f"{path}/v={n}"), True)
    return new


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version of a table, null if there is none."""
    now = current(spark, path)
    return None if now is None else spark.read.parquet(now)


def upsert_summaries(spark: SparkSession, new: DataFrame, path: str, keys: tuple[str, ...] = ("model", "config")) -> None:
    """Rows with the same keys are replaced. ``new`` must have the table's columns: whatever fails, the table
    stays as it was."""
    old = read_table(spark, path)
    replace_table(new if old is None else upsert(old, new, list(keys)), path)


def replace_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Only the run's partition is rewritten."""
    out = rows.withColumn("run_id", F.lit(run_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not stored yet, one of each key; how many were new."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates([key])
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def batch_sink(path: str, key: str | None = None):
    """A function for ``foreachBatch`` whose batches count once, however often they are replayed: batch n goes
    to its own folder ``batch=n`` of ``path``. A folder that was written whole is left alone; a torn one is
    written anew. ``key``: rows whose key an earlier batch has are left out."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        fs, Path = _fs(spark, path)
        mine = f"{path}/batch={batch}"
        if fs.exists(Path(f"{mine}/_SUCCESS")):
            return
        if key is not None:
            rows = rows.dropDuplicates([key])
            before = batches(spark, path, batch)
            if before is not None:
                rows = rows.join(before.select(key), key, "left_anti")
        rows.write.mode("overwrite").parquet(mine)

    return write


def append_batch(rows: DataFrame, path: str) -> DataFrame:
    """Write ``rows`` as the next batch of ``path`` and return them as written."""
    spark = rows.sparkSession
    fs, Path = _fs(spark, path)
    numbers = [int(s.getPath().getName()[6:]) for s in fs.listStatus(Path(path)) if s.getPath().getName().startswith("batch=")] if exists(spark, path) else []
    mine = f"{path}/batch={max(numbers, default=-1) + 1}"
    rows.write.parquet(mine)
    return spark.read.schema(rows.schema).parquet(mine)


def batches(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The rows of all batches that were written whole (those with smaller numbers than ``before``); null if
    there are none."""
    if not exists(spark, path):
        return None
    fs, Path = _fs(spark, path)
    numbers = sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(Path(path)) if s.getPath().getName().startswith("batch="))
    whole = [f"{path}/batch={n}" for n in numbers if (before is None or n < before) and fs.exists(Path(f"{path}/batch={n}/_SUCCESS"))]
    return spark.read.parquet(*whole) if whole else None


def write_terms(tops: DataFrame, path: str) -> None:
    tops.write.mode("overwrite").csv(path, header=True)


def write_list(terms: DataFrame, path: str) -> None:
    terms.select(F.col("term").alias("value")).write.mode("overwrite").text(path)


def log_run(spark: SparkSession, path: str, run_id: str, metrics: dict[str, float], tags: dict[str, str] | None = None) -> None:
    """A run's metrics and tags as rows of a Parquet run log."""
    rows = [(run_id, "metric", k, float(v), None) for k, v in metrics.items()] + [(run_id, "tag", k, None, v) for k, v in (tags or {}).items()]
    spark.createDataFrame(rows, "run_id string, kind string, name string, value double, text string").write.mode("append").parquet(path)
