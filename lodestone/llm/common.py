"""What the operators of this package share: scratch tables, word rules, distributed numbering."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship, small_batches  # noqa: F401
from ..sources.scratch import drop, drop_at_exit
from ..sources.scratch import folder as scratch_dir

#: A word, in every operator that counts or shingles words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, used: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: later plans start from files
    that survive a lost executor. The files go when the application ends, or, by their paths in ``used``,
    when an operator is done with them."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    if used is not None:
        used.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Names in the session's catalog of bucketed scratch tables, by their paths.
_named: dict[str, str] = {}


def bucketed(df: DataFrame, name: str, by: Sequence[str], used: list[str]) -> DataFrame:
    """Write ``df`` to the shared scratch folder by buckets, so that joins on ``by`` move none of it."""
    spark = df.sparkSession
    path, called, n = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}", f"lodestone_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", path).saveAsTable(called)
    drop_at_exit(spark, path)
    used.append(path)
    _named[path] = called
    return spark.table(called)


def remove(spark: SparkSession, used: list[str]) -> None:
    """Delete scratch tables that no result depends on any more."""
    for path in used:
        if called := _named.pop(path, None):
            spark.sql(f"DROP TABLE IF EXISTS {called}")
    drop(spark, used)


def hidden(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named by position, so that no name of its own meets one of an operator's; and
    the new name of each column."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def orderable(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """Columns that put rows in an order of their own: all that have one."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return [F.col(c) for c in names if not any(x in kinds[c] for x in ("map<", "variant"))] or [F.lit(0)]


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def parts_for(rows: int, rows_per_part: int) -> int:
    return max(1, -(-rows // rows_per_part))


def gapless_rank(df: DataFrame, groups: Sequence[str], order: Sequence[str], buckets: int, name: str, more: DataFrame | None = None) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without bringing a group to one task.

    Equal rows are counted first, then dealt by (group, hash bucket of ``order``); each bucket is
    numbered by itself and shifted by the sizes of the buckets before it. ``groups`` must not be
    null. ``more``: one row per group (unique on ``groups``) whose columns are added.
    """
    cols = df.columns
    rows = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*groups, "_b").orderBy(*order, *[c for c in cols if c not in order]).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sizes = rows.groupBy(*groups, "_b").agg(F.sum("_n").alias("_c"))
    shift = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_c").over(shift), F.lit(0))).drop("_c")
    kept = list(cols)
    if more is not None:
        offsets = offsets.join(more, list(groups))
        kept += [c for c in more.columns if c not in groups]
    out = inner.join(offsets, [*groups, "_b"])
    first = F.col("_off") + F.col("_start")
    return out.select(*kept, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias(name))
