"""Stratified allocation and sampling in hash order, split quality, balancing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import composite_key


def hash_order(seed: int, key: str) -> list[Column]:
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]


def hash_rank(docs: DataFrame, group: Column, key: str, seed: int, name: str = "_r") -> DataFrame:
    """Place of each row within its group in hash order, without bringing a group to one task: rows are
    numbered within (group, first three digits of the hash) and shifted by the counts of the digits before."""
    digest, last = hash_order(seed, key)
    rows = docs.withColumn("_g", F.coalesce(group.cast("string"), F.lit("\u0000"))).withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, 3))
    inner = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_h", last)))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    shift = rows.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return inner.join(shift, ["_g", "_b"]).withColumn(name, F.col("_i") + F.col("_o")).drop("_g", "_h", "_b", "_i", "_o")


def allocate(docs: DataFrame, by: Sequence[str], n: int, least: int = 1, most: int | None = None) -> DataFrame:
    """(stratum, pool, allocated): proportional, clamped to [least, pool] and ``most``, cut to whole
    numbers; what is missing goes one each to groups with room, largest first, once."""
    groups = docs.groupBy(composite_key(*[F.col(c) for c in by]).alias("stratum")).agg(F.count(F.lit(1)).alias("pool"))
    total = groups.agg(F.sum("pool").alias("total"))
    target = F.greatest(F.lit(float(least)), F.least(F.col("pool") / F.col("total") * n, F.col("pool").cast("double")))
    if most is not None:
        target = F.least(target, F.lit(float(most)))
    rows = groups.join(F.broadcast(total)).withColumn("base", F.floor(target).cast("long"))
    missing = rows.agg((F.lit(n) - F.sum("base")).alias("missing"))
    room = (F.col("base") < F.col("pool")) & (F.lit(True) if most is None else F.col("base") < most)
    rows = rows.withColumn("room", room)
    # One row per stratum is ranked here, not the documents.
    turn = F.row_number().over(Window.partitionBy("room").orderBy(F.desc("pool"), "stratum"))
    rows = rows.withColumn("turn", turn).join(F.broadcast(missing))
    extra = F.when(F.col("room") & (F.col("turn") <= F.col("missing")), 1).otherwise(0)
    return rows.select("stratum", "pool", (F.col("base") + extra).alias("allocated"))


def stratified_sample(docs: DataFrame, by: Sequence[str], n: int, key: str = "id", seed: int = 42, least: int = 1) -> DataFrame:
    """The first rows of each stratum in hash order."""
    share = allocate(docs, by, n, least)
    rows = hash_rank(docs.withColumn("stratum", composite_key(*[F.col(c) for c in by])), F.col("stratum"), key, seed)
    return rows.join(share.select("stratum", "allocated"), "stratum").filter("_r <= allocated").drop("_r", "allocated", "stratum")


def fraction_sample(docs: DataFrame, by: str, fraction: float, key: str = "id", seed: int = 42) -> DataFrame:
    """max(1, round half even of share) rows per group in hash order."""
    sizes = docs.groupBy(by).agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * fraction).cast("long")).alias("_k"))
    rows = hash_rank(docs, F.col(by), key, seed)
    return rows.join(sizes.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).filter("_r <= _k").drop("_r", "_k", "_by")


def without_homework(docs: DataFrame, section: str = "section", word: str = "homework") -> DataFrame:
    """Documents whose section does not speak of homework; those without a section stay."""
    return docs.filter(~F.coalesce(F.lower(section).contains(word), F.lit(False)))


def tool_quota(docs: DataFrame, tools: str, target: int, key: str = "id", seed: int = 42) -> DataFrame:
    """Up to max(1, target // tools present) documents of each tool of an array column, each once."""
    rows = docs.select(key, F.explode(F.array_distinct(tools)).alias("tool"))
    n = rows.agg(F.greatest(F.lit(1), F.floor(F.lit(target) / F.countDistinct("tool"))).alias("_q"))
    taken = hash_rank(rows, F.col("tool"), key, seed).join(F.broadcast(n)).filter("_r <= _q")
    return docs.join(taken.select(key).distinct(), key, "left_semi")


def split_quality(full: DataFrame, sample: DataFrame, by: Sequence[str]) -> DataFrame:
    """Chi-square of the sample's strata against the whole, and deviations in percent."""
    key = composite_key(*[F.col(c) for c in by])
    count = lambda df, name: df.groupBy(key.alias("stratum")).agg(F.count(F.lit(1)).alias(name))
    both = count(full, "all").join(count(sample, "got"), "stratum", "full_outer").fillna(0, ["all", "got"])
    totals = both.agg(F.sum("all").alias("n_all"), F.sum("got").alias("n_got"))
    rows = both.join(F.broadcast(totals)).withColumn("want", F.col("all") * F.col("n_got") / F.col("n_all"))
    gap = F.abs(F.col("all") / F.col("n_all") - F.col("got") / F.col("n_got")) * 100
    chi = F.sum(F.when(F.col("want") > 0, (F.col("got") - F.col("want")) ** 2 / F.col("want")))
    return rows.agg(F.round(chi, 3).alias("chi2_statistic"), (F.count_if(F.col("want") > 0) - 1).alias("dof"), F.round(F.max(gap), 2).alias("max_deviation_pct"), F.round(F.avg(gap), 2).alias("mean_deviation_pct"), F.count_if((F.col("all") > 0) & (F.col("got") > 0)).alias("groups_matched"), F.count(F.lit(1)).alias("total_groups"))


def chi_square_p(statistic: float, dof: int) -> float:
    """Upper tail of the chi-square distribution: series or continued fraction of the incomplete gamma."""
    a, x = dof / 2, statistic / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def balance(docs: DataFrame, by: str, strategy: str = "oversample_min", key: str = "id", seed: int = 42) -> DataFrame:
    """Groups brought to the median size: small ones repeated in hash order, or large ones cut in it."""
    if strategy == "none":
        return docs
    sizes = docs.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    middle = sizes.agg(F.floor(F.median("_n")).alias("_m"))
    rows = hash_rank(docs, F.col(by), key, seed)
    rows = rows.join(sizes.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).join(F.broadcast(middle))
    if strategy == "undersample_max":
        return rows.filter("_r <= _m OR _n <= _m").select(*docs.columns)
    if strategy != "oversample_min":
        raise ValueError(f"unknown strategy {strategy}")
    short = F.greatest(F.lit(0), F.col("_m") - F.col("_n"))
    times = 1 + F.floor(short / F.col("_n")) + F.when(F.col("_r") <= short % F.col("_n"), 1).otherwise(0)
    return rows.withColumn("_t", F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*docs.columns)


def reduce_fractions(docs: DataFrame, by: str, fractions: Sequence[float], key: str = "id", seed: int = 42) -> DataFrame:
    """Nested samples of several fractions in one pass: rows with the fraction that takes them."""
    sizes = docs.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    rows = hash_rank(docs, F.col(by), key, seed)
    rows = rows.join(sizes.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions])))
    taken = F.greatest(F.lit(1), F.bround(F.col("_n") * F.col("fraction")).cast("long"))
    return rows.filter((F.col("fraction") >= 1) | (F.col("_r") <= taken)).drop("_r", "_n", "_by")
