"""Sharding: weighted rendezvous hashing of stable record keys.

Each shard scores ``-weight / ln(u)`` for a record, u being a hash in (0, 1) of the record's key and
the shard's number; the highest score wins, ties go to the smaller shard. A new shard can only win
records for itself, so growth moves about 1/(n+1) of the records and no others.

Defined results: a null key is a key of its own (one shard for all such rows); a null text counts
no bytes and has the CRC of the empty text; equal rows each get a slot; an empty table gives no
rows; further columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_rank, parts_for, table

ROWS_PER_BUCKET = 50_000
SHARDS = 40


def _score(key: Column, shard: Column, weight: Column, seed: int) -> Column:
    h = F.xxhash64(F.lit(seed), key.isNull(), F.coalesce(key.cast("string"), F.lit("")), shard.cast("int"))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -weight / F.log(u)


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """struct(score, shard) of the winning shard for each key."""
    scored = F.transform(F.array(*[F.lit(float(w)) for w in weights]), lambda w, s: F.struct(_score(key, s, w, seed).alias("score"), (-s).alias("neg")))
    best = F.array_max(F.transform(F.array(F.lit(0)), lambda _: F.array_max(scored)))
    return F.struct(best["score"].alias("score"), (-best["neg"]).alias("shard"))


def shard(df: DataFrame, key: str, weights: Sequence[float], carry: Sequence[str] = (), grown_weight: float | None = None, seed: int = 0) -> DataFrame:
    """Rows (key, *carry, shard, grown_shard, slot): the shard of each record, its shard with one
    more shard of ``grown_weight`` (null without one), and its place there, gapless from 0."""
    n = len(weights)
    out = df.select(key, *carry, rendezvous(F.col(key), weights, seed).alias("_best"))
    grown = F.lit(None).cast("int")
    if grown_weight is not None:
        extra = _score(F.col(key), F.lit(n), F.lit(float(grown_weight)), seed)
        grown = F.when(extra > F.col("_best.score"), n).otherwise(F.col("_best.shard")).cast("int")
    out = out.select(key, *carry, F.col("_best.shard").cast("int").alias("shard"), grown.alias("grown_shard"))
    return gapless_rank(out, ["shard"], [key], parts_for(df.count(), ROWS_PER_BUCKET), "slot")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    out = shard(docs, "doc_id", [1.0] * SHARDS, ["size", "text_crc32"], 1.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
