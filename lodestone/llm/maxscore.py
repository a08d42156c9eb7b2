"""Exact top-k search by inner product with MaxScore pruning, in blocks.

Vectors become whole numbers floor(scale * x). The terms of a query are its dimensions. For each
(query block, vector shard) a task holds the shard's postings column by column and, for each query,
bounds every term's contribution by the shard's extremes. The non-essential terms are the largest set
of small-bound terms that cannot lift a vector from the shard's least possible score past the
threshold; all postings of the others are traversed, and the rest are probed for the vectors that
remain competitive, pruned again after each probe step. Per-shard lists are merged to k per query.

Pruning keeps every vector whose bound reaches the threshold, so ties are whole. Defined results:
vectors null or holding null or non-finite components take no part; missing trailing dimensions count
as 0; repeated ids are separate candidates (a query's own id is no candidate); no rows give no rows.
Scores are exact whole numbers: where a block's could pass 64 bits they are computed without a bound. A
component of 2^62 or more after scaling, or a score to be returned that no long holds, is refused with
an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts_for, ship, table

SHARD_ROWS = 8192
QUERY_ROWS = 2048
STEP = 8
LARGEST = 1 << 62


def quantized(vector: Column, scale: int) -> Column:
    def whole(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(scaled) < float(LARGEST), F.floor(scaled).cast("long")).otherwise(F.raise_error(F.lit("a component is too large to be searched")).cast("long"))

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def maxscore_shard(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of each query's k best rows of this shard, ties to smaller ids."""
    wide = max((int(np.abs(x).max()) for x in (rows, queries) if x.size), default=0)
    if wide * wide * max(1, rows.shape[1]) * 4 >= LARGEST:  # no sum or bound below may pass 64 bits
        rows, queries = rows.astype(object), queries.astype(object)
    postings = np.ascontiguousarray(rows.T)
    low, high = postings.min(axis=1), postings.max(axis=1)
    order_by_id = np.argsort(ids, kind="stable")
    for q, own in zip(queries, query_ids):
        floor_, ceil_ = np.minimum(q * low, q * high), np.maximum(q * low, q * high)
        gain = ceil_ - floor_
        terms = np.argsort(-gain, kind="stable")
        seeds = order_by_id[: 4 * k]
        seeds = seeds[ids[seeds] != own]
        exact = np.sort(rows[seeds] @ q)[::-1]
        best = int(exact[k - 1]) if len(exact) >= k else None
        rest = np.append(np.cumsum(gain[terms][::-1])[::-1], rows.dtype.type(0) if rows.dtype != object else 0) + floor_.sum()
        essential = len(terms) if best is None else int((rest >= best).sum())
        essential = min(len(terms), max(1, essential)) if len(terms) else 0
        # Scores are kept as gains over the least possible contribution of each term. The essential
        # postings are traversed for all vectors, the others a few at a time for those still competitive.
        # Rows with the query's own id have no part in the threshold.
        alive, got, done, upto, other = None, np.zeros(len(ids), dtype=rows.dtype), 0, essential, ids != own
        while done < len(terms):
            part = terms[done:upto]
            block = postings[part] if alive is None else postings[part][:, alive]
            got = got + (q[part] @ block - floor_[part].sum())
            done, upto = upto, min(len(terms), upto + STEP)
            real = got[other]
            if len(real) >= k:
                sure = (np.partition(real, len(real) - k) if real.dtype != object else np.sort(real))[len(real) - k] + floor_.sum()
                best = int(sure) if best is None else max(best, int(sure))
            if best is not None:
                keep = got + rest[done] >= best
                if not keep.all():
                    alive = np.flatnonzero(keep) if alive is None else alive[keep]
                    got, other = got[keep], other[keep]
        at = np.arange(len(ids)) if alive is None else alive
        score = got + floor_.sum()
        at, score = at[other], score[other]
        if score.dtype == object:
            first = np.array(sorted(range(len(at)), key=lambda i: (-score[i], ids[at[i]]))[:k], dtype=np.int64)
            if len(first) and max(abs(x) for x in score[first]) >= 1 << 63:
                raise ValueError("a score does not fit 64 bits")
        else:
            first = np.lexsort((ids[at], -score))[:k]
        yield int(own), ids[at][first], score[first].astype(np.int64)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """rows, queries: (id long, v array<long>). Returns (query_id, rank, vec_id, score)."""
    ship(rows.sparkSession)
    shards, blocks = parts_for(rows.count(), shard_rows), parts_for(queries.count(), query_rows)
    left = rows.select("id", "v", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_q"))
    right = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("_q").cast("int"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_s"))

    def search(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(have) and len(want):
            width = max(max(map(len, have["v"])), max(map(len, want["v"])))
            found = [pd.DataFrame({"query_id": own, "vec_id": ids, "score": score}) for own, ids, score in maxscore_shard(_matrix(want["v"], width), want["id"].to_numpy(), _matrix(have["v"], width), have["id"].to_numpy(), k)]
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    near = left.groupBy("_q", "_s").cogroup(right.withColumn("_s", F.col("_s").cast("long")).groupBy("_q", "_s")).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").alias("id"), quantized(F.col("embedding"), 256).alias("v"))
    return top_k(rows, rows.filter("id % 50 = 0"), 5)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5"""
