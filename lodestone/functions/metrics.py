"""Retrieval metrics as column expressions over (expected, ordered hits)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A miss counts as this rank in the spread of ranks.
MISS_RANK = 11


def rank_of(hits: Column, expected: Column) -> Column:
    """1-based place of the expected id, null on a miss."""
    return F.nullif(F.array_position(hits, expected), F.lit(0).cast("long"))


def hit_at(rank: Column, k: int) -> Column:
    return F.coalesce(rank <= k, F.lit(False))


def reciprocal_rank(rank: Column) -> Column:
    return F.coalesce(1.0 / rank, F.lit(0.0))


def ndcg_at(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0 / F.log2(rank + 1)).otherwise(0.0)


def safe_mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def nearest_rank(p: float, column: str) -> Column:
    """Nearest-rank percentile; 0.0 of nothing."""
    return F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})"), F.lit(0.0))


def code_integrity(text: Column) -> Column:
    """Share of fenced blocks that are not blank; 1.0 without fences."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```[\w+#-]*\s*\n?(.*?)```"), F.lit(1))
    kept = F.filter(blocks, lambda b: F.trim(F.translate(b, "\n\t\r", "   ")) != "")
    return F.when(F.size(blocks) == 0, 1.0).otherwise(F.size(kept) / F.size(blocks))


def summary(rank: Column, scores_top: Column, query_course: Column, top_course: Column, latency: str | None = None) -> list[Column]:
    """All aggregates of one metric row; use in one groupBy().agg()."""
    out = [F.count(F.lit(1)).alias("num_queries")]
    out += [share(hit_at(rank, k)).alias(f"hit_rate_{k}") for k in (1, 3, 5, 10)]
    out += [F.avg(reciprocal_rank(rank)).alias("mrr")]
    out += [F.avg(ndcg_at(rank, k)).alias(f"ndcg_{k}") for k in (1, 5, 10)]
    out += [F.avg(reciprocal_rank(rank)).alias("map_score")]
    out += [F.coalesce(F.stddev_samp(F.coalesce(rank, F.lit(MISS_RANK)).cast("double")), F.lit(0.0)).alias("rank_std")]
    out += [F.count_if(rank.isNull()).alias("failure_count"), F.avg(F.when(rank.isNull(), scores_top)).alias("avg_failure_similarity")]
    out += [share((top_course != "") & (top_course != query_course)).alias("cross_course_contamination")]
    if latency:
        out += [nearest_rank(p, latency).alias(f"latency_p{round(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return out
