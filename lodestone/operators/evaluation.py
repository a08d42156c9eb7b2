"""Evaluation of ranked lists: per-query results, metric rows, comparisons, failure analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from .retrieval import hits

#: Percentage points a metric may fall; kinds of test queries.
GATE_POINTS = 2.0
KINDS = ("original", "grounded_analyst", "creative_student", "chaos_monkey")


def with_kind(queries: DataFrame) -> DataFrame:
    """A kind for each known-item query, by its place."""
    return queries.withColumn("query_type", F.array(*[F.lit(k) for k in KINDS])[F.pmod(F.floor(F.col("query_id") / 20), F.lit(len(KINDS))).cast("int")])


def results(ranked: DataFrame, queries: DataFrame, courses: DataFrame, config: str) -> DataFrame:
    """One row per query, found or not: rank of the expected id, hits, best score and its course.
    queries: (query_id, expected_id, course, topic, query_type); courses: (id, course)."""
    first = ranked.filter("rank = 1").join(courses.select(F.col("id").alias("doc_id"), F.col("course").alias("top_course")), "doc_id", "left").select("query_id", F.col("doc_id").alias("top_id"), F.col("score").alias("top_score"), "top_course")
    rows = queries.join(hits(ranked), "query_id", "left").join(first, "query_id", "left")
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("hit_ids", F.coalesce("hit_ids", none))
    return rows.select(F.lit(config).alias("config"), "query_id", "expected_id", "course", "topic", "query_type", "hit_ids", "hit_scores", M.rank_of(F.col("hit_ids"), F.col("expected_id")).alias("rank"), "top_id", "top_score", F.coalesce("top_course", F.lit("")).alias("top_course"))


def summarize(rows: DataFrame, *by: str, digits: int = 6) -> DataFrame:
    """Metric rows grouped by ``by``."""
    out = rows.groupBy(*by).agg(*M.summary(F.col("rank"), F.col("top_score"), F.col("course"), F.col("top_course")))
    return out.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Queries in both: did each side have the expected id first?"""
    side = lambda df, x: df.select("query_id", *(["query_type"] if x == "a" else []), (F.col("rank") == 1).alias(f"hit_{x}"))
    both = side(a, "a").join(side(b, "b"), "query_id")
    hit = lambda c: F.coalesce(F.col(c), F.lit(False))
    outcome = F.when(hit("hit_b") & ~hit("hit_a"), "win").when(hit("hit_a") & ~hit("hit_b"), "loss").otherwise("neutral")
    return both.select("query_id", "query_type", hit("hit_a").alias("hit_a"), hit("hit_b").alias("hit_b"), outcome.alias("outcome"))


def compare_summary(pairs: DataFrame, *by: str) -> DataFrame:
    h = {x: F.avg(F.col(f"hit_{x}").cast("double")) for x in "ab"}
    out = [F.count(F.lit(1)).alias("n"), F.round(h["a"], 4).alias("h1_a"), F.round(h["b"], 4).alias("h1_b"), F.round(h["b"] - h["a"], 4).alias("delta")]
    out += [F.count_if(F.col("outcome") == o).alias(name) for o, name in (("win", "wins"), ("loss", "losses"), ("neutral", "neutral"))]
    rows = pairs.groupBy(*by).agg(*out)
    return rows.filter("n > 0")


def regression_gate(summary: DataFrame, baseline: str, points: float = GATE_POINTS) -> DataFrame:
    """Each configuration against the baseline's first-hit rate: regressed if it fell by more than ``points``."""
    base = summary.filter(F.col("config") == baseline).select(F.col("hit_rate_1").alias("base"))
    delta = F.round((F.col("hit_rate_1") - F.col("base")) * 100, 4)
    return summary.join(F.broadcast(base)).select("config", "hit_rate_1", delta.alias("delta_points"), (delta < -points).alias("regressed"))


def failures(rows: DataFrame) -> DataFrame:
    return rows.filter("rank IS NULL").select("config", "query_id", "course", "topic", "query_type", "top_id", "top_score", "top_course")


def successes(rows: DataFrame) -> DataFrame:
    return rows.filter("rank IS NOT NULL").select("config", "query_id", "rank", F.element_at("hit_scores", F.col("rank").cast("int")).alias("score_at_rank"))


def contamination(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("top_course") != "") & (F.col("top_course") != F.col("course"))).select("config", "query_id", "course", "top_course", F.col("rank").isNotNull().alias("expected_found"))


def failure_rates(rows: DataFrame, *by: str) -> DataFrame:
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank").isNull()).alias("failures"), F.round(F.avg(F.col("rank").isNull().cast("double")), 4).alias("failure_rate"), F.round(M.share(M.hit_at(F.col("rank"), 5)), 4).alias("hit_5"))
    return out


def score_separation(rows: DataFrame, *by: str) -> DataFrame:
    mean = lambda c: F.round(F.avg(F.when(c, F.col("top_score"))), 6)
    return rows.groupBy(*by).agg(mean(F.col("rank").isNull()).alias("failure_mean"), mean(F.col("rank").isNotNull()).alias("success_mean"))


def hard_queries(rows: DataFrame, configs: int) -> DataFrame:
    """Queries that every configuration failed."""
    failed = rows.filter("rank IS NULL").groupBy("query_id").agg(F.countDistinct("config").alias("failed_by"))
    return failed.filter(F.col("failed_by") == configs)


def disagreements(rows: DataFrame) -> DataFrame:
    """Queries whose configurations have different first hits, as a map."""
    tops = rows.filter("top_id IS NOT NULL").groupBy("query_id").agg(F.countDistinct("top_id").alias("n_tops"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("config", "top_id")))).alias("tops"))
    return tops.filter("n_tops > 1")


def best_per_model(summary: DataFrame, model: str = "model") -> DataFrame:
    """The configuration with the highest mrr of each model, and the overall winner."""
    order = [F.desc("mrr"), F.col("config")]
    own = F.row_number().over(Window.partitionBy(model).orderBy(*order))
    best = summary.withColumn("_r", own).filter("_r = 1").drop("_r")
    # One row per model is left, so the last ranking is small.
    return best.withColumn("overall_winner", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) == 1)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same keys."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new)


def all_rows(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def failure_bundle(rows: DataFrame, configs: int) -> dict[str, DataFrame]:
    """All tables of a failure analysis by name."""
    return {
        "failures": failures(rows),
        "successes": successes(rows),
        "topic_failure_rates": failure_rates(rows, "topic"),
        "contamination": contamination(rows),
        "hard_queries": hard_queries(rows, configs),
        "disagreements": disagreements(rows),
        "score_separation": score_separation(rows, "config"),
    }


def leaderboard(summary: DataFrame, by: str = "mrr") -> DataFrame:
    """Configurations by a metric, with their half of the table (1 upper, 2 lower)."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(by), "config")  # one row per configuration
    return summary.select("config", by, F.row_number().over(w).alias("place"), F.ntile(2).over(w).alias("half"))


def stored_results(rows: DataFrame) -> DataFrame:
    """Per-query results as the results database keeps them: hits as JSON text."""
    return rows.select(F.concat_ws("__", F.lit("experiment"), "config").alias("run_id"), "query_id", F.to_json("hit_ids").alias("hit_ids"), F.to_json("hit_scores").alias("hit_scores"), "rank")


def joined_results(stored: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored hits opened again and joined with the corpus: hits and first hits per run and course."""
    opened = stored.select("run_id", "query_id", F.posexplode(F.from_json("hit_ids", "array<bigint>")).alias("pos", "id"))
    return opened.join(docs.select("id", "course"), "id").groupBy("run_id", "course").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("pos") == 0).alias("first_hits"))


def recommendations(imbalance_ratio: float, short_answers: int, long_share: float, troubleshooting: int, conceptual: int, low_code: list[str]) -> list[str]:
    """Advice from audit figures; an empty list if nothing stands out."""
    rules = [
        (short_answers > 10, f"Audit {short_answers} answers of fewer than 50 characters."),
        (bool(low_code), f"Check code parsing for {', '.join(low_code)}."),
        (imbalance_ratio > 5, f"Groups differ {imbalance_ratio:.1f} times in size; filter by group."),
        (troubleshooting > 2 * conceptual, "Mostly troubleshooting; favour error messages in retrieval."),
        (long_share > 0.2, "Over a fifth of the answers are long; chunk them."),
    ]
    return [text for holds, text in rules if holds]
