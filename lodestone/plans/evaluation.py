"""Queries over evaluation operators: three configurations on the known-item queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators.corpus import corpus, keyword_index, known_items, passages, read, vectors
from . import sql as S

ANSWER = {"question": 0.0, "answer": 1.0}
CONFIGS = ("bm25", "hybrid", "vector")


def result_rows(spark: SparkSession, sf: str, configs: tuple[str, ...] = CONFIGS) -> DataFrame:
    docs, vecs = corpus(spark, sf), vectors(spark, sf)
    asked = E.with_kind(known_items(spark, sf)).withColumn("expected_id", F.col("query_id"))
    v, b = R.knn_rows(vecs, asked, 10), R.bm25(keyword_index(spark, sf), asked, 10, ANSWER)
    lists = {"vector": v, "bm25": b, "hybrid": R.rrf(v, b, 10)}
    queries = asked.select("query_id", "expected_id", "course", "topic", "query_type")
    return E.all_rows([E.results(lists[c], queries, docs.select("id", "course"), c) for c in configs])


def versioned(spark: SparkSession, sf: str) -> DataFrame:
    rows = result_rows(spark, sf)  # one search for both versions
    old = E.summarize(rows.filter("config IN ('bm25', 'vector')"), "config").select("config", "mrr").withColumn("version", F.lit(1))
    new = E.summarize(rows.filter("config IN ('hybrid', 'vector')"), "config").select("config", "mrr").withColumn("version", F.lit(2))
    return E.upsert(old, new, ["config"])


def latency(spark: SparkSession, sf: str, *by: str) -> DataFrame:
    return read(spark, sf, "events").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[M.nearest_rank(p, "value").alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)])


def models(spark: SparkSession, sf: str) -> DataFrame:
    """Metric rows by (model, config), the course standing for a model."""
    return E.summarize(result_rows(spark, sf).withColumn("model", F.col("course")), "model", "config").select("model", "config", "mrr")


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates retrieved once, reranked by several scorers."""
    docs, asked = corpus(spark, sf), known_items(spark, sf)
    pool = R.bm25(keyword_index(spark, sf), asked, 40, ANSWER)
    scorers = {"overlap_answer": "answer", "overlap_question": "question"}
    return E.all_rows([R.rerank(pool, asked, docs, 5, text=t).withColumn("reranker", F.lit(n)) for n, t in scorers.items()])


def bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each table of the failure analysis."""
    tables = E.failure_bundle(result_rows(spark, sf), len(CONFIGS))
    return E.all_rows([t.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name)) for name, t in tables.items()])


def pairs(s: SparkSession, d: str) -> DataFrame:
    both = result_rows(s, d, ("bm25", "vector"))
    return E.compare(both.filter("config = 'bm25'"), both.filter("config = 'vector'"))


QUERIES = {
    "ir_metrics": lambda s, d: E.summarize(result_rows(s, d), "config"),
    "ir_metrics_by_topic": lambda s, d: E.summarize(result_rows(s, d), "config", "topic"),
    "hit_by_query_type": lambda s, d: result_rows(s, d).groupBy("config", "query_type").agg(F.count(F.lit(1)).alias("n"), F.round(M.share(F.try_element_at("hit_ids", F.lit(1)) == F.col("expected_id")), 4).alias("h1")),
    "latency_percentiles": lambda s, d: latency(s, d),
    "latency_by_type": lambda s, d: latency(s, d, "event_type"),
    "ab_compare": pairs,
    "ab_summary": lambda s, d: E.compare_summary(pairs(s, d)),
    "ab_breakdown": lambda s, d: E.compare_summary(pairs(s, d), "query_type"),
    "regression_gate": lambda s, d: E.regression_gate(E.summarize(result_rows(s, d), "config"), "vector"),
    "query_failures": lambda s, d: E.failures(result_rows(s, d)),
    "query_successes": lambda s, d: E.successes(result_rows(s, d)),
    "contamination": lambda s, d: E.contamination(result_rows(s, d)),
    "topic_failure_rates": lambda s, d: E.failure_rates(result_rows(s, d), "topic"),
    "failure_rates_by_type": lambda s, d: E.failure_rates(result_rows(s, d), "config", "query_type"),
    "hard_queries": lambda s, d: E.hard_queries(result_rows(s, d, ("bm25", "vector")), 2),
    "disagreements": lambda s, d: E.disagreements(result_rows(s, d)),
    "score_separation": lambda s, d: E.score_separation(result_rows(s, d), "config"),
    "best_per_model": lambda s, d: E.best_per_model(models(s, d)),
    "summary_upsert": versioned,
    "rerank_matrix": matrix,
    "failure_bundle": bundle,
    "leaderboard": lambda s, d: E.leaderboard(E.summarize(result_rows(s, d), "config")),
    "results_join": lambda s, d: E.joined_results(E.stored_results(result_rows(s, d)), corpus(s, d)),
    "diverse_retrieve": lambda s, d: R.diverse(R.bm25(keyword_index(s, d), passages(s, d), 40, ANSWER), corpus(s, d), 10, 4, "section"),
    "projection": lambda s, d: R.project(vectors(s, d)),
}

_LISTS = [S.BASE, S.knn("l_vector", 10), S.bm25("l_bm25", 10, ANSWER), S.rrf("l_hybrid", "l_vector", "l_bm25", 10)]


def _res(configs: tuple[str, ...] = CONFIGS, name: str = "res") -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS config, * FROM l_{c}" for c in configs)
    configs_sql = ", ".join(f"('{c}')" for c in configs)
    return f"""{name}_l AS ({parts}),
{name}_h AS (SELECT config, query_id, list(doc_id ORDER BY rank) AS hit_ids, list(score ORDER BY rank) AS hit_scores, min(CASE WHEN doc_id = query_id THEN rank END)::BIGINT AS rank,
  min(CASE WHEN rank = 1 THEN doc_id END) AS top_id, min(CASE WHEN rank = 1 THEN score END) AS top_score FROM {name}_l GROUP BY config, query_id),
{name} AS (SELECT k.config, q.query_id, q.query_id AS expected_id, q.course, q.topic,
  (['original', 'grounded_analyst', 'creative_student', 'chaos_monkey'])[(q.query_id // 20) % 4 + 1] AS query_type,
  coalesce(hit_ids, []) AS hit_ids, hit_scores, rank, top_id, top_score, coalesce(c.course, '') AS top_course
  FROM known q CROSS JOIN (VALUES {configs_sql}) k(config) LEFT JOIN {name}_h h ON h.config = k.config AND h.query_id = q.query_id LEFT JOIN corpus c ON c.id = h.top_id)"""


def _sum(source: str, *by: str) -> str:
    rates = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate_{k}" for k in (1, 3, 5, 10))
    ndcg = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 6) AS ndcg_{k}" for k in (1, 5, 10))
    return f"""SELECT {', '.join(by)}, count(*) AS num_queries, {rates}, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, {ndcg},
  round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS map_score, round(coalesce(stddev_samp(coalesce(rank, 11)), 0), 6) AS rank_std,
  count(*) FILTER (WHERE rank IS NULL) AS failure_count, round(avg(CASE WHEN rank IS NULL THEN top_score END), 6) AS avg_failure_similarity,
  round(avg(CASE WHEN top_course <> '' AND top_course <> course THEN 1.0::DOUBLE ELSE 0 END), 6) AS cross_course_contamination
  FROM {source} GROUP BY {', '.join(by)}"""


_w = lambda *more: S.with_(*_LISTS, *more)
_PAIRS = """pairs AS (SELECT a.query_id, a.query_type, coalesce(a.rank = 1, false) AS hit_a, coalesce(b.rank = 1, false) AS hit_b FROM ra a JOIN rb b USING (query_id)),
cmp AS (SELECT *, CASE WHEN hit_b AND NOT hit_a THEN 'win' WHEN hit_a AND NOT hit_b THEN 'loss' ELSE 'neutral' END AS outcome FROM pairs)"""
_AB = [_res(("bm25",), "ra"), _res(("vector",), "rb"), _PAIRS]
_ABSUM = """count(*) AS n, round(avg(hit_a::INT), 4) AS h1_a, round(avg(hit_b::INT), 4) AS h1_b, round(avg(hit_b::INT) - avg(hit_a::INT), 4) AS delta,
  count(*) FILTER (WHERE outcome = 'win') AS wins, count(*) FILTER (WHERE outcome = 'loss') AS losses, count(*) FILTER (WHERE outcome = 'neutral') AS neutral FROM cmp"""
_RATES = """count(*) AS n, count(*) FILTER (WHERE rank IS NULL) AS failures, round(avg((rank IS NULL)::INT), 4) AS failure_rate,
  round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_5 FROM res"""
_LAT = "count(*) AS n, coalesce(quantile_disc(value, 0.5), 0) AS p50, coalesce(quantile_disc(value, 0.95), 0) AS p95, coalesce(quantile_disc(value, 0.99), 0) AS p99 FROM events"
ORACLES = {
    "ir_metrics": _w(_res()) + _sum("res", "config"),
    "ir_metrics_by_topic": _w(_res()) + _sum("res", "config", "topic"),
    "hit_by_query_type": _w(_res()) + "SELECT config, query_type, count(*) AS n, round(avg(CASE WHEN hit_ids[1] = expected_id THEN 1.0::DOUBLE ELSE 0 END), 4) AS h1 FROM res GROUP BY config, query_type",
    "latency_percentiles": f"SELECT {_LAT}",
    "latency_by_type": f"SELECT event_type, {_LAT} GROUP BY event_type",
    "ab_compare": _w(*_AB) + "SELECT * FROM cmp",
    "ab_summary": _w(*_AB) + f"SELECT {_ABSUM} HAVING count(*) > 0",
    "ab_breakdown": _w(*_AB) + f"SELECT query_type, {_ABSUM} GROUP BY query_type",
    "regression_gate": _w(_res(), f"m AS ({_sum('res', 'config')})") + "SELECT m.config, m.hit_rate_1, round((m.hit_rate_1 - b.hit_rate_1) * 100, 4) AS delta_points, round((m.hit_rate_1 - b.hit_rate_1) * 100, 4) < -2.0 AS regressed FROM m CROSS JOIN (SELECT hit_rate_1 FROM m WHERE config = 'vector') b",
    "query_failures": _w(_res()) + "SELECT config, query_id, course, topic, query_type, top_id, top_score, top_course FROM res WHERE rank IS NULL",
    "query_successes": _w(_res()) + "SELECT config, query_id, rank, hit_scores[rank] AS score_at_rank FROM res WHERE rank IS NOT NULL",
    "contamination": _w(_res()) + "SELECT config, query_id, course, top_course, rank IS NOT NULL AS expected_found FROM res WHERE top_course <> '' AND top_course <> course",
    "topic_failure_rates": _w(_res()) + f"SELECT topic, {_RATES} GROUP BY topic",
    "failure_rates_by_type": _w(_res()) + f"SELECT config, query_type, {_RATES} GROUP BY config, query_type",
    "hard_queries": _w(_res(("bm25", "vector"))) + "SELECT query_id, count(DISTINCT config) AS failed_by FROM res WHERE rank IS NULL GROUP BY query_id HAVING count(DISTINCT config) = 2",
    "disagreements": _w(_res()) + "SELECT query_id, count(DISTINCT top_id) AS n_tops, map_from_entries(list((config, top_id) ORDER BY config)) AS tops FROM res WHERE top_id IS NOT NULL GROUP BY query_id HAVING count(DISTINCT top_id) > 1",
    "score_separation": _w(_res()) + "SELECT config, round(avg(CASE WHEN rank IS NULL THEN top_score END), 6) AS failure_mean, round(avg(CASE WHEN rank IS NOT NULL THEN top_score END), 6) AS success_mean FROM res GROUP BY config",
    "best_per_model": _w(_res(), f"m AS (SELECT * FROM ({_sum('res', 'course', 'config')}))", "b AS (SELECT course AS model, config, mrr FROM m QUALIFY row_number() OVER (PARTITION BY course ORDER BY mrr DESC, config) = 1)") + "SELECT *, row_number() OVER (ORDER BY mrr DESC, config) = 1 AS overall_winner FROM b",
    "summary_upsert": _w(_res(), f"m AS ({_sum('res', 'config')})") + "SELECT config, mrr, CASE WHEN config = 'bm25' THEN 1 ELSE 2 END AS version FROM m",
    "rerank_matrix": S.with_(S.BASE, S.bm25("b40", 40, ANSWER), S.rerank("ra", "b40", 5), S.rerank("rq", "b40", 5).replace("lower(answer)", "lower(question)")) + "SELECT *, 'overlap_answer' AS reranker FROM ra UNION ALL SELECT *, 'overlap_question' FROM rq",
    "failure_bundle": _w(_res()) + """SELECT 'failures' AS part, count(*) AS n FROM res WHERE rank IS NULL UNION ALL SELECT 'successes', count(*) FROM res WHERE rank IS NOT NULL
  UNION ALL SELECT 'topic_failure_rates', (SELECT count(*) FROM (SELECT DISTINCT topic FROM res)) UNION ALL SELECT 'contamination', count(*) FROM res WHERE top_course <> '' AND top_course <> course
  UNION ALL SELECT 'hard_queries', count(*) FROM (SELECT query_id FROM res WHERE rank IS NULL GROUP BY query_id HAVING count(DISTINCT config) = 3)
  UNION ALL SELECT 'disagreements', count(*) FROM (SELECT query_id FROM res WHERE top_id IS NOT NULL GROUP BY query_id HAVING count(DISTINCT top_id) > 1) UNION ALL SELECT 'score_separation', count(DISTINCT config) FROM res""",
    "leaderboard": _w(_res(), f"m AS ({_sum('res', 'config')})") + "SELECT config, mrr, row_number() OVER (ORDER BY mrr DESC, config)::INT AS place, ntile(2) OVER (ORDER BY mrr DESC, config)::INT AS half FROM m",
    "results_join": _w(_res(), "h AS (SELECT config, unnest(hit_ids) AS id, generate_subscripts(hit_ids, 1) AS pos FROM res)") + "SELECT 'experiment__' || config AS run_id, c.course, count(*) AS hits, count(*) FILTER (WHERE pos = 1) AS first_hits FROM h JOIN corpus c USING (id) GROUP BY ALL",
    "diverse_retrieve": S.with_(S.CORPUS, S.PASSAGES, S.bm25("b40", 40, ANSWER, "passages"), S.ranked("out", "SELECT b.query_id, b.doc_id, b.score FROM b40 b JOIN corpus c ON c.id = b.doc_id QUALIFY row_number() OVER (PARTITION BY b.query_id, section ORDER BY b.score DESC, b.doc_id) <= 4", 10)) + "SELECT * FROM out",
}
