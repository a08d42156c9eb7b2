"""Queries over generation, ablation, usage, source and relational operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import uuid5_dns
from ..operators import ablation as B
from ..operators import generate as G
from ..operators import retrieval as R
from ..operators.corpus import corpus, keyword_index, known_items, passages, read, vectors
from ..sources import scans
from ..sources.scratch import folder
from ..streaming import limits, run, usage
from . import sql as S
from .mining import tagged

ANSWER = {"question": 0.0, "answer": 1.0}
TEMPLATE = "Question: {question}\n\nContext:\n{context}\n\nAnswer in a few words."
KIND = "CASE doc_id % 4 WHEN 0 THEN 'original' WHEN 1 THEN 'grounded_analyst' WHEN 2 THEN 'creative_student' ELSE 'chaos_monkey' END"


def contexts(s: SparkSession, d: str) -> DataFrame:
    return G.pack_context(R.bm25(keyword_index(s, d), passages(s, d), 10, ANSWER), corpus(s, d))


def prompts(s: SparkSession, d: str) -> DataFrame:
    """Prompts with the whole packed context."""
    rows = contexts(s, d).join(passages(s, d), "query_id")
    return rows.select("query_id", G.prompt(TEMPLATE, question=F.col("query_text"), context=F.col("context")).alias("prompt"))


def chat_contexts(s: SparkSession, d: str) -> DataFrame:
    """Each conversation as a context: its turns in order, while they fit."""
    rows = read(s, d, "conversations")
    key = F.concat_ws("-", "conv_id", "turn", "role")
    ranked = rows.select(F.col("conv_id").alias("query_id"), key.alias("doc_id"), F.col("turn").alias("rank"))
    return G.pack_context(ranked, rows.select(key.alias("id"), "text"), "text")


def judged(s: SparkSession, d: str) -> DataFrame:
    """Judge rows made of the labels: two scores and a kind of query per document."""
    return read(s, d, "labels").select("doc_id", F.col("quality").cast("double").alias("faithfulness"), (1 - F.col("toxic")).cast("double").alias("factual_correctness"), F.expr(KIND).alias("query_type"), F.when(F.col("doc_id") % 2 == 0, "concise").otherwise("detailed").alias("style"), (F.col("doc_id") % 3 + 1).cast("int").alias("top_k"), (F.col("doc_id") % 97 * 1.5).alias("latency_ms"), (F.col("doc_id") % 41).alias("tokens"))


def assigned(s: SparkSession, d: str) -> DataFrame:
    return tagged(s, d).select("id", "topic", (F.col("id") % 100 / 100.0).alias("topic_probability"), F.col("category").alias("ner_category"), "ner_primary_entity")


def fallback_rows(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents")
    return docs.select(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 1, "").alias("expected_id"), F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") + 1).cast("string")).alias("expected_doc_id"), F.col("doc_id").cast("string").alias("id"))


def loaded_tests(s: SparkSession, d: str) -> DataFrame:
    """The query loader on passages: expected document id = passage number, every fifth out of domain."""
    rows = read(s, d, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("id"), F.col("text").alias("question"), F.lit("a").alias("answer"), F.lit("eng").alias("course"), F.when(F.col("item_id") % 2 == 0, F.col("item_id") * 1000).otherwise(F.col("item_id")).cast("string").alias("expected_doc_id"), (F.col("item_id") % 5 == 0).alias("is_ood"))
    return scans.test_set(rows, corpus(s, d), {"eng": "en"}).select("id", "expected_id", "course", "query_type", "is_ood")


def replies(s: SparkSession, d: str) -> DataFrame:
    """A judge's reply for each row of the conversations: scores alone, in a fence after the text, none, the
    first alone on the last line, or broken off."""
    text = F.coalesce("text", F.lit(""))
    first = F.concat(F.lit('{"faithfulness": '), (F.length(text) % 5 / 4.0).cast("string"))
    both = F.concat(first, F.lit(', "factual_correctness": '), (F.col("turn") % 4 / 4.0).cast("string"), F.lit("}"))
    forms = [both, F.concat(text, F.lit("\n```json\n"), both, F.lit("\n```")), text, F.concat(text, F.lit("\n"), first, F.lit("}")), F.lit('{"faithfulness": broken')]
    return read(s, d, "conversations").select("conv_id", "turn", F.element_at(F.array(*forms), (F.col("turn") % 5 + 1).cast("int")).alias("reply"))


def stream_windows(s: SparkSession, d: str) -> DataFrame:
    base = f"{folder(s)}/stream-{uuid.uuid4().hex}"
    return run.drain(s, d, "events.parquet", read(s, d, "events"), lambda x: usage.minute_windows(x, "value").withColumn("tokens", F.round("tokens", 4)), "append", f"{base}/out", f"{base}/ck")


def stream_rolling(s: SparkSession, d: str) -> DataFrame:
    base = f"{folder(s)}/stream-{uuid.uuid4().hex}"
    return run.drain(s, d, "events.parquet", read(s, d, "events"), lambda x: limits.rolling_stream(x, "user_id", "value", late="0 seconds"), "append", f"{base}/out", f"{base}/ck")


def stream_days(s: SparkSession, d: str) -> DataFrame:
    base = f"{folder(s)}/stream-{uuid.uuid4().hex}"
    return run.drain(s, d, "events.parquet", read(s, d, "events"), usage.day_windows, "complete", f"{base}/out", f"{base}/ck")


def stream_once(s: SparkSession, d: str) -> DataFrame:
    base = f"{folder(s)}/stream-{uuid.uuid4().hex}"
    return run.drain(s, d, "events.parquet", read(s, d, "events"), lambda x: usage.once(x, "event_id", "60 days").select("event_id", "event_type"), "append", f"{base}/out", f"{base}/ck")


def stream_cooldown(s: SparkSession, d: str) -> DataFrame:
    base = f"{folder(s)}/stream-{uuid.uuid4().hex}"
    return run.drain(s, d, "events.parquet", read(s, d, "events"), lambda x: usage.cooldown_stream(x, "user_id", "event_type = 'error'"), "complete", f"{base}/out", f"{base}/ck")


def star_revenue(s: SparkSession, d: str) -> DataFrame:
    li, o, c, n = (read(s, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("lines"))


def star_set_ops(s: SparkSession, d: str) -> DataFrame:
    o, c = read(s, d, "orders").select(F.col("o_custkey").alias("k")), read(s, d, "customer").select(F.col("c_custkey").alias("k"))
    named = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).withColumn("op", F.lit(n))
    return named(c.intersect(o), "intersect").unionByName(named(c.subtract(o), "difference")).unionByName(named(c.union(o).distinct(), "union"))


QUERIES = {
    "context_pack": contexts,
    "context_pack_chat": chat_contexts,
    "prompt_assemble": prompts,
    "llm_generate": lambda s, d: G.call_model(prompts(s, d), "query_id"),
    "judge_parse": lambda s, d: replies(s, d).select("conv_id", "turn", G.parse_scores(F.col("reply")).alias("x")).select("conv_id", "turn", "x.*"),
    "judge_summary": lambda s, d: G.judge_summary(judged(s, d)),
    "judge_by_type": lambda s, d: G.judge_by_type(judged(s, d)),
    "sweep_summary": lambda s, d: G.sweep_summary(judged(s, d)),
    "sweep_rows": lambda s, d: G.sweep(passages(s, d).select("query_id"), ["concise", "detailed"], [1, 3, 5]),
    "strategy_map": lambda s, d: G.by_strategy(read(s, d, "conversations").select(F.col("conv_id").alias("id"), F.col("role").alias("strategy"), F.md5("text").alias("variation"))),
    "ablation_patches": lambda s, d: B.experiments(assigned(s, d), B.SUITE + B.RERUN_SUITE[:1]).groupBy("experiment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("topic") == -1).alias("no_topic"), F.count_if(F.col("ner_category") == "OTHER").alias("other"), F.count("ner_primary_entity").alias("entities")),
    "ablation_filtered_search": lambda s, d: R.knn(B.Patch(null_low_confidence=True).apply(assigned(s, d)).select("id", "topic").join(vectors(s, d).select("id", "v"), "id"), known_items(s, d), 10, must=["topic"]),
    "rolling_rate_window": lambda s, d: usage.rolling(read(s, d, "events"), "user_id", "value").select("event_id", "window_requests", "window_tokens", "limited"),
    "daily_usage_pt": lambda s, d: usage.daily(read(s, d, "events"), "value"),
    "cooldown_state": lambda s, d: usage.cooldowns(read(s, d, "events"), "user_id", "event_type = 'error'"),
    "props_json": lambda s, d: read(s, d, "events").groupBy(F.from_json("props", "k long")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n")),
    "expected_id_fallback": lambda s, d: fallback_rows(s, d).select("id", scans.expected_id("expected_id", "expected_doc_id", "id").alias("expected")),
    "test_set_load": loaded_tests,
    "content_cache_key": lambda s, d: scans.content_key(corpus(s, d), "question", "course"),
    "point_ids": lambda s, d: corpus(s, d).select("id", uuid5_dns(F.col("id").cast("string")).alias("point_id")),
    "semi_valid_ids": lambda s, d: read(s, d, "labels").join(read(s, d, "documents"), "doc_id", "left_semi").select("doc_id", "quality"),
    "anti_missing_ner": lambda s, d: read(s, d, "documents").join(read(s, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang"),
    "left_default_join": lambda s, d: read(s, d, "documents").join(read(s, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic")),
    "star_revenue": star_revenue,
    "star_set_ops": star_set_ops,
    "star_top_orders": lambda s, d: R.top(read(s, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score")), 3),
    "stream_window": stream_windows,
    "stream_rolling": stream_rolling,
    "stream_days": stream_days,
    "stream_dedupe": stream_once,
    "stream_cooldown": stream_cooldown,
}

_CUT = r"""cutt AS (SELECT id, CASE WHEN length(a) > 1000 THEN regexp_replace(substr(a, 1, 1000), ' [^ ]*$', '', 's') || '...' ELSE a END AS t
  FROM (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(answer, '^To resolve this issue:\s*\n?', ''), '^To fix this:\s*\n?', ''), '^Solution:\s*\n?', ''), '^\s+', ''), '\s+$', '') AS a FROM {0}))"""
_PACK = """fit AS (SELECT query_id, rank, t, sum(length(t)) OVER (PARTITION BY query_id ORDER BY rank) AS s FROM {0} r JOIN cutt ON cutt.id = r.doc_id),
ctx AS (SELECT q.query_id, coalesce(context, 'No relevant documents found.') AS context, coalesce(n_docs, 0) AS n_docs FROM (SELECT DISTINCT query_id FROM {0}) q
  LEFT JOIN (SELECT query_id, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_docs FROM fit WHERE s <= 3000 GROUP BY query_id) USING (query_id))"""
_CTX = S.with_(S.CORPUS, S.PASSAGES, S.bm25("b10", 10, ANSWER, "passages"), _CUT.format("corpus"), _PACK.format("b10"))
_JUDGED = f"""j AS (SELECT doc_id, quality::DOUBLE AS faithfulness, (1 - toxic)::DOUBLE AS factual_correctness, {KIND} AS query_type,
  CASE WHEN doc_id % 2 = 0 THEN 'concise' ELSE 'detailed' END AS style, (doc_id % 3 + 1)::INT AS top_k, doc_id % 97 * 1.5::DOUBLE AS latency_ms, doc_id % 41 AS tokens FROM labels)"""


def _ablation() -> str:
    from .mining import _TAGGED

    case = {
        "baseline": ("topic", "ner_category", "ner_primary_entity"),
        "no_entity": ("topic", "ner_category", "NULL"),
        "no_category": ("topic", "'OTHER'", "ner_primary_entity"),
        "no_topics": ("-1", "ner_category", "ner_primary_entity"),
        "no_generic_entity": ("topic", "ner_category", "CASE WHEN ner_primary_entity NOT IN ('error', 'homework', 'course', 'model', 'project', 'issue') THEN ner_primary_entity END"),
        "low_conf_04": ("CASE WHEN p < 0.4 THEN -1 ELSE topic END", "ner_category", "ner_primary_entity"),
        "low_conf_05": ("CASE WHEN p < 0.5 THEN -1 ELSE topic END", "ner_category", "ner_primary_entity"),
        "skip_ner": ("topic", "'OTHER'", "NULL"),
    }
    rows = " UNION ALL ".join(f"SELECT '{n}' AS experiment, {t} AS topic, {c} AS cat, {e} AS ent FROM a" for n, (t, c, e) in case.items())
    return S.with_(S.CORPUS, S.VECTORS, _TAGGED, "a AS (SELECT id, topic, id % 100 / 100.0::DOUBLE AS p, category AS ner_category, ner_primary_entity FROM tagged)") + f"SELECT experiment, count(*) AS n, count(*) FILTER (WHERE topic = -1) AS no_topic, count(*) FILTER (WHERE cat = 'OTHER') AS other, count(ent) AS entities FROM ({rows}) GROUP BY experiment"


ORACLES = {
    "context_pack": _CTX + "SELECT * FROM ctx",
    "context_pack_chat": S.with_("chat AS (SELECT conv_id || '-' || turn || '-' || role AS id, text AS answer FROM conversations)", _CUT.format("chat"), "cr AS (SELECT conv_id AS query_id, conv_id || '-' || turn || '-' || role AS doc_id, turn AS rank FROM conversations)", _PACK.format("cr")) + "SELECT * FROM ctx",
    "prompt_assemble": _CTX + "SELECT query_id, 'Question: ' || query_text || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Answer in a few words.' AS prompt FROM ctx JOIN passages USING (query_id)",
    "judge_parse": "SELECT conv_id, turn, CASE WHEN turn % 5 IN (0, 1, 3) THEN length(coalesce(text, '')) % 5 / 4.0::DOUBLE ELSE 0 END AS faithfulness, CASE WHEN turn % 5 IN (0, 1) THEN turn % 4 / 4.0::DOUBLE ELSE 0 END AS factual_correctness FROM conversations",
    "judge_summary": S.with_(_JUDGED) + "SELECT count(*) AS n, round(coalesce(avg(faithfulness), 0), 3) AS mean_faithfulness, round(coalesce(avg(factual_correctness), 0), 3) AS mean_factual, round(coalesce(avg((faithfulness + factual_correctness) / 2) FILTER (WHERE query_type <> 'chaos_monkey'), 0), 3) AS composite, round(coalesce(avg(factual_correctness) FILTER (WHERE query_type = 'chaos_monkey'), 0), 3) AS composite_chaos FROM j",
    "judge_by_type": S.with_(_JUDGED) + "SELECT query_type, count(*) AS n, round(avg(faithfulness), 3) AS faithfulness, round(avg(factual_correctness), 3) AS factual_correctness FROM j GROUP BY query_type",
    "sweep_summary": S.with_(_JUDGED) + "SELECT *, row_number() OVER (ORDER BY combined DESC, style, top_k) = 1 AS best FROM (SELECT style, top_k, count(*) AS n, round(avg(faithfulness), 3) AS faithfulness, round(avg(factual_correctness), 3) AS factual_correctness, round(median(latency_ms), 3) AS latency_p50, round(avg(tokens), 1) AS tokens, round(avg((faithfulness + factual_correctness) / 2), 6) AS combined FROM j GROUP BY style, top_k)",
    "sweep_rows": S.with_(S.PASSAGES) + "SELECT query_id, style, top_k FROM passages CROSS JOIN (VALUES ('concise'), ('detailed')) s(style) CROSS JOIN (VALUES (1), (3), (5)) k(top_k)",
    "strategy_map": "SELECT id, map_from_entries(list((strategy, v) ORDER BY strategy)) AS variations, sum(len(v))::BIGINT AS n FROM (SELECT conv_id AS id, role AS strategy, list(md5(text) ORDER BY md5(text)) AS v FROM conversations GROUP BY ALL) GROUP BY id",
    "ablation_patches": _ablation(),
    "ablation_filtered_search": S.with_(S.BASE, "pv AS (SELECT id, v, CASE WHEN id % 100 / 100.0::DOUBLE < 0.5 THEN -1 ELSE topic END AS topic FROM vecs JOIN corpus USING (id))", S.ranked("out", "SELECT q.query_id, d.id AS doc_id, round(list_cosine_similarity(d.v, q.v), 6) AS score FROM pv d JOIN known q ON q.v IS NOT NULL AND d.topic = q.topic", 10)) + "SELECT * FROM out",
    "rolling_rate_window": "SELECT event_id, count(*) OVER w AS window_requests, round(sum(value) OVER w, 4) AS window_tokens, count(*) OVER w >= 9 OR round(sum(value) OVER w, 4) > 240000 AS limited FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)",
    "daily_usage_pt": "SELECT (CASE WHEN ts < TIMESTAMP '2024-03-10 10:00:00' OR ts >= TIMESTAMP '2024-11-03 09:00:00' THEN ts - INTERVAL 8 HOURS ELSE ts - INTERVAL 7 HOURS END)::DATE AS day, count(*) AS requests, round(sum(value), 4) AS tokens, count(*) >= 240 AS limited FROM events GROUP BY 1",
    "cooldown_state": "SELECT user_id, max(ts + INTERVAL 60 SECONDS) AS until FROM events WHERE event_type = 'error' GROUP BY user_id",
    "props_json": "SELECT (props::JSON ->> 'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1",
    "expected_id_fallback": "SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR WHEN doc_id % 2 = 0 THEN (doc_id + 1)::VARCHAR ELSE doc_id::VARCHAR END AS expected FROM documents",
    "test_set_load": S.with_("t AS (SELECT 'q' || item_id AS id, CASE WHEN item_id % 2 = 0 THEN item_id * 1000 ELSE item_id END AS e, item_id % 5 = 0 AS is_ood FROM benchmark)") + "SELECT id, e::VARCHAR AS expected_id, 'en' AS course, 'original' AS query_type, is_ood FROM t WHERE is_ood OR e IN (SELECT doc_id FROM documents)",
    "content_cache_key": S.with_(S.CORPUS) + "SELECT course, substr(md5(string_agg(question || '|||', '' ORDER BY question)), 1, 12) AS cache_key FROM corpus GROUP BY course",
    "semi_valid_ids": "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)",
    "point_ids": S.with_(S.CORPUS) + f"SELECT id, {S.UUID5} AS point_id FROM corpus",
    "anti_missing_ner": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "left_default_join": "SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "star_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "star_set_ops": "SELECT 'intersect' AS op, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'difference', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'union', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)",
    "star_top_orders": S.with_(S.ranked("out", "SELECT o_custkey AS query_id, o_orderkey AS doc_id, o_totalprice AS score FROM orders", 3)) + "SELECT * FROM out",
    "stream_rolling": "SELECT event_id, count(*) OVER w AS window_requests, round(sum(value) OVER w, 4) AS window_tokens, count(*) OVER w >= 9 OR round(sum(value) OVER w, 4) > 240000 AS limited FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)",
    "stream_window": """SELECT make_timestamp(s * 1000000) AS start, make_timestamp((s + 60) * 1000000) AS "end", event_type, count(*) AS requests, round(sum(value), 4) AS tokens
  FROM (SELECT event_type, value, epoch_us(ts) // 10000000 * 10 - 10 * i AS s FROM events, range(6) r(i)) GROUP BY ALL HAVING s + 60 <= (SELECT epoch_ms(max(ts)) / 1000.0::DOUBLE - 600 FROM events)""",
    "stream_dedupe": "SELECT DISTINCT event_id, event_type FROM events",
    "stream_days": "SELECT (CASE WHEN ts < TIMESTAMP '2024-03-10 10:00:00' OR ts >= TIMESTAMP '2024-11-03 09:00:00' THEN ts - INTERVAL 8 HOURS ELSE ts - INTERVAL 7 HOURS END)::DATE AS day, count(*) AS requests FROM events GROUP BY 1",
    "stream_cooldown": "SELECT user_id, max(ts + INTERVAL 60 SECONDS) AS until FROM events WHERE event_type = 'error' GROUP BY user_id",
}
