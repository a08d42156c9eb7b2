"""Queries over TF-IDF, entity, topic and model-comparison operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import density
from ..operators import tfidf as W
from ..operators import topics as Z
from ..operators.corpus import corpus, known_items, passages, read, vectors
from ..sources.scratch import kept
from . import sql as S

#: A dictionary of words that the test tables hold.
PATTERNS = {"TOOL": ["the", "ung", "th st"], "LANGUAGE": ["und", "que"], "CONCEPT": ["tion", "of the", "mente"], "ADMIN": ["idiot", "trash"], "ERROR": ["scum", "loser"]}
ERROR_SIGNALS = ["worthless"]
RULES = {"ERROR": ["scum", "chver"], "ADMIN": ["idi"], "LANGUAGE": ["die"], "TOOL": ["tère"], "CONCEPT": ["ación"]}
MODELS = ("kmeans_a", "kmeans_b", "kmeans_c", "kmeans_d")


def fitted(s: SparkSession, d: str) -> DataFrame:
    return W.fit(corpus(s, d), "section", "answer")


def tops(s: SparkSession, d: str, k: int = W.TOP) -> DataFrame:
    return kept(W.top_terms(fitted(s, d), "section", k))


def groups(s: SparkSession, d: str) -> int:
    return corpus(s, d).select("section").distinct().count()


def tagged(s: SparkSession, d: str) -> DataFrame:
    """All documents: topic (-1 without a vector), and the category of their dictionary entities."""
    docs = corpus(s, d)
    rows = Z.tag(docs, Z.entities(docs, "question", PATTERNS))
    rows = rows.withColumn("category", Z.first_strong_category(F.col("ner_labels")))
    return rows.join(vectors(s, d).select("id", "topic"), "id", "left").withColumn("topic", F.coalesce("topic", F.lit(-1)))


def assignments(s: SparkSession, d: str) -> DataFrame:
    """Topic rows: topics 8 and 9 count as outliers; the probability is made of the id."""
    return vectors(s, d).join(corpus(s, d).select("id", "course"), "id").select("id", F.when(F.col("topic") >= 8, -1).otherwise(F.col("topic")).alias("topic"), (F.col("id") % 100 / 100.0).alias("topic_probability"), "course")


def measures(s: SparkSession, d: str) -> DataFrame:
    """Measures of four models, made from the lineitem table's return flags and line statuses."""
    key = F.concat_ws("/", "l_returnflag", "l_linestatus")
    q = F.col("l_quantity")
    return read(s, d, "lineitem").groupBy(key.alias("model")).agg(F.round(F.avg((q > 45).cast("double")), 4).alias("outlier_ratio"), F.round(F.avg("l_discount"), 4).alias("keyword_overlap"), F.round(F.avg(F.when(q > 10, 1.0).otherwise(0.5)), 4).alias("confidence_mean"), F.countDistinct(F.col("l_suppkey") % 15).alias("cross_course_topics"))


QUERIES = {
    "tfidf_top_terms": tops,
    "tfidf_two_pass": lambda s, d: W.top_terms(W.two_pass(corpus(s, d), "section", "answer", groups(s, d)), "section", 20),
    "stop_freq": lambda s, d: W.stop_by_frequency(corpus(s, d), "answer", 0.3),
    "stop_saturation": lambda s, d: W.stop_by_saturation(tops(s, d), "section", groups(s, d)),
    "stop_idf_floor": lambda s, d: W.stop_by_idf(fitted(s, d), groups(s, d)),
    "bridge_terms": lambda s, d: W.bridges(tops(s, d), "section"),
    "uniqueness": lambda s, d: W.uniqueness(tops(s, d), "section"),
    "cooccurrence": lambda s, d: W.cooccurrence(corpus(s, d), tops(s, d), "section", "answer"),
    "course_similarity": lambda s, d: W.similarity(fitted(s, d), "section"),
    "count_baseline": lambda s, d: W.count_similarity(corpus(s, d), "section", "answer"),
    "tfidf_retrieve": lambda s, d: W.retrieve(corpus(s, d), passages(s, d), "answer", 10),
    "enrich_chunks": lambda s, d: W.best_chunks(corpus(s, d), tops(s, d), "section", "answer"),
    "shuffled_baseline": lambda s, d: W.shuffled_baseline(corpus(s, d), "course", 10),
    "ner_dictionary": lambda s, d: Z.entities(corpus(s, d), "question", PATTERNS),
    "ner_priority": lambda s, d: tagged(s, d).select("id", Z.priority_category(F.lower("question"), F.col("ner_labels"), ERROR_SIGNALS).alias("category"), "ner_primary_entity"),
    "rule_reclassify": lambda s, d: Z.reclassify(tagged(s, d).select("id", "topic", "category", "question"), "question", RULES).select("id", "new_category", "source"),
    "cluster_majority": lambda s, d: Z.majority(tagged(s, d), least=0.3),
    "missed_terms": lambda s, d: Z.missed_terms(corpus(s, d), Z.entities(corpus(s, d), "question", PATTERNS), "question", ["der", "des"], 2),
    "suggest_patterns": lambda s, d: Z.suggest(Z.missed_terms(corpus(s, d), Z.entities(corpus(s, d), "question", PATTERNS), "question", []), 1, 2000),
    "topic_validation": lambda s, d: Z.validate(assignments(s, d)),
    "topic_keyword_jaccard": lambda s, d: Z.keyword_overlap(Z.ctfidf(corpus(s, d).join(vectors(s, d).select("id", "topic"), "id"), "topic", "answer").select("topic", F.col("term").alias("word"))),
    "model_composite": lambda s, d: Z.composite(measures(s, d)),
    "fixed_thresholds": lambda s, d: Z.fixed_status(measures(s, d)),
    "adaptive_thresholds": lambda s, d: Z.adaptive_status(measures(s, d)),
    "pareto_front": lambda s, d: Z.pareto(measures(s, d)),
    "silhouette": lambda s, d: Z.silhouette(vectors(s, d)),
    "cluster_quality": lambda s, d: Z.cluster_quality(vectors(s, d)),
    "outlier_reassign": lambda s, d: Z.reassign_outliers(assignments(s, d), vectors(s, d)),
    "subtopic_keywords": lambda s, d: Z.subtopic_keywords(corpus(s, d), Z.subtopics(vectors(s, d).filter("v is not null")), "answer"),
    "kmeans_topics": lambda s, d: Z.cluster(vectors(s, d), 10),
    "density_topics": lambda s, d: density.density_topics(vectors(s, d)),
    "ctfidf_terms": lambda s, d: Z.ctfidf(corpus(s, d).join(vectors(s, d).select("id", "topic"), "id"), "topic", "answer"),
    "dense_topics": lambda s, d: Z.dense_topics(assignments(s, d)),
    "subtopics": lambda s, d: Z.subtopics(vectors(s, d)),
    "concept_notes": lambda s, d: Z.concept_notes(corpus(s, d), W.bridges(tops(s, d), "section")),
    "known_item_topics": lambda s, d: known_items(s, d).groupBy("topic").agg(F.count(F.lit(1)).alias("n")),
}

_WORDS = "regexp_extract_all(lower(answer), '[a-z0-9_]{2,}')"
_FIT = f"""w AS (SELECT id, section, {_WORDS} AS ws FROM corpus),
g AS (SELECT section, unnest(ws) AS term FROM w
  UNION ALL SELECT section, unnest(list_transform(ws[:-2], lambda x, i: x || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT section, z || ' ' || b FROM (SELECT section, ws[-1] AS z, lead(ws[1]) OVER (PARTITION BY section ORDER BY id) AS b FROM w WHERE len(ws) > 0) WHERE b IS NOT NULL),
tf AS (SELECT section, term, count(*) AS tf FROM g GROUP BY ALL),
nn AS (SELECT count(DISTINCT section) AS n FROM corpus),
df AS (SELECT term, count(*) AS df, any_value(n) AS n FROM tf CROSS JOIN nn GROUP BY term HAVING count(*) >= 2 AND count(*) <= any_value(n) * 0.85::DOUBLE),
raw AS (SELECT section, term, tf, df, n, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS raw FROM tf JOIN df USING (term)),
fit AS (SELECT section, term, tf, df, n, raw / sqrt(sum(raw * raw) OVER (PARTITION BY section)) AS score FROM raw),
tops AS (SELECT * FROM (SELECT section, row_number() OVER (PARTITION BY section ORDER BY round(score, 4) DESC, term)::INT AS rank, term, round(score, 4) AS score FROM fit) WHERE rank <= 50)"""
_f = lambda *more: S.with_(S.CORPUS, _FIT, *more)
_W1 = f"w AS (SELECT id, section, {_WORDS} AS ws FROM corpus)"
_W2 = f"w AS (SELECT id, section, list_filter(ws, lambda x: NOT list_contains(st, x)) AS ws FROM (SELECT id, section, {_WORDS} AS ws, st FROM corpus CROSS JOIN stops))"
_STOPS = f"stops AS (WITH {_FIT} SELECT coalesce(list(term), []) AS st FROM (SELECT term FROM tops GROUP BY term HAVING count(*) >= (SELECT greatest(2, floor(n * 0.6)::INT) FROM nn)))"
_LABEL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(term, '{w}')" for w in parts) + f" THEN '{name}'" for name, parts in Z.SUGGESTIONS) + " WHEN term IN (" + ", ".join(f"'{w}'" for w in Z.SUGGESTED_LANGUAGES) + ") THEN 'LANGUAGE' END"
_c = lambda *more: S.with_(S.CORPUS, S.VECTORS, *more)
_COS = "SELECT a.section AS a, b.section AS b, round(sum(a.score * b.score), 6) AS cosine FROM {0} a JOIN {0} b ON a.term = b.term AND a.section < b.section GROUP BY ALL"
_SINGLE = f"""tfd AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_WORDS}) AS term FROM corpus) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM corpus)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tfd GROUP BY term),
dw AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM tfd JOIN idf USING (term)), dn AS (SELECT id, sqrt(sum(w * w)) AS n FROM dw GROUP BY id),
qw AS (SELECT query_id, term, (1 + ln(tf)) * idf AS w FROM (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9_]{{2,}}')) AS term FROM passages) GROUP BY ALL) JOIN idf USING (term)),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY query_id)"""


def _spans() -> str:
    rows = ", ".join(f"('{t}', '{label}')" for label, terms in PATTERNS.items() for t in terms)
    return f"""dict(term, label) AS (VALUES {rows}),
toks AS (SELECT id, regexp_extract_all(lower(question), '{S.TOKEN}') AS ws FROM corpus),
spans AS (SELECT id, pos, 1 AS n, ws[pos] AS term FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM toks)
  UNION ALL SELECT id, pos, 2, ws[pos] || ' ' || ws[pos + 1] FROM (SELECT id, ws, unnest(range(1, len(ws))) AS pos FROM toks)
  UNION ALL SELECT id, pos, 3, ws[pos] || ' ' || ws[pos + 1] || ' ' || ws[pos + 2] FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS pos FROM toks)),
hit AS (SELECT id, (pos - 1)::INT AS pos, n, term, label FROM spans JOIN dict USING (term)),
b2 AS (SELECT * FROM hit h WHERE n = 2 AND NOT EXISTS (SELECT 1 FROM hit o WHERE o.id = h.id AND o.n = 2 AND o.pos = h.pos - 1)),
ents AS (SELECT * FROM b2 UNION ALL SELECT h.* FROM hit h WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM b2 o WHERE o.id = h.id AND o.pos <= h.pos AND h.pos < o.pos + 2))"""


_TAGGED = f"""{_spans()},
lists AS (SELECT id, list(label ORDER BY pos) AS labels, list(term ORDER BY pos) AS terms FROM ents GROUP BY id),
tagged AS (SELECT c.*, coalesce(v.topic, -1) AS topic, coalesce(labels, []) AS labels, terms[1] AS ner_primary_entity,
  coalesce(list_filter(labels, lambda x: x IN ('ADMIN', 'ERROR', 'TOOL', 'LANGUAGE'))[1], CASE WHEN list_contains(labels, 'CONCEPT') THEN 'CONCEPT' END, 'OTHER') AS category
  FROM corpus c LEFT JOIN lists USING (id) LEFT JOIN vecs v USING (id))"""
_ASSIGN = "asg AS (SELECT v.id, CASE WHEN topic >= 8 THEN -1 ELSE topic END AS topic, v.id % 100 / 100.0::DOUBLE AS topic_probability, course FROM vecs v JOIN corpus c USING (id))"
_MEASURES = """ms AS (SELECT l_returnflag || '/' || l_linestatus AS model, round(avg((l_quantity > 45)::INT), 4) AS outlier_ratio, round(avg(l_discount), 4) AS keyword_overlap,
  round(avg(CASE WHEN l_quantity > 10 THEN 1.0::DOUBLE ELSE 0.5 END), 4) AS confidence_mean, count(DISTINCT l_suppkey % 15) AS cross_course_topics FROM lineitem GROUP BY 1)"""
_CT = r"""cw AS (SELECT topic, unnest(regexp_extract_all(lower(answer), '[\p{L}\p{N}_]{2,}')) AS term FROM corpus JOIN vecs USING (id)),
ctf AS (SELECT topic, term, count(*) AS tf FROM cw GROUP BY ALL),
cs AS (SELECT *, sum(tf) OVER (PARTITION BY topic) AS w, sum(tf) OVER (PARTITION BY term) AS f, (SELECT avg(w) FROM (SELECT sum(tf) AS w FROM ctf GROUP BY topic)) AS a FROM ctf),
ct AS (SELECT * FROM (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY round(tf / w::DOUBLE * ln(1 + a / f::DOUBLE), 9) DESC, term)::INT AS rank, term, round(tf / w::DOUBLE * ln(1 + a / f::DOUBLE), 9) AS score FROM cs) WHERE rank <= 10)"""
_word = lambda sig, col: f"regexp_matches({col}, '\\b{sig}\\b')" if len(sig) <= 3 else f"contains({col}, '{sig}')"
ORACLES = {
    "tfidf_top_terms": _f() + "SELECT * FROM tops",
    "tfidf_two_pass": S.with_(S.CORPUS, _STOPS, _FIT.replace(_W1, _W2)) + "SELECT * FROM tops WHERE rank <= 20",
    "stop_freq": S.with_(S.CORPUS) + f"SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest({_WORDS}) AS term FROM corpus) GROUP BY term HAVING count(*) >= 5 AND count(*) >= 0.3::DOUBLE * (SELECT count(*) FROM corpus)",
    "stop_saturation": _f() + "SELECT term, count(*) AS groups FROM tops GROUP BY term HAVING count(*) >= (SELECT greatest(2, floor(n * 0.6)::INT) FROM nn)",
    "stop_idf_floor": _f("i AS (SELECT DISTINCT term, df, round(ln((1.0::DOUBLE + n) / (1 + df)) + 1, 9) AS idf FROM fit)") + "SELECT term, df FROM i WHERE idf <= (SELECT quantile_cont(idf, 0.03) FROM i)",
    "bridge_terms": _f() + "SELECT term, count(*) AS n_groups, round(avg(score), 6) AS mean_score, list(section ORDER BY section) AS groups FROM tops WHERE rank <= 25 GROUP BY term HAVING count(*) >= 2",
    "uniqueness": _f("t AS (SELECT section, count(*) OVER (PARTITION BY term) AS n FROM tops WHERE rank <= 25)") + "SELECT section, round(count(*) FILTER (WHERE n = 1) / 25.0::DOUBLE, 3) AS uniqueness FROM t GROUP BY section",
    "cooccurrence": _f("l AS (SELECT section, list(term) AS terms FROM tops WHERE rank <= 10 GROUP BY section)", "m AS (SELECT section, len(terms) AS k, len(list_filter(terms, lambda t: contains(lower(answer), t))) AS m FROM corpus JOIN l USING (section))") + "SELECT section, round(avg(CASE WHEN k >= 2 THEN m * (m - 1) / (k * (k - 1))::DOUBLE ELSE 0 END), 4) AS cooccurrence FROM m GROUP BY section",
    "course_similarity": _f() + _COS.format("fit"),
    "count_baseline": S.with_(S.CORPUS, f"t AS (SELECT section, term, count(*) AS tf FROM (SELECT section, unnest({_WORDS}) AS term FROM corpus) GROUP BY ALL)", "u AS (SELECT section, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY section)) AS score FROM t)") + _COS.format("u"),
    "tfidf_retrieve": S.with_(S.CORPUS, S.PASSAGES, _SINGLE, S.ranked("out", "SELECT q.query_id, d.id AS doc_id, round(sum(d.w * q.w) / (any_value(dn.n) * any_value(qn.n)), 6) AS score FROM dw d JOIN qw q USING (term) JOIN dn ON dn.id = d.id JOIN qn ON qn.query_id = q.query_id GROUP BY q.query_id, d.id", 10)) + "SELECT * FROM out",
    "enrich_chunks": _f("o AS (SELECT c.section, t.term, c.id, ((length(answer) - length(replace(lower(answer), t.term, ''))) // length(t.term))::BIGINT AS n FROM corpus c JOIN tops t ON t.section = c.section AND rank <= 10)") + "SELECT section, term, id, n AS occurrences FROM o WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY section, term ORDER BY n DESC, id) = 1",
    "ner_dictionary": _c(_spans()) + "SELECT id, pos, term, label FROM ents",
    "ner_priority": _c(_TAGGED) + "SELECT id, CASE WHEN list_contains(labels, 'ADMIN') THEN 'ADMIN' WHEN contains(lower(question), 'worthless') THEN 'ERROR' WHEN list_contains(labels, 'LANGUAGE') THEN 'LANGUAGE' WHEN list_contains(labels, 'TOOL') THEN 'TOOL' WHEN list_contains(labels, 'CONCEPT') THEN 'CONCEPT' ELSE 'OTHER' END AS category, ner_primary_entity FROM tagged",
    "cluster_majority": _c(_TAGGED, "n AS (SELECT topic, category, count(*) AS n, sum(count(*)) OVER (PARTITION BY topic) AS total FROM tagged WHERE topic <> -1 GROUP BY topic, category)") + "SELECT topic, category AS majority FROM (SELECT * FROM n WHERE category <> 'OTHER' QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, category) = 1) WHERE n >= 0.3::DOUBLE * total",
    "rule_reclassify": _c(_TAGGED, "n AS (SELECT topic, category, count(*) AS n, sum(count(*)) OVER (PARTITION BY topic) AS total FROM tagged WHERE topic <> -1 GROUP BY topic, category)", "maj AS (SELECT topic, category AS majority FROM (SELECT * FROM n WHERE category <> 'OTHER' QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, category) = 1) WHERE n >= 0.8::DOUBLE * total)", "r AS (SELECT t.*, majority, CASE " + " ".join("WHEN " + " OR ".join(_word(w, "regexp_replace(trim(lower(question)), '[^\\x00-\\x7f]', CASE WHEN true THEN chr(48) END, 'g')" if len(w) <= 3 else "trim(lower(question))") for w in RULES[n]) + f" THEN '{n}'" for n in Z.RULE_ORDER) + " END AS rule FROM tagged t LEFT JOIN maj USING (topic))") + "SELECT id, CASE WHEN category <> 'OTHER' THEN category ELSE coalesce(rule, majority, 'OTHER') END AS new_category, CASE WHEN category <> 'OTHER' THEN 'unchanged' WHEN rule IS NOT NULL THEN 'rules' WHEN majority IS NOT NULL THEN 'cluster' ELSE 'fallback' END AS source FROM r",
    "missed_terms": _c(_spans()) + r"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(lower(question), '[^\x00-\x7f]', '0', 'g'), '\b[a-z][a-z]{2,}\b')) AS term FROM corpus WHERE id NOT IN (SELECT id FROM ents)) WHERE term NOT IN ('der', 'des') GROUP BY term HAVING count(*) >= 2",
    "suggest_patterns": _c(_spans(), r"missed AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(lower(question), '[^\x00-\x7f]', '0', 'g'), '\b[a-z][a-z]{2,}\b')) AS term FROM corpus WHERE id NOT IN (SELECT id FROM ents)) GROUP BY term ORDER BY n DESC, term LIMIT 2000)") + f"SELECT * FROM (SELECT term, n, {_LABEL} AS label FROM missed) WHERE label IS NOT NULL",
    "topic_validation": _c(_ASSIGN, "z AS (SELECT topic, count(*) AS n, count(DISTINCT course) AS k FROM asg WHERE topic <> -1 GROUP BY topic)") + """SELECT t.*, s.*, round(outlier_count / total_documents::DOUBLE, 4) AS outlier_ratio, round(size_max / total_documents::DOUBLE, 4) AS largest_topic_share
  FROM (SELECT count(*) AS total_documents, count(*) FILTER (WHERE topic = -1) AS outlier_count, round(avg(topic_probability) FILTER (WHERE topic <> -1), 4) AS confidence_mean, count(*) FILTER (WHERE topic <> -1 AND topic_probability < 0.5) AS low_confidence_count FROM asg) t
  CROSS JOIN (SELECT count(*) AS num_topics, min(n) AS size_min, max(n) AS size_max, round(avg(n), 1) AS size_mean, round(median(n), 1) AS size_median, round(stddev_samp(n), 1) AS size_std, count(*) FILTER (WHERE n <= 3) AS tiny_topics, count(*) FILTER (WHERE k > 1) AS cross_course_topics FROM z) s""",
    "ctfidf_terms": _c(_CT) + "SELECT * FROM ct",
    "topic_keyword_jaccard": _c(_CT, "k AS (SELECT topic, list(DISTINCT term) AS ws FROM ct GROUP BY topic)") + "SELECT round(avg(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))::DOUBLE), 4) AS keyword_overlap FROM k a JOIN k b ON a.topic < b.topic",
    "model_composite": S.with_(_MEASURES) + "SELECT *, round((" + " + ".join(f"{w}::DOUBLE * CASE WHEN max({m}) OVER () = min({m}) OVER () THEN 1.0 ELSE " + (f"({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ())::DOUBLE" if m == "confidence_mean" else f"1 - ({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ())::DOUBLE") + " END" for m, w in Z.WEIGHTS.items()) + ") / 1.0, 6) AS composite FROM ms",
    "fixed_thresholds": S.with_(_MEASURES) + "SELECT * EXCLUDE v, CASE v WHEN 0 THEN 'OK' WHEN 1 THEN 'WARN' ELSE 'FAIL' END AS status FROM (SELECT *, 2 * (outlier_ratio >= 0.15)::INT + (keyword_overlap >= 0.1)::INT + (confidence_mean < 0.7)::INT + (cross_course_topics > 10)::INT AS v FROM ms)",
    "adaptive_thresholds": S.with_(_MEASURES) + "SELECT * EXCLUDE v, CASE v WHEN 0 THEN 'OK' WHEN 1 THEN 'WARN' ELSE 'FAIL' END AS status FROM (SELECT *, (outlier_ratio > (SELECT quantile_cont(outlier_ratio, 0.75) FROM ms))::INT + (keyword_overlap > (SELECT quantile_cont(keyword_overlap, 0.75) FROM ms))::INT + (confidence_mean < (SELECT quantile_cont(confidence_mean, 0.25) FROM ms))::INT + (cross_course_topics > 10)::INT AS v FROM ms)",
    "pareto_front": S.with_(_MEASURES) + "SELECT model FROM ms r WHERE NOT EXISTS (SELECT 1 FROM ms o WHERE o.outlier_ratio <= r.outlier_ratio AND o.keyword_overlap <= r.keyword_overlap AND o.confidence_mean >= r.confidence_mean AND (o.outlier_ratio < r.outlier_ratio OR o.keyword_overlap < r.keyword_overlap OR o.confidence_mean > r.confidence_mean))",
    "known_item_topics": S.with_(S.BASE) + "SELECT topic, count(*) AS n FROM known GROUP BY topic",
    "shuffled_baseline": _c("l AS (SELECT list(DISTINCT course ORDER BY course) AS ls FROM corpus)", "dl AS (SELECT run, ls[(('0x' || substr(md5('42:' || run || ':' || id), 1, 8))::BIGINT % len(ls)) + 1] AS course FROM corpus CROSS JOIN l CROSS JOIN range(1, 11) r(run))", "m AS (SELECT run, course, count(*) AS m FROM dl GROUP BY ALL)") + "SELECT course, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS sd, any_value(n) AS n FROM m JOIN (SELECT course, count(*) AS n FROM corpus GROUP BY course) USING (course) GROUP BY course",
    "silhouette": _c("u AS (SELECT id, topic, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM vecs)", "d AS (SELECT topic, i, avg(x) AS x FROM (SELECT topic, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u) GROUP BY ALL)", "c AS (SELECT topic, list(x ORDER BY i) AS m FROM d GROUP BY topic)", "s AS (SELECT u.id, min(1 - list_cosine_similarity(u.v, c.m)) FILTER (WHERE c.topic = u.topic) AS a, min(1 - list_cosine_similarity(u.v, c.m)) FILTER (WHERE c.topic <> u.topic) AS b FROM u CROSS JOIN c GROUP BY u.id)") + "SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, (SELECT count(DISTINCT topic) FROM vecs) AS topics FROM s",
    "cluster_quality": S.with_(S.VECTORS, "pr AS (SELECT a.id, a.topic AS t, b.topic AS o, avg(1 - list_cosine_similarity(a.v, b.v)) AS d FROM vecs a JOIN vecs b ON a.id <> b.id GROUP BY ALL)", "sl AS (SELECT id, min(d) FILTER (WHERE t = o) AS a, min(d) FILTER (WHERE t <> o) AS b FROM pr GROUP BY id)", "mi AS (SELECT topic, i, avg(x) AS x FROM (SELECT topic, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs) GROUP BY ALL)", "c AS (SELECT topic, list(x ORDER BY i) AS m FROM mi GROUP BY topic)", "w AS (SELECT topic, m, avg(list_distance(v, m)) AS s FROM vecs JOIN c USING (topic) GROUP BY topic, m)", "r AS (SELECT p.topic, max((p.s + q.s) / nullif(list_distance(p.m, q.m), 0)) AS r FROM w p JOIN w q ON p.topic <> q.topic GROUP BY p.topic)") + "SELECT (SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) FROM sl WHERE b IS NOT NULL) AS silhouette, (SELECT round(avg(r), 6) FROM r) AS davies_bouldin, (SELECT count(*) FROM w) AS topics",
    "outlier_reassign": _c(_ASSIGN, "d AS (SELECT topic, i, avg(x) AS x FROM (SELECT a.topic, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs JOIN asg a USING (id) WHERE a.topic <> -1) GROUP BY ALL)", "c AS (SELECT topic, list(x ORDER BY i) AS m FROM d GROUP BY topic)", "b AS (SELECT a.id, c.topic, round(list_cosine_similarity(v, m), 6) AS s FROM asg a JOIN vecs USING (id) CROSS JOIN c WHERE a.topic = -1 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(v, m), 6) DESC, c.topic) = 1)") + "SELECT id, topic, topic_probability FROM asg WHERE topic <> -1 UNION ALL SELECT id, CASE WHEN s >= 0.1 THEN topic ELSE -1 END, s FROM b",
    "dense_topics": _c(_ASSIGN) + "SELECT topic, count(*) AS n FROM asg WHERE topic <> -1 GROUP BY topic ORDER BY n DESC, topic LIMIT 5",
    "concept_notes": _f("br AS (SELECT term FROM tops WHERE rank <= 25 GROUP BY term HAVING count(*) >= 2)", "h AS (SELECT id, term FROM (SELECT DISTINCT id, unnest(ws) AS term FROM w) JOIN br USING (term))") + "SELECT id, 'Concepts: ' || array_to_string(list(term ORDER BY term)[:3], ', ') AS note FROM h GROUP BY id",
}
