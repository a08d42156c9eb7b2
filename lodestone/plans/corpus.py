"""Queries over text functions, audits, dedup and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..operators import audit as A
from ..operators import dedup as D
from ..operators import sampling as P
from ..operators.corpus import corpus, read
from . import sql as S

COURSES = ["en", "de", "fr"]
INTENTS = {"troubleshooting": ["the", "tion"], "setup": ["der", "ung"], "conceptual": ["que", "eau"], "homework": ["ción"]}
SIGNALS = {"ERROR": ["tion", "ß"], "ADMIN": ["eau"], "CONCEPT": ["the "]}
def coded(s: SparkSession, d: str) -> DataFrame:
    """Every document as a note with code: its first line, its whole text in a fence tagged with its
    language, and its source as inline code. (id, t)"""
    given = lambda c: F.coalesce(c, F.lit(""))
    return corpus(s, d).select("id", F.concat(given("question"), F.lit("\n```"), given("course"), F.lit("\n"), given("answer"), F.lit("\n``` `"), given("section"), F.lit("`")).alias("t"))


def normalized(s: SparkSession, d: str) -> DataFrame:
    return corpus(s, d).select("id", F.md5(T.normalize(F.col("answer"))).alias("digest"), T.normalize(F.col("question")).alias("question"))


def near(s: SparkSession, d: str) -> DataFrame:
    return D.near_duplicates(corpus(s, d))


def scoped(s: SparkSession, d: str) -> DataFrame:
    docs = corpus(s, d)
    one = lambda aware: D.block_sizes(docs, aware).agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("documents")).withColumn("course_aware", F.lit(aware))
    return one(True).unionByName(one(False))


def exact(s: SparkSession, d: str) -> DataFrame:
    rows = corpus(s, d).groupBy(T.normalize(F.col("answer")).alias("t")).agg(F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("copies"))
    return rows.filter("copies > 1").select("kept_id", "copies")


QUERIES = {
    "normalize_text": normalized,
    "strip_markup": lambda s, d: corpus(s, d).select("id", T.clean_markup(F.col("answer")).alias("cleaned")),
    "strip_code": lambda s, d: coded(s, d).select("id", T.strip_code(F.col("t")).alias("stripped")),
    "code_integrity": lambda s, d: coded(s, d).select("id", F.round(M.code_integrity(F.col("t")), 6).alias("integrity")),
    "html_strip": lambda s, d: read(s, d, "pages").select("page_id", T.page_text(F.col("html")).alias("text")),
    "expand_urls": lambda s, d: read(s, d, "pages").select("page_id", T.expand_urls(F.col("url")).alias("opened")),
    "uuid_ids": lambda s, d: corpus(s, d).select("id", T.index_id(F.col("id").cast("string")).alias("point_id")),
    "snippets": lambda s, d: corpus(s, d).select("id", T.snippet(F.col("answer"), F.lit("the"), 40).alias("snippet")),
    "encode_text": lambda s, d: corpus(s, d).select("id", F.md5(T.encode_text(F.col("question"), F.col("answer"), "qa")).alias("qa"), T.composite_key(F.col("course"), F.col("section")).alias("key"), T.slug(F.concat_ws("/", "course", "section")).alias("slug"), T.text_bar(F.length("answer").cast("double"), F.lit(40000.0)).alias("bar")),
    "dedup_blocks": lambda s, d: D.block_sizes(corpus(s, d)),
    "dedup_exact": exact,
    "dedup_near": near,
    "dedup_global_vs_scoped": scoped,
    "dataset_validate": lambda s, d: A.validate(corpus(s, d), COURSES),
    "metadata_audit": lambda s, d: A.metadata(corpus(s, d)),
    "content_audit": lambda s, d: A.content(corpus(s, d)),
    "length_stats": lambda s, d: A.length_stats(corpus(s, d), "course", "answer"),
    "length_buckets": lambda s, d: A.length_buckets(corpus(s, d), "answer", "course"),
    "answer_signals": lambda s, d: A.answer_signals(corpus(s, d), "course"),
    "code_share": lambda s, d: A.code_share(corpus(s, d), "course"),
    "code_misses": lambda s, d: A.code_misses(corpus(s, d), ["the", "thst", "der", "eau"]),
    "short_answers": lambda s, d: A.short_answers(corpus(s, d)),
    "imbalance": lambda s, d: A.imbalance(corpus(s, d), "course"),
    "intent_counts": lambda s, d: A.intent_counts(corpus(s, d), "course", INTENTS),
    "len_corr": lambda s, d: A.correlation(corpus(s, d)),
    "word_freq": lambda s, d: A.word_freq(corpus(s, d), "answer", 50),
    "fenced_languages": lambda s, d: A.fenced_languages(coded(s, d).withColumnRenamed("t", "answer")),
    "inline_code": lambda s, d: A.inline_code(coded(s, d).withColumnRenamed("t", "answer")),
    "code_blocks": lambda s, d: A.code_blocks(coded(s, d).withColumnRenamed("t", "answer"), "id"),
    "diagnostic_classes": lambda s, d: A.signal_reclassify(corpus(s, d), "question", SIGNALS).groupBy("category").agg(F.count(F.lit(1)).alias("n")),
    "count_by_course_section": lambda s, d: corpus(s, d).groupBy("course", "section").agg(F.count(F.lit(1)).alias("n")),
    "stratified_alloc": lambda s, d: P.allocate(corpus(s, d), ["course", "section"], 200, 1, 8),
    "stratified_sample": lambda s, d: P.stratified_sample(corpus(s, d), ["course", "section"], 200).select("id", "course", "section"),
    "fraction_sample": lambda s, d: P.fraction_sample(corpus(s, d), "course", 0.15).select("id", "course"),
    "split_chi2": lambda s, d: P.split_quality(corpus(s, d), P.stratified_sample(corpus(s, d), ["course", "section"], 200), ["course"]),
    "balance_corpus": lambda s, d: P.balance(corpus(s, d), "course").groupBy("course", "id").agg(F.count(F.lit(1)).alias("copies")),
    "undersample_corpus": lambda s, d: P.balance(corpus(s, d), "course", "undersample_max").select("course", "id"),
    "homework_filter": lambda s, d: P.without_homework(corpus(s, d), word="src1").groupBy("section").agg(F.count(F.lit(1)).alias("n")),
    "tool_quota": lambda s, d: P.tool_quota(corpus(s, d).withColumn("tools", F.array_intersect(F.regexp_extract_all(F.lower("question"), F.lit(r"[a-z]+"), F.lit(0)), F.array(*[F.lit(w) for w in ("the", "and", "der", "de")]))), "tools", 40).select("id"),
    "signature_parse": lambda s, d: corpus(s, d).select("id", T.parse_signature(T.signature(F.col("course"), F.col("section"), F.concat_ws("_", F.lit("base"), "id"))).alias("x")).select("id", "x.*"),
    "corpus_fractions": lambda s, d: P.reduce_fractions(corpus(s, d), "course", [1.0, 0.8, 0.6, 0.4, 0.2]).groupBy("fraction", "course").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum")),
}

NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"
_c = lambda *more: S.with_(S.CORPUS, *more)
_CODED = "m AS (SELECT id, coalesce(question, '') || chr(10) || '```' || coalesce(course, '') || chr(10) || coalesce(answer, '') || chr(10) || '``` `' || coalesce(section, '') || '`' AS t FROM corpus)"
_m = lambda *more: S.with_(S.CORPUS, _CODED, *more)


def _markup() -> str:
    sql = "answer"
    for pattern, with_ in T._MARKUP:
        options = "'gs'" if pattern.startswith("(?s)") else "'gm'" if pattern.startswith("(?m)") else "'g'"
        bare = pattern.removeprefix("(?s)").removeprefix("(?m)")
        to = {"": "''", "$1": r"'\1'", "\n\n": "chr(10) || chr(10)"}[with_]
        sql = f"regexp_replace({sql}, '{bare}', {to}, {options})"
    return sql


_SHARE = """g AS (SELECT coalesce(course, 'unknown') || '::' || coalesce(section, 'unknown') AS stratum, count(*) AS pool FROM corpus GROUP BY 1),
t AS (SELECT sum(pool)::BIGINT AS total FROM g),
b AS (SELECT *, floor({top}greatest(1.0::DOUBLE, least(pool / total::DOUBLE * 200, pool::DOUBLE)){end})::BIGINT AS base FROM g CROSS JOIN t),
r AS (SELECT *, base < pool{room} AS room FROM b),
u AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY pool DESC, stratum) AS turn, 200 - sum(base) OVER () AS missing FROM r),
alloc AS (SELECT stratum, pool, (base + CASE WHEN room AND turn <= missing THEN 1 ELSE 0 END)::BIGINT AS allocated FROM u)"""
_ALLOC, _FREE = _SHARE.format(top="least(", end=", 8.0::DOUBLE)", room=" AND base < 8"), _SHARE.format(top="", end="", room="")
_HASH = "md5('42:' || id::VARCHAR), id"
_SAMPLED = f"""s AS (SELECT id, course, section FROM (SELECT c.*, allocated, row_number() OVER (PARTITION BY stratum ORDER BY {_HASH}) AS r
  FROM (SELECT *, coalesce(course, 'unknown') || '::' || coalesce(section, 'unknown') AS stratum FROM corpus) c JOIN alloc USING (stratum)) WHERE r <= allocated)"""
_RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY {_HASH}) AS r, count(*) OVER (PARTITION BY course) AS n FROM corpus)"
_MEDIAN = "mid AS (SELECT floor(median(n))::BIGINT AS m FROM (SELECT count(*) AS n FROM corpus GROUP BY course))"
_bool = lambda words, c="lower(question)": " OR ".join(f"contains({c}, '{w}')" for w in words)
_URL = r"https?://|(?:[a-z0-9_-]+\.){2,}[a-z]{2,}(?:[/:.@][\w.-]*)*"
ORACLES = {
    "expand_urls": f"SELECT page_id, array_to_string(list_transform(string_split_regex(url, '{_URL}'), lambda p, i: p || coalesce(translate(regexp_extract_all(url, '{_URL}')[i], '/:.@', '    '), '')), '') AS opened FROM pages",
    "uuid_ids": _c() + f"SELECT id, {S.UUID5} AS point_id FROM corpus",
    "normalize_text": _c() + f"SELECT id, md5({NORM.format('answer')}) AS digest, {NORM.format('question')} AS question FROM corpus",
    # For texts without fences, as the tables' are; fences are tested on fixtures.
    "strip_markup": _c() + "SELECT id, trim(" + _markup() + ", ' ' || chr(10)) AS cleaned FROM corpus",
    "strip_code": _m() + r"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(t, '```.*?```', ' ', 'gs'), '`[^`]*`', ' ', 'g'), '\s+', ' ', 'g')) AS stripped FROM m",
    "code_integrity": _m() + r"""SELECT id, round(CASE WHEN len(b) = 0 THEN 1.0 ELSE len(list_filter(b, lambda x: trim(x, ' ' || chr(10) || chr(9)) <> '')) / len(b)::DOUBLE END, 6) AS integrity
  FROM (SELECT id, regexp_extract_all(t, '```[\w+#-]*\s*\n?((?:.|\n)*?)```', 1) AS b FROM m)""",
    "html_strip": r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', ' ', 'gsi'), '<style.*?</style>', ' ', 'gsi'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""",
    "snippets": _c() + "SELECT id, CASE WHEN p > 0 THEN translate(substr(answer, greatest(p - 40, 1), p - greatest(p - 40, 1) + 43), chr(10), ' ') END AS snippet FROM (SELECT *, instr(lower(answer), 'the') AS p FROM corpus)",
    "encode_text": _c() + "SELECT id, md5(question || ' ' || answer) AS qa, coalesce(course, 'unknown') || '::' || coalesce(section, 'unknown') AS key, translate(course || '/' || section, '/-.', '___') AS slug, repeat('#', floor(length(answer) / 40000.0::DOUBLE * 30)::INT) AS bar FROM corpus",
    "dedup_blocks": _c() + f"SELECT {NORM.format('question')} || chr(1) || course AS block, count(*) AS n, min(id) AS first_id FROM corpus GROUP BY 1 HAVING count(*) > 1",
    "dedup_exact": _c() + f"SELECT min(id) AS kept_id, count(*) AS copies FROM corpus GROUP BY {NORM.format('answer')} HAVING count(*) > 1",
    "dedup_global_vs_scoped": _c() + f"""SELECT count(*) AS blocks, sum(n)::BIGINT AS documents, true AS course_aware FROM (SELECT count(*) AS n FROM corpus GROUP BY {NORM.format('question')}, course HAVING count(*) > 1)
  UNION ALL SELECT count(*), sum(n)::BIGINT, false FROM (SELECT count(*) AS n FROM corpus GROUP BY {NORM.format('question')} HAVING count(*) > 1)""",
    "dataset_validate": _c() + r"""SELECT count(*) AS n, count(*) FILTER (WHERE id IS NULL OR coalesce(question, '') SIMILAR TO '\s*' OR coalesce(answer, '') SIMILAR TO '\s*' OR coalesce(course, '') SIMILAR TO '\s*') AS empty_required,
  count(*) FILTER (WHERE length(trim(answer)) < 10) AS short_answers, count(*) FILTER (WHERE course NOT IN ('en', 'de', 'fr')) AS unknown_course,
  count(*) FILTER (WHERE contains(answer, '<{') OR contains(answer, '<IMAGE')) AS artifacts, (SELECT count(*) FROM (SELECT id FROM corpus GROUP BY id HAVING count(*) > 1)) AS duplicate_ids FROM corpus""",
    "metadata_audit": _c() + "SELECT count(*) FILTER (WHERE id IS NULL) AS missing_ids, count(id) - count(DISTINCT id) AS duplicate_ids, count(*) FILTER (WHERE course IS NULL OR trim(course) = '') AS missing_courses, count(DISTINCT course) AS n_courses, count(*) FILTER (WHERE section IS NULL OR trim(section) = '') AS missing_sections, count(DISTINCT section) AS n_sections FROM corpus",
    "content_audit": _c() + r"""SELECT count(*) FILTER (WHERE trim(answer) = '') AS empty_answers, count(*) FILTER (WHERE lower(trim(answer)) IN ('todo', 'coming soon', 'n/a', 'tbd', 'fixme', 'placeholder', 'see above', 'see below')) AS placeholder_answers,
  count(*) FILTER (WHERE length(answer) - length(regexp_replace(answer, '[ \t\n\r\f\v]', '', 'g')) > length(answer) * 0.5) AS excessive_whitespace,
  sum(length(answer) - length(regexp_replace(answer, '[\x00-\x1f\x7f]', '', 'g')))::BIGINT AS control_chars, count(*) FILTER (WHERE length(answer) < 10 OR length(answer) > 2000) AS length_outliers,
  count(*) FILTER (WHERE (length(question) < 20 AND length(answer) > 1000) OR (length(question) > 200 AND length(answer) < 50)) AS ratio_outliers FROM corpus""",
    "length_stats": _c() + "SELECT course, count(*) AS n, min(l) AS min, max(l) AS max, round(avg(l), 1) AS mean, l_all[floor(count(*) / 10.0)::INT + 1] AS p10, l_all[floor(count(*) / 2.0)::INT + 1] AS p50, l_all[floor(count(*) * 9 / 10.0)::INT + 1] AS p90 FROM (SELECT course, length(answer) AS l FROM corpus) JOIN (SELECT course, list(length(answer) ORDER BY length(answer)) AS l_all FROM corpus GROUP BY course) USING (course) GROUP BY course, l_all",
    "length_buckets": _c() + "SELECT course, CASE WHEN length(answer) < 50 THEN 'very_short' WHEN length(answer) < 200 THEN 'short' WHEN length(answer) < 800 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n FROM corpus GROUP BY ALL",
    "answer_signals": _c() + r"SELECT course, count(*) FILTER (WHERE contains(answer, '```')) AS has_code_block, count(*) FILTER (WHERE contains(answer, 'http')) AS has_url, count(*) FILTER (WHERE regexp_matches(answer, '[*\-]\s|\d+\.')) AS has_list FROM corpus GROUP BY course",
    "code_share": _c() + "SELECT course, count(*) AS total, count(*) FILTER (WHERE contains(answer, '```') OR contains(lower(answer), '<code>')) AS with_code, round(avg((contains(answer, '```') OR contains(lower(answer), '<code>'))::INT) * 100, 2) AS code_pct FROM corpus GROUP BY course",
    "code_misses": _c() + "SELECT id, substr(question, 1, 100) AS question, course, list_sort(list_distinct(list_intersect(regexp_extract_all(lower(question), '[a-z]+'), ['the', 'thst', 'der', 'eau']))) AS matched FROM corpus WHERE NOT contains(answer, '```') AND NOT contains(lower(answer), '<code>') AND len(list_intersect(regexp_extract_all(lower(question), '[a-z]+'), ['the', 'thst', 'der', 'eau'])) > 0 ORDER BY id LIMIT 50",
    "short_answers": _c() + "SELECT id, course, length(answer) AS answer_length FROM corpus WHERE length(trim(answer)) < 50",
    "imbalance": _c() + "SELECT course, n, round(n / sum(n) OVER () * 100, 1) AS pct, round(n / min(n) OVER ()::DOUBLE, 2) AS weight_vs_smallest, round(max(n) OVER () / min(n) OVER ()::DOUBLE, 4) AS max_min_ratio, max(n) OVER () / min(n) OVER ()::DOUBLE > 3 AS imbalanced FROM (SELECT course, count(*) AS n FROM corpus GROUP BY course)",
    "intent_counts": _c("i AS (SELECT course, unnest(CASE WHEN len(f) = 0 THEN ['other'] ELSE f END) AS intent FROM (SELECT course, list_filter([" + ", ".join(f"CASE WHEN {_bool(w)} THEN '{n}' END" for n, w in INTENTS.items()) + "], lambda x: x IS NOT NULL) AS f FROM corpus))") + "SELECT course, intent, count(*) AS n, grouping(course) = 1 AS overall FROM i GROUP BY GROUPING SETS ((intent), (course, intent))",
    "len_corr": _c() + "SELECT count(*) AS n, round(corr(length(question), length(answer)), 3) AS pearson_r FROM corpus",
    "word_freq": _c() + r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(lower(answer), '[^\x00-\x7f]', '0', 'g'), '\b[a-z][a-z-]*[a-z]\b')) AS word FROM corpus) WHERE length(word) > 2 AND NOT list_contains(string_split('" + " ".join(A.STOPLIST) + "', ' '), word) GROUP BY word ORDER BY n DESC, word LIMIT 50",
    "fenced_languages": _m() + r"SELECT CASE WHEN l = '' THEN 'unknown' ELSE l END AS lang, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '```(\w*)', 1)) AS l FROM m) GROUP BY 1 ORDER BY n DESC, lang LIMIT 10",
    "code_blocks": _m() + r"SELECT id, count(*) FILTER (WHERE c) AS complete, count(*) FILTER (WHERE NOT c AND s) AS truncated, count(*) FILTER (WHERE NOT c AND NOT s) AS malformed FROM (SELECT id, regexp_matches(b, '```(?:\w+)?\n(?:[^\n]*\n)+```') AS c, regexp_matches(b, '```(?:\w+)?\n') AS s FROM (SELECT id, unnest(regexp_extract_all(t, '```(?:.|\n)*?```')) AS b FROM m)) GROUP BY id",
    "inline_code": _m() + "SELECT CASE WHEN " + _bool(["import", "def ", "class ", "print(", "pip ", "python"], "lower(code)") + " THEN 'python' WHEN " + _bool(["docker", "kubectl", "helm"], "lower(code)") + " THEN 'k8s' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '`([^`]+)`', 1)) AS code FROM m) GROUP BY 1",
    "diagnostic_classes": _c() + "SELECT CASE " + " ".join(f"WHEN {_bool(w)} THEN '{n}'" for n, w in SIGNALS.items()) + " ELSE 'OTHER' END AS category, count(*) AS n FROM corpus GROUP BY 1",
    "count_by_course_section": _c() + "SELECT course, section, count(*) AS n FROM corpus GROUP BY ALL",
    "stratified_alloc": _c(_ALLOC) + "SELECT * FROM alloc",
    "stratified_sample": _c(_FREE, _SAMPLED) + "SELECT * FROM s",
    "fraction_sample": _c(_RANKED) + "SELECT id, course FROM ranked WHERE r <= greatest(1, round_even(n * 0.15::DOUBLE, 0))",
    "split_chi2": _c(_FREE, _SAMPLED, "a AS (SELECT course, count(*) AS x FROM corpus GROUP BY course)", "o AS (SELECT course, count(*) AS y FROM s GROUP BY course)", "j AS (SELECT coalesce(x, 0) AS x, coalesce(y, 0) AS y, sum(x) OVER ()::DOUBLE AS nx, sum(y) OVER ()::DOUBLE AS ny FROM a FULL JOIN o USING (course))") + "SELECT round(sum((y - x * ny / nx) ** 2 / (x * ny / nx)), 3) AS chi2_statistic, count(*) - 1 AS dof, round(max(abs(x / nx - y / ny)) * 100, 2) AS max_deviation_pct, round(avg(abs(x / nx - y / ny) * 100), 2) AS mean_deviation_pct, count(*) FILTER (WHERE x > 0 AND y > 0) AS groups_matched, count(*) AS total_groups FROM j",
    "balance_corpus": _c(_RANKED, _MEDIAN) + "SELECT course, id, (1 + greatest(0, m - n) // n + CASE WHEN r <= greatest(0, m - n) % n THEN 1 ELSE 0 END)::BIGINT AS copies FROM ranked CROSS JOIN mid",
    "undersample_corpus": _c(_RANKED, _MEDIAN) + "SELECT course, id FROM ranked CROSS JOIN mid WHERE r <= m OR n <= m",
    "corpus_fractions": _c(_RANKED) + "SELECT f::DOUBLE AS fraction, course, count(*) AS n, sum(id)::BIGINT AS id_sum FROM ranked CROSS JOIN (VALUES (1.0), (0.8), (0.6), (0.4), (0.2)) v(f) WHERE f >= 1 OR r <= greatest(1, round_even(n * f::DOUBLE, 0)) GROUP BY ALL",
    "homework_filter": _c() + "SELECT section, count(*) AS n FROM corpus WHERE NOT coalesce(contains(lower(section), 'src1'), false) GROUP BY section",
    "tool_quota": _c("x AS (SELECT DISTINCT id, unnest(list_intersect(regexp_extract_all(lower(question), '[a-z]+'), ['the', 'and', 'der', 'de'])) AS tool FROM corpus)", "k AS (SELECT greatest(1, 40 // count(DISTINCT tool)) AS q FROM x)", "r AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY md5('42:' || id), id) AS r FROM x)") + "SELECT DISTINCT id FROM r CROSS JOIN k WHERE r <= q",
    "signature_parse": _c() + "SELECT id, course AS style, section AS tier, 'base' AS base FROM corpus",
}
