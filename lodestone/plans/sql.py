"""Shared parts of the DuckDB twins."""

CORPUS = r"""corpus AS (SELECT doc_id AS id, string_split(text, chr(10))[1] AS question, text AS answer,
  lang AS course, source AS section FROM documents)"""
VECTORS = "vecs AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label AS topic FROM embeddings)"
KNOWN = """known AS (SELECT c.id AS query_id, c.question AS query_text, c.course, c.section, a.topic,
  CASE WHEN b.v IS NULL THEN a.v ELSE list_transform(a.v, lambda x, i: x + b.v[i]) END AS v
  FROM corpus c LEFT JOIN vecs a ON a.id = c.id LEFT JOIN vecs b ON b.id = c.id + 1 WHERE c.id % 20 = 0)"""
BASE = f"{CORPUS}, {VECTORS}, {KNOWN}"
PASSAGES = "passages AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"
#: Name-based UUID of an id: namespace and id hashed, version and variant set.
UUID5 = """(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)
  FROM (SELECT sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(id::VARCHAR)) AS h))"""
TOKEN = r"[\p{L}\p{N}_]+"


def ranked(name: str, source: str, k: int, ties: str = "doc_id") -> str:
    return f"""{name} AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {ties}) AS rank FROM ({source})) WHERE rank <= {k})"""


def knn(name: str, k: int, where: str = "true", queries: str = "known") -> str:
    return ranked(name, f"""SELECT q.query_id, d.id AS doc_id, round(list_cosine_similarity(d.v, q.v), 6) AS score
  FROM vecs d JOIN {queries} q ON q.v IS NOT NULL AND ({where})""", k)


def bm25_field(field: str, queries: str) -> str:
    return f"""SELECT query_id, p.doc_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
    * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT id AS doc_id, len(t) AS dl, unnest(t) AS term
          FROM (SELECT id, regexp_extract_all(lower({field}), '{TOKEN}') AS t FROM corpus)) GROUP BY ALL) p
  JOIN (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(regexp_extract_all(lower({field}), '{TOKEN}')) AS term FROM corpus) GROUP BY term) d USING (term)
  JOIN (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '{TOKEN}')) AS term FROM {queries}) GROUP BY ALL) q USING (term)
  CROSS JOIN (SELECT count(*) AS n, avg(len(regexp_extract_all(lower({field}), '{TOKEN}'))) AS avgdl FROM corpus) s
  GROUP BY ALL"""


def bm25(name: str, k: int, boosts: dict[str, float], queries: str = "known", where: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT query_id, doc_id, score * {b}::DOUBLE AS score FROM ({bm25_field(f, queries)})" for f, b in boosts.items() if b > 0)
    return ranked(name, f"SELECT query_id, doc_id, round(max(score), 6) AS score FROM ({parts}) {where} GROUP BY query_id, doc_id", k)


def rrf(name: str, first: str, second: str, k: int) -> str:
    source = f"""SELECT query_id, doc_id, round(coalesce(1.0::DOUBLE / (60 + max(r1)), 0) + coalesce(1.0::DOUBLE / (60 + max(r2)), 0), 9) AS score, max(r1) AS r1, max(r2) AS r2
  FROM (SELECT query_id, doc_id, rank AS r1, NULL AS r2 FROM {first} UNION ALL SELECT query_id, doc_id, NULL, rank FROM {second}) GROUP BY query_id, doc_id"""
    return ranked(name, source, k, "r1 NULLS LAST, r2")


def minmax(name: str, first: str, second: str, k: int) -> str:
    scaled = lambda t, w: f"SELECT query_id, doc_id, {w}::DOUBLE * CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 0 END AS part FROM {t} WINDOW p AS (PARTITION BY query_id)"
    return ranked(name, f"SELECT query_id, doc_id, round(sum(part), 6) AS score FROM ({scaled(first, 0.7)} UNION ALL {scaled(second, 0.3)}) GROUP BY query_id, doc_id", k)


def rerank(name: str, source: str, k: int, queries: str = "known") -> str:
    toks = lambda c: f"regexp_extract_all(lower({c}), '{TOKEN}')"
    scored = f"""SELECT r.query_id, r.doc_id, r.rank AS was, round(CASE WHEN len(list_distinct({toks('query_text')})) > 0
    THEN len(list_intersect(list_distinct({toks('query_text')}), {toks('answer')})) / len(list_distinct({toks('query_text')}))::DOUBLE ELSE 0 END, 6) AS score
  FROM {source} r JOIN {queries} q USING (query_id) JOIN corpus c ON c.id = r.doc_id"""
    return ranked(name, scored, k, "was")


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
