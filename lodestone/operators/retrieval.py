"""Retrieval: exact nearest neighbours, BM25, fusion and reranking, all as ranked long tables
(query_id, rank, doc_id, score). Every ranking has a total order: score down, then doc_id up."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.scratch import drop, kept
from .keyword import KeywordIndex, build_index, scan_index

#: Fixed values of the scoring formulas.
RRF_K = 60
VECTOR_SHARE, KEYWORD_SHARE = 0.7, 0.3
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 2048


def top(ranked: DataFrame, k: int, *ties: Column, by: str = "query_id") -> DataFrame:
    """The k best rows per query; ties in the order given, else by doc_id."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), *(ties or (F.col("doc_id"),)))
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(by, "rank", "doc_id", "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def knn(corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, must: Sequence[str] = (), should: Callable[[DataFrame, DataFrame], list[Column]] | Sequence[str] | None = None, used: list[str] | None = None) -> DataFrame:
    """Cosine neighbours. must: columns equal on both sides, the join's keys; should: columns of which one at least is
    equal on both sides, or a function of both sides that gives clauses of which one at least must hold (none given: no
    restriction). Nulls equal nulls. A filter, never a change of score.

    corpus: (id, v, ...), queries: (query_id, v, ...). Scores are rounded to 6 places before ranking.
    Rows and queries without a vector take no part. ``used``: gets the paths of the scratch tables that the rows depend on.
    """
    corpus, queries = corpus.filter("v is not null"), queries.filter("v is not null")
    if should is None:
        return top(_block_scores(corpus, queries, k, threshold, must, used), k)
    if not callable(should):
        # A pair counts by the first of the columns it is equal in.
        parts = [_block_scores(corpus, queries, k, threshold, [*must, c], used, should[:i]) for i, c in enumerate(should)] or [_block_scores(corpus, queries, k, threshold, must, used)]
        return top(reduce(DataFrame.unionByName, parts), k)
    d, q = corpus.alias("d"), queries.alias("q")
    keys = [F.col(f"q.{c}").eqNullSafe(F.col(f"d.{c}")) for c in must]
    clauses = should(d, q) if should else []
    if clauses:
        keys.append(reduce(lambda a, b: a | b, clauses))
    rows = d.join(q, reduce(lambda a, b: a & b, keys))
    norm = F.sqrt(dot(F.col("d.v"), F.col("d.v"))) * F.sqrt(dot(F.col("q.v"), F.col("q.v")))
    rows = rows.select("query_id", F.col("d.id").alias("doc_id"), F.round(F.when(norm > 0, dot(F.col("d.v"), F.col("q.v")) / norm).otherwise(0.0), 6).alias("score"))
    if threshold is not None:
        rows = rows.filter(F.col("score") >= threshold)
    return top(rows, k)


def knn_rows(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The rows of ``knn``, read back from a scratch table; the blocks they come from are gone."""
    used: list[str] = []
    ranked = kept(knn(corpus, queries, k, used=used))
    drop(corpus.sparkSession, used)
    return ranked


def blocks(rows: DataFrame, by: str, most: int, *keys: str, used: list[str] | None = None) -> DataFrame:
    """Rows of one key dealt by a hash of ``by`` to blocks of about ``most``, each of them a row of lists in a file
    of its own. ``used``: gets the table's path."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).alias("_n"))
    rest = [c for c in rows.columns if c not in keys]
    joined = rows.join(sizes, list(keys)) if keys else rows.join(F.broadcast(sizes))
    packed = joined.withColumn("_b", F.pmod(F.xxhash64(by), F.col("_n"))).groupBy(*keys, "_b").agg(F.collect_list(F.struct(*rest)).alias("z"))
    return kept(packed.select(*keys, *[F.col(f"z.{c}").alias(c) for c in rest]), 1, used)


def met(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Every block of ``left`` with every block of ``right`` that has the same keys (named _l and _r on the sides). The
    product reads both where they lie: nothing is copied or shuffled a pair."""
    left, right = left.coalesce(left.sparkSession.sparkContext.defaultParallelism), right.hint("shuffle_replicate_nl")
    return left.join(right, reduce(lambda x, y: x & y, [F.col(f"{c}_l") == F.col(f"{c}_r") for c in keys])) if keys else left.crossJoin(right)


def matrix(column: pa.Array) -> np.ndarray:
    """One cell of a list of vectors."""
    rows = column[0].values
    return np.array(rows.flatten(), dtype=float).reshape(len(rows), -1)


def _block_scores(corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None, must: Sequence[str] = (), used: list[str] | None = None, apart: Sequence[str] = ()) -> DataFrame:
    """Blocks of queries meet blocks of vectors as matrix products; a part of the vectors keeps k per query. With
    ``must``, blocks are those of one key (nulls are a key). Pairs equal in one of ``apart`` are left out."""
    # Nulls are left out of a row's JSON, so each combination of values has one text.
    key = F.to_json(F.struct(*must)) if must else F.lit("")
    own = lambda side: [F.to_json(F.struct(c)).alias(f"_{side}{i}") for i, c in enumerate(apart)]
    left = blocks(corpus.select(key.alias("_k_l"), "id", "v", *own("d")), "id", BLOCK_ROWS, "_k_l", used=used)
    right = blocks(queries.select(key.alias("_k_r"), "query_id", F.col("v").alias("asked"), *own("q")), "query_id", BLOCK_QUERIES, "_k_r", used=used)

    def search(row: pa.RecordBatch) -> pa.Table:
        rows, ask = matrix(row.column("v")), matrix(row.column("asked"))
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
        ask /= np.maximum(np.linalg.norm(ask, axis=1, keepdims=True), 1e-300)
        held, asked = row.column("id")[0].values, row.column("query_id")[0].values
        ids, out = held.to_numpy(zero_copy_only=False), ([], [], [])
        values = [pa.concat_arrays([row.column(f"_{side}{n}")[0].values for side in "dq"]).dictionary_encode().indices.to_numpy() for n in range(len(apart))]
        for i in range(0, len(ask), 256):
            scores = np.round(ask[i : i + 256] @ rows.T, 6)
            for value in values:
                scores[value[len(ids) + i : len(ids) + i + len(scores), None] == value[None, : len(ids)]] = -np.inf
            for q, s in enumerate(scores, i):
                best = np.flatnonzero(s >= (np.partition(s, -k)[-k] if len(s) > k else -np.inf))
                best = best[np.lexsort((ids[best], -s[best]))][:k]
                if threshold is not None or apart:
                    best = best[s[best] >= (-2.0 if threshold is None else threshold)]
                out[0].append(np.full(len(best), q))
                out[1].append(best)
                out[2].append(s[best])
        return pa.table({"query_id": asked.take(pa.array(np.concatenate(out[0]))), "doc_id": held.take(pa.array(np.concatenate(out[1]))), "score": np.concatenate(out[2])})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """k rows a query of a part's blocks."""
        found: dict[tuple, pa.Table] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                name, new = (row.column("_k_r")[0].as_py(), row.column("query_id")[0][0].as_py()), search(row)
                if name in found:
                    new = pa.concat_tables([found[name], new]).sort_by([("query_id", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
                    code = np.asarray(new["query_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices)
                    first = np.flatnonzero(np.diff(code, prepend=-1))
                    new = new.filter(pa.array(np.arange(len(code)) - np.repeat(first, np.diff(first, append=len(code))) < k))
                found[name] = new.combine_chunks()
        for rows in found.values():
            yield from rows.to_batches()

    kind = dict(queries.dtypes)["query_id"]
    found = met(left, right, "_k").mapInArrow(best, f"query_id {kind}, doc_id {dict(corpus.dtypes)['id']}, score double")
    return found.withColumn("score", F.round("score", 6))


def bm25(where: DataFrame | KeywordIndex, queries: DataFrame, k: int, boosts: dict[str, float], must: Sequence[str] = ()) -> DataFrame:
    """Best field wins: the largest boosted field score. must: columns of docs and queries that agree; they
    restrict results, statistics stay corpus-wide. ``where``: an index, or documents to be indexed for this
    search alone."""
    if isinstance(where, DataFrame):
        index = build_index(where, [f for f, b in boosts.items() if b > 0], attributes=must)
        ranked = scan_index(index, queries, k, boosts, must)
        drop(where.sparkSession, [index.path])
        return ranked
    return scan_index(where, queries, k, boosts, must)


def rrf(first: DataFrame, second: DataFrame, k: int, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion; ties go to the first list's order, then the second's."""
    both = first.select("query_id", "doc_id", F.col("rank").alias("r1"), F.lit(None).cast("int").alias("r2")).unionByName(second.select("query_id", "doc_id", F.lit(None).cast("int").alias("r1"), F.col("rank").alias("r2")))
    one = lambda c: F.coalesce(1.0 / (constant + F.max(c)), F.lit(0.0))
    fused = both.groupBy("query_id", "doc_id").agg(F.round(one("r1") + one("r2"), 9).alias("score"), F.max("r1").alias("r1"), F.max("r2").alias("r2"))
    return top(fused, k, F.col("r1").asc_nulls_last(), F.col("r2"))


def minmax(column: str = "score", by: str = "query_id") -> Column:
    """Scaled to [0, 1] within the query; a list without spread becomes 0."""
    w = Window.partitionBy(by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(0.0)


def minmax_fusion(first: DataFrame, second: DataFrame, k: int, shares: tuple[float, float] = (VECTOR_SHARE, KEYWORD_SHARE)) -> DataFrame:
    """Weighted sum of min-max scaled scores of two lists (fetch 2k of each)."""
    scaled = [df.select("query_id", "doc_id", (minmax() * share).alias("part")) for df, share in zip((first, second), shares)]
    fused = scaled[0].unionByName(scaled[1]).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top(fused, k)


def overlap_scorer(query: Column, text: Column) -> Column:
    """Offline stand-in for a cross-encoder: share of the query's distinct words found in the text."""
    asked = F.array_distinct(tokens(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(text))) / F.size(asked)).otherwise(0.0)


def rerank(ranked: DataFrame, queries: DataFrame, docs: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = overlap_scorer, text: str = "answer", null_scores: bool = False) -> DataFrame:
    """Candidates in the order of a scorer of (query text, document text); ties keep their order."""
    rows = ranked.join(queries.select("query_id", "query_text"), "query_id").join(docs.select(F.col("id").alias("doc_id"), F.col(text).alias("_text")), "doc_id")
    rows = rows.select("query_id", "doc_id", F.col("rank").alias("_was"), F.round(scorer(F.col("query_text"), F.col("_text")), 6).alias("score"))
    out = top(rows, k, F.col("_was"))
    return out.withColumn("score", F.lit(0.0)) if null_scores else out


def reciprocal_scores(ranked: DataFrame) -> DataFrame:
    """Scores of a reranked list as 1/rank."""
    return ranked.withColumn("score", F.round(1.0 / F.col("rank"), 6))


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]]) -> Callable[[Column, Column], Column]:
    """A cross-encoder as a scorer: ``load`` runs once per Python worker and gives a function of
    (queries, texts) -> logits; two columns of logits count by the second; scores are sigmoids."""

    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in parts:
            logits = np.asarray(model(queries.tolist(), texts.tolist()))
            logits = logits[:, 1] if logits.ndim == 2 and logits.shape[1] >= 2 else logits.reshape(-1)
            e = np.exp(-np.abs(logits))
            yield pd.Series(np.where(logits >= 0, 1 / (1 + e), e / (1 + e)), dtype="float64")

    score.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")


def hits(ranked: DataFrame) -> DataFrame:
    """One row per query: hit_ids and hit_scores in order."""
    rows = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("_h"))
    return rows.select("query_id", F.col("_h.doc_id").alias("hit_ids"), F.col("_h.score").alias("hit_scores"))


def search(kind: str, docs: DataFrame, vecs: DataFrame, queries: DataFrame, k: int = 10, index: KeywordIndex | None = None) -> DataFrame:
    """One entry for all configurations; docs and vecs share ids. index: of the docs' question and answer, if
    there is one."""
    keyword = {"bm25_default": {"question": 1.0, "answer": 0.0}, "bm25_balanced": {"question": 1.0, "answer": 1.0}, "bm25_answer": {"question": 0.0, "answer": 1.0}}
    where = docs if index is None else index
    if kind in keyword:
        return bm25(where, queries, k, keyword[kind])
    if kind == "vector":
        return knn(vecs, queries, k)
    if kind == "topic_filtered":
        return knn(vecs, queries, k, must=["topic"])
    if kind == "hybrid_rrf":
        return rrf(knn_rows(vecs, queries, k), bm25(where, queries, k, keyword["bm25_answer"]), k)
    if kind == "hybrid_minmax":
        return minmax_fusion(knn_rows(vecs, queries, 2 * k), bm25(where, queries, 2 * k, keyword["bm25_answer"]), k)
    if kind == "vector_reranked":
        return rerank(knn(vecs, queries, 3 * k), queries, docs, k)
    raise ValueError(f"unknown configuration {kind}")


def diverse(ranked: DataFrame, docs: DataFrame, k: int, per_group: int, group: str = "course") -> DataFrame:
    """At most ``per_group`` hits of each group, then the k best."""
    rows = ranked.join(docs.select(F.col("id").alias("doc_id"), group), "doc_id")
    within = Window.partitionBy("query_id", group).orderBy(F.desc("score"), "doc_id")
    return top(rows.withColumn("_n", F.row_number().over(within)).filter(F.col("_n") <= per_group), k)


def project(vectors: DataFrame, dims: int = 2) -> DataFrame:
    """(id, x, y): first principal components, a linear stand-in for a neighbour embedding."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("id", array_to_vector(F.col("v")).alias("f"))
    out = PCA(k=dims, inputCol="f", outputCol="p").fit(rows).transform(rows).withColumn("p", vector_to_array("p"))
    return out.select("id", *[F.round(F.col("p")[i], 6).alias(n) for i, n in zip(range(dims), "xyz")])
