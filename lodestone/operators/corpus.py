"""The corpus, its vectors and known-item queries, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .keyword import KeywordIndex, build_index, open_index


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, question, answer, course, section): the question is the whole first line."""
    first = F.element_at(F.split("text", "\n", -1), 1)
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), first.alias("question"), F.col("text").alias("answer"), F.col("lang").alias("course"), F.col("source").alias("section"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v, topic)."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("topic"))


def known_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose answer is known: each twentieth document, asked by its question and by the sum of
    its vector and the next, or its own where there is no next; v is null for a document without a vector.
    (query_id, query_text, course, section, topic, v)"""
    rows, v = corpus(spark, sf_dir), vectors(spark, sf_dir)
    after = v.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    out = rows.filter("id % 20 = 0").join(v, "id", "left").join(after, "id", "left")
    return out.select(F.col("id").alias("query_id"), F.col("question").alias("query_text"), "course", "section", "topic", F.coalesce(F.zip_with("v", "w", lambda a, b: a + b), "v").alias("v"))


_indexes: dict[tuple, str] = {}


def keyword_index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    """The index of the corpus's questions and answers, built by the first search of an application and read by
    the others, as long as the files of the table are the same."""
    files = read(spark, sf_dir, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    stamp = tuple(files.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(file_path, file_size, file_modification_time))")).first())
    key = (spark.sparkContext.applicationId, sf_dir, stamp)
    if key not in _indexes:
        _indexes[key] = build_index(corpus(spark, sf_dir), ["question", "answer"], attributes=["course"]).path
    return open_index(spark, _indexes[key])


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries: (query_id, query_text)."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
