"""Scans of the file forms a corpus comes in."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_markup
from ..session import ship

CORPUS = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "question", "answer", "course", "section")])
ASSIGNMENTS = "struct<results:map<string,struct<metadata:map<string,string>,assignments:array<struct<id:string,course:string,section:string,topic:int,topic_probability:double,question:string,ner_category:string,ner_primary_entity:string,ner_entities:array<string>,subtopic:int>>>>>"


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """(path, course, section, content) of the markdown files below ``folder``."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    parts = F.split("path", "/", -1)
    return rows.select("path", F.element_at(parts, -3).alias("course"), F.element_at(parts, -2).alias("section"), "content")


def _front_matter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    for frame in frames:
        out = []
        for path, head in zip(frame["path"], frame["head"]):
            doc, question, reason = None, None, None
            try:
                meta = yaml.safe_load(head)
                meta = meta if isinstance(meta, dict) else {}
                if not isinstance(meta.get("id"), str) or not meta["id"].strip():
                    reason = "Missing or non-string id"
                elif not isinstance(meta.get("question"), str) or not meta["question"].strip():
                    reason = "Missing or non-string question"
                else:
                    doc, question = meta["id"], meta["question"].strip()
            except yaml.YAMLError as e:
                reason = f"YAML parse error: {type(e).__name__}"
            out.append((path, doc, question, reason))
        yield pd.DataFrame(out, columns=["path", "id", "question", "reason"])


def parse_markdown(files: DataFrame, skip: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected with a reason) of (path, course, section, content) rows. The envelope is split
    natively; only front matter goes through Python."""
    ship(files.sparkSession)
    parts = F.split("content", "---", 3)
    reason = F.when(~F.startswith(F.ltrim("content"), F.lit("---")), "No YAML frontmatter fence").when(F.size(parts) < 3, "Malformed YAML frontmatter")
    rows = files.withColumn("_reason", reason).withColumn("_p", parts)
    meta = rows.filter("_reason IS NULL").select("path", F.col("_p")[1].alias("head")).mapInPandas(_front_matter, "path string, id string, question string, reason string")
    both = rows.join(meta, "path", "left").withColumn("reason", F.coalesce("_reason", "reason"))
    both = both.withColumn("answer", F.when(F.col("reason").isNull(), clean_markup(F.col("_p")[2])))
    both = both.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("answer") == ""), "Blank answer").otherwise(F.col("reason")))
    good = both.filter("reason IS NULL").select("id", "question", "answer", "course", "section")
    if skip:
        good = good.filter(~F.col("id").isin(skip))
    return good, both.filter("reason IS NOT NULL").select("path", "reason")


def jsonl(spark: SparkSession, path: str, schema: T.StructType = CORPUS, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines). strict: a bad line fails the read and there are no bad lines."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path), spark.createDataFrame([], "line string")
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    kept = spark.read.text(path).filter("trim(value) <> ''").select(F.from_json("value", marked, {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    bad = F.col("r._bad").isNotNull()
    return kept.filter(~bad).select(*[F.col(f"r.{f.name}") for f in schema.fields]), kept.filter(bad).select(F.col("value").alias("line"))


def expected_id(*names: str) -> Column:
    """First of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names])


def test_set(rows: DataFrame, corpus_ids: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Queries with their expected id; rows without id, question, answer or course go, as do those whose
    expected document is not in the corpus, unless marked out of domain."""
    have = set(rows.columns)
    names = [n for n in ("expected_id", "expected_doc_id", "id") if n in have]
    rows = rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in ("id", "question", "answer", "course"))).withColumn("expected_id", expected_id(*names))
    ood = F.coalesce(F.col("is_ood"), F.lit(False)) if "is_ood" in have else F.lit(False)
    rows = rows.withColumn("is_ood", ood).withColumn("query_type", F.coalesce(F.col("query_type"), F.lit("original")) if "query_type" in have else F.lit("original"))
    if aliases:
        table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))])
        rows = rows.withColumn("course", F.coalesce(table[F.col("course")], F.col("course")))
    known = corpus_ids.select(F.col("id").cast("string").alias("expected_id")).distinct()
    return rows.filter("NOT is_ood").join(known, "expected_id", "left_semi").unionByName(rows.filter("is_ood").select("expected_id", *[c for c in rows.columns if c != "expected_id"]))


def assignments(spark: SparkSession, paths: str, exclude: str = "_all") -> DataFrame:
    """(model, id, topic, ...) of nested assignment files; of repeated ids the last in the file counts;
    unreadable files give no rows."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value").filter(~F.col("file").contains(exclude))
    rows = text.select(F.from_json("value", T.StructType.fromJson(_struct(ASSIGNMENTS))).alias("r")).select(F.explode("r.results").alias("model", "m"))
    items = rows.select("model", F.posexplode("m.assignments").alias("pos", "a")).select("model", "pos", "a.*")
    last = items.groupBy("model", "id").agg(F.max_by(F.struct(*[c for c in items.columns if c not in ("model", "id")]), "pos").alias("r"))
    return last.select("model", "id", "r.*").drop("pos")


def _struct(ddl: str) -> dict:
    return T._parse_datatype_string(ddl).jsonValue() if hasattr(T, "_parse_datatype_string") else {}


def terms_csv(spark: SparkSession, path: str, column: str = "term") -> DataFrame:
    """Trimmed lower-case terms of a CSV; a missing file has none."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.csv(path, header=True)
    except AnalysisException:
        return spark.createDataFrame([], "term string")
    return rows.select(F.lower(F.trim(column)).alias("term")).distinct()


def patterns_json(spark: SparkSession, path: str) -> DataFrame:
    """(label, term) of a {label: [terms]} file."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return rows.select(F.explode("m").alias("label", "terms")).select("label", F.explode("terms").alias("term"))


def query_variants(spark: SparkSession, path: str) -> DataFrame:
    """One row per original question and per variant of a nested query file."""
    ddl = "queries array<struct<expected_id:string,course:string,original_question:string,prompt_results:map<string,array<string>>>>"
    q = spark.read.schema(ddl).json(path, multiLine=True).select(F.explode("queries").alias("q")).select("q.*")
    first = q.select(F.concat("expected_id", F.lit("_orig")).alias("id"), F.col("original_question").alias("question"), "expected_id", "course", F.lit("original").alias("query_type"))
    more = q.select("expected_id", "course", F.explode("prompt_results").alias("query_type", "v")).select("expected_id", "course", "query_type", F.posexplode("v").alias("i", "question"))
    return first.unionByName(more.select(F.concat_ws("_", "expected_id", "query_type", "i").alias("id"), "question", "expected_id", "course", "query_type"))


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """First 16 hex digits of each file's SHA-256."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring(F.sha2("content", 256), 1, 16).alias("digest"))


def content_key(rows: DataFrame, text: str, *by: str) -> DataFrame:
    """Order-free cache key of a set of texts: MD5 of the sorted texts, each followed by three bars, 12 digits."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(text)), lambda t: F.concat(t, F.lit("|||"))), "")
    return rows.groupBy(*by).agg(F.substring(F.md5(joined), 1, 12).alias("cache_key"))


def cached_vectors(spark: SparkSession, path: str, expected: int) -> DataFrame | None:
    """A stored table if it holds ``expected`` rows; else null, to be computed anew."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    return rows if rows.count() == expected else None


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
