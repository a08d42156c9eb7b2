"""The corpus pipeline: quality, line dedup, near-duplicate join, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the
columns of documents. Further columns pass through all but the last, whatever their names; an empty table
gives no rows. What a stage does with nulls, blank texts and repeated rows stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import linededup, mixing, ngramjoin, packing, quality
from lodestone.llm.common import WORD, hidden, materialize, orderable, small_batches, table
from lodestone.llm.langid import held_out

#: Near duplicates: shingles of five words, similarity of 0.8.
NEAR_GRAM, NEAR_SHARE = 5, (80, 100)
#: Words whose ids a packing task remembers; executors hold the memory of earlier stages by then.
PACKING_WORDS = 300_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts. Null and blank texts are scored as texts of no features, rows
    without a doc_id like any other (they are not learnt from), repeated rows alike."""
    small_batches(spark)
    fold = held_out(F.col("doc_id"), 3, 1)
    model = quality.fit(docs.filter(~fold).select("doc_id", "text"), table(spark, sf_dir, "labels").filter(~fold).select("doc_id", "quality"))
    rows, name = hidden(docs)
    kept = quality.predict(rows.withColumnRenamed(name["text"], "text"), model, ["text" if c == "text" else x for c, x in name.items()]).filter("predicted = 1")
    return kept.select(*[F.col("text" if c == "text" else x).alias(c) for c, x in name.items()])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines; n_chars follows the text. Null texts stay null, a
    null source is one source, repeated rows are cut alike; no row is dropped."""
    out = linededup.drop_boilerplate(docs, "source", "text", counts=False)
    return out.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, and of several
    rows with that doc_id the first by their columns. Texts without words stay all; of a group without any doc_id one row stays."""
    small_batches(spark)
    groups = ngramjoin.jaccard_components(docs.select("doc_id", "text"), NEAR_GRAM, NEAR_SHARE)
    none = F.lit(-(1 << 63))
    heads = groups.filter("n_shingles > 0 and doc_id <=> component_id").groupBy("group").agg(F.min(F.struct(F.coalesce("doc_id", none).alias("_doc"), F.col("mark").alias("_mark"))).alias("head")).select("head.*")
    rows, name = hidden(docs)
    doc, text = F.coalesce(F.col(name["doc_id"]).cast("long"), none), F.coalesce(F.col(name["text"]), F.lit(""))
    rows = rows.withColumn("_doc", doc).withColumn("_mark", F.xxhash64(text))
    again = Window.partitionBy("_doc", "_mark").orderBy(*orderable(rows, name.values()))
    first = rows.join(heads, ["_doc", "_mark"]).withColumn("_again", F.row_number().over(again)).filter("_again = 1")
    blank = rows.filter(~text.rlike(WORD))
    return first.select(*name.values()).unionByName(blank.select(*name.values())).toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. Texts without words add none and are kept once, or as
    often as the cap allows where their source is taken whole; a null source is a source; repeated rows
    count each."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences. Null and empty texts are the end id alone; repeated rows are packed each."""
    small_batches(spark)
    return packing.pack(docs.select("doc_id", "text"), packing.vocabulary(), remembered=PACKING_WORDS)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram jaccard join", near_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]
#: A fitted classifier, words' tokens and seeded groups have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
