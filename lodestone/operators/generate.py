"""Answer generation around language models: contexts, prompts, pluggable clients, judging, sweeps."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_openings

#: Characters of a context and of one document in it; how documents are joined.
DOC_CHARS, CONTEXT_CHARS = 1000, 3000
SEPARATOR, NOTHING = "\n\n---\n\n", "No relevant documents found."


def cut_answer(answer: Column, most: int = DOC_CHARS) -> Column:
    """An answer without its opening, cut at the last blank before ``most`` characters."""
    clean = strip_openings(answer)
    head = F.substring(clean, 1, most)
    return F.when(F.length(clean) > most, F.concat(F.regexp_replace(head, r"(?s) [^ ]*$", ""), F.lit("..."))).otherwise(clean)


def pack_context(ranked: DataFrame, docs: DataFrame, text: str = "answer", most: int = CONTEXT_CHARS, per_doc: int = DOC_CHARS) -> DataFrame:
    """(query_id, context, n_docs): documents in rank order while their running length fits; the first
    that does not fit ends the context."""
    rows = ranked.join(docs.select(F.col("id").alias("doc_id"), cut_answer(F.col(text), per_doc).alias("_t")), "doc_id")
    upto = F.sum(F.length("_t")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    fit = rows.withColumn("_sum", upto).filter(F.col("_sum") <= most)
    joined = fit.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_t"))), lambda x: x["_t"]), SEPARATOR).alias("context"), F.count(F.lit(1)).alias("n_docs"))
    asked = ranked.select("query_id").distinct()
    return asked.join(joined, "query_id", "left").select("query_id", F.coalesce("context", F.lit(NOTHING)).alias("context"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def prompt(template: str, **parts: Column) -> Column:
    """A template whose {names} are replaced by columns."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def echo_client(prompts: list[str]) -> list[dict]:
    """Offline stand-in for a model: the first twelve words of the prompt's last paragraph."""
    return [{"content": " ".join(p.split("\n\n")[-1].split()[:12]), "prompt_tokens": len(p.split()), "completion_tokens": min(12, len(p.split("\n\n")[-1].split())), "error": None} for p in prompts]


def call_model(rows: DataFrame, key: str, client: Callable[[list[str]], list[dict]] = echo_client) -> DataFrame:
    """rows (key, prompt) with content, token counts and error. A failing batch gives rows with the
    error, not an exception."""
    kind = dict(rows.dtypes)[key]

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                replies = client(frame["prompt"].tolist())
            except Exception as e:  # noqa: BLE001  a model's failure is data here
                replies = [{"content": None, "prompt_tokens": 0, "completion_tokens": 0, "error": str(e)[:200]}] * len(frame)
            out = pd.DataFrame(replies)
            out.insert(0, key, frame[key].to_numpy())
            yield out

    return rows.select(key, "prompt").mapInPandas(ask, f"{key} {kind}, content string, prompt_tokens long, completion_tokens long, error string")


def cascade(*clients: Callable[[list[str]], list[dict]]) -> Callable[[list[str]], list[dict]]:
    """A client that tries others in turn."""

    def ask(prompts: list[str]) -> list[dict]:
        last: Exception | None = None
        for client in clients:
            try:
                return client(prompts)
            except Exception as e:  # noqa: BLE001
                last = e
        raise last or RuntimeError("no client")

    return ask


def first_object(reply: str | None) -> dict | None:
    """The first balanced JSON object in a reply."""
    text = reply or ""
    for start in (i for i, c in enumerate(text) if c == "{"):
        try:
            found, _ = json.JSONDecoder().raw_decode(text[start:])
        except ValueError:
            continue
        return found
    return None


def parse_scores(reply: Column) -> Column:
    """struct(faithfulness, factual_correctness) of a judge's reply; 0 where it cannot be read."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(reply)
    lines = F.filter(F.transform(F.split(body, "\n", -1), lambda x: F.trim(x)), lambda x: x.startswith("{"))
    line = F.coalesce(F.try_element_at(lines, F.lit(-1)), body)
    got = F.from_json(line, "faithfulness double, factual_correctness double")
    return F.struct(F.coalesce(got["faithfulness"], F.lit(0.0)).alias("faithfulness"), F.coalesce(got["factual_correctness"], F.lit(0.0)).alias("factual_correctness"))


def judge_summary(rows: DataFrame) -> DataFrame:
    """One row: means, and composites of plain (both scores) and chaos queries (facts only)."""
    both = (F.col("faithfulness") + F.col("factual_correctness")) / 2
    chaos = F.col("query_type") == "chaos_monkey"
    r = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 3)
    return rows.agg(F.count(F.lit(1)).alias("n"), r(F.col("faithfulness")).alias("mean_faithfulness"), r(F.col("factual_correctness")).alias("mean_factual"), r(F.when(~chaos, both)).alias("composite"), r(F.when(chaos, F.col("factual_correctness"))).alias("composite_chaos"))


def judge_by_type(rows: DataFrame) -> DataFrame:
    r = lambda c: F.round(F.avg(c), 3)
    return rows.groupBy("query_type").agg(F.count(F.lit(1)).alias("n"), r("faithfulness").alias("faithfulness"), r("factual_correctness").alias("factual_correctness"))


def sweep_summary(rows: DataFrame) -> DataFrame:
    """Per (style, top_k): means, median latency, and whether it is the best combination."""
    out = rows.groupBy("style", "top_k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("faithfulness"), 3).alias("faithfulness"), F.round(F.avg("factual_correctness"), 3).alias("factual_correctness"), F.round(F.median("latency_ms"), 3).alias("latency_p50"), F.round(F.avg("tokens"), 1).alias("tokens"), F.round(F.avg((F.col("faithfulness") + F.col("factual_correctness")) / 2), 6).alias("combined"))
    best = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("combined"), "style", "top_k"))  # a row per combination
    return out.withColumn("best", best == 1)


def sweep(queries: DataFrame, styles: list[str], ks: list[int]) -> DataFrame:
    """Each query with each style and each k."""
    return queries.withColumn("style", F.explode(F.array(*[F.lit(s) for s in styles]))).withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in ks])))


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Batch numbers without a global sort: key order within hash groups of about a thousand batches."""
    group = F.pmod(F.xxhash64(key), F.lit(max(1, -(-rows.count() // (1000 * size)))))
    at = F.row_number().over(Window.partitionBy("_g").orderBy(key))
    return rows.withColumn("_g", group).withColumn("batch", F.concat_ws("-", F.col("_g").cast("string"), F.floor((at - 1) / size).cast("string"))).drop("_g")


def by_strategy(rows: DataFrame) -> DataFrame:
    """(id, strategy, variation) rows as one map strategy -> variations per id."""
    lists = rows.groupBy("id", "strategy").agg(F.sort_array(F.collect_list("variation")).alias("v"))
    return lists.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("strategy", "v")))).alias("variations"), F.sum(F.size("v")).alias("n"))
