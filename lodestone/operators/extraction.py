"""What models say about texts, asked once a text: answers are stored by the digest of what they answer.

Each function takes the distinct texts that have no stored answer, asks for these alone, stores what passes its
checks, and joins all rows with the store. A run over the same texts asks nothing; after a crash the next run
goes on from the last whole tier. What fails its checks gives the fallback and is put in quarantine beside the
store, so that it is asked again. ``client`` gives a list of replies for a list of prompts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..sources.sinks import append_batch, batches

#: Labels a model may give, questions of a prompt, variants kept of a query style.
LABELS = ("TOOL", "ERROR", "CONCEPT", "LANGUAGE", "ADMIN", "OTHER")
PER_PROMPT, VARIANTS = 5, 3
Client = Callable[[list[str]], list[str]]
_ENTITIES = "entities array<string>, categories array<string>, primary_entity string, primary_category string"
_NAMES = ["entities", "categories", "primary_entity", "primary_category"]


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _once(rows: DataFrame, text: str, ask: Callable[[DataFrame], DataFrame], path: str, tiers: int) -> DataFrame:
    """rows with the stored answer of their text (null where there is none). ask: (digest, text) -> (digest, ok,
    reply, answer columns...); what is ok is stored, the rest goes to quarantine, tier by tier."""
    spark = rows.sparkSession
    ship(spark)
    keyed = rows.withColumn("_digest", digest(F.col(text)))
    want = keyed.select(F.col("_digest").alias("digest"), F.col(text).alias("text")).filter("text is not null").dropDuplicates(["digest"])
    before = batches(spark, f"{path}/answers")
    todo = want if before is None else want.join(before.select("digest"), "digest", "left_anti")
    for tier in range(tiers):
        part = todo.filter(F.pmod(F.xxhash64("digest"), F.lit(tiers)) == tier)
        if part.isEmpty():
            continue
        # Answers are written as they come, good and bad, and told apart from the written rows: asked once.
        got = append_batch(ask(part), f"{path}/replies")
        append_batch(got.filter("ok").drop("ok", "reply"), f"{path}/answers")
        append_batch(got.filter("not ok").select("digest", "reply"), f"{path}/quarantine")
    stored = batches(spark, f"{path}/answers")
    if stored is None:
        return keyed.drop("_digest")
    # A tier that was stored twice, a crash lying between its tables, counts once.
    stored = stored.dropDuplicates(["digest"]).withColumnRenamed("digest", "_digest")
    return keyed.join(stored, "_digest", "left").drop("_digest")


def entity_prompt(questions: list[str]) -> str:
    listed = "\n".join(f"{i + 1}. {q}" for i, q in enumerate(questions))
    return f'List the technical entities of each question as JSON: an array of {len(questions)} objects in order, each with "entities", "categories" of {", ".join(LABELS)}, "primary_entity" or null, and "primary_category". JSON alone.\n\nQuestions:\n{listed}'


def parse_entities(reply: str | None, n: int) -> list[dict | None]:
    """An object a question, null where there is none or it is not of the right form. Unknown labels become
    OTHER, entities lower case; blank ones go. A reply without an array gives nothing."""
    text = (reply or "").strip()
    if text.startswith("```"):
        text = text.split("```")[1].removeprefix("json")
    start, end = text.find("["), text.rfind("]") + 1
    try:
        found = json.loads(text[start:end]) if 0 <= start < end else []
    except ValueError:
        found = []
    out: list[dict | None] = []
    for item in found[:n] if isinstance(found, list) else []:
        good = isinstance(item, dict) and all(isinstance(item.get(c), list) and all(isinstance(x, str) for x in item[c]) for c in _NAMES[:2])
        good = good and isinstance(item.get("primary_category"), str) and isinstance(item.get("primary_entity", 0), str | None)
        label = lambda x: x if x in LABELS else "OTHER"
        out.append({"entities": [e.lower().strip() for e in item["entities"] if e.strip()], "categories": [label(c) for c in item["categories"]], "primary_entity": item["primary_entity"], "primary_category": label(item["primary_category"])} if good else None)
    return out + [None] * (n - len(out))


def model_entities(docs: DataFrame, text: str, client: Client, path: str, per_prompt: int = PER_PROMPT, tiers: int = 1) -> DataFrame:
    """docs with entities, categories, primary_entity, primary_category of ``text``, several questions a prompt.
    The fallback, for null texts and what a model does not answer well, is no entity and OTHER."""

    def ask(part: DataFrame) -> DataFrame:
        def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                groups = [frame.iloc[i : i + per_prompt] for i in range(0, len(frame), per_prompt)]
                try:
                    replies = client([entity_prompt(g["text"].tolist()) for g in groups])
                except Exception as e:  # noqa: BLE001  a model's failure is data here
                    replies = [f"error: {e}"[:200]] * len(groups)
                rows = [(key, x is not None, reply, *((x or {}).get(c) for c in _NAMES)) for g, reply in zip(groups, replies) for key, x in zip(g["digest"], parse_entities(reply, len(g)))]
                yield pd.DataFrame(rows, columns=["digest", "ok", "reply", *_NAMES])

        return part.mapInPandas(solve, f"digest string, ok boolean, reply string, {_ENTITIES}")

    out = _once(docs, text, ask, path, tiers)
    for name in [n for n in _NAMES if n not in out.columns]:
        out = out.withColumn(name, F.lit(None).cast("array<string>" if name in _NAMES[:2] else "string"))
    none = F.array().cast("array<string>")
    return out.withColumns({"entities": F.coalesce("entities", none), "categories": F.coalesce("categories", F.array(F.lit("OTHER"))), "primary_category": F.coalesce("primary_category", F.lit("OTHER"))})


def query_prompt(style: str, question: str) -> str:
    return f"Rewrite the question as a {style} would ask it, in up to {VARIANTS} ways, as a JSON array of strings.\n\n{question}"


def synthesized(docs: DataFrame, key: str, text: str, styles: list[str], client: Client, path: str, tiers: int = 1) -> DataFrame:
    """(key, query_type, i, question): up to three variants of each text in each style, style by style. Replies are
    JSON arrays of strings, or else lines; blank variants and repetitions of the text go."""

    def ask_as(style: str) -> Callable[[DataFrame], DataFrame]:
        def ask(part: DataFrame) -> DataFrame:
            def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    try:
                        replies = client([query_prompt(style, t) for t in frame["text"]])
                    except Exception as e:  # noqa: BLE001
                        replies = [None] * len(frame)
                    found = [variants(r, t) for r, t in zip(replies, frame["text"])]
                    yield pd.DataFrame({"digest": frame["digest"].to_numpy(), "ok": [bool(v) for v in found], "reply": replies, "variants": found})

            return part.mapInPandas(solve, "digest string, ok boolean, reply string, variants array<string>")

        return ask

    out = None
    for style in styles:
        rows = _once(docs.select(key, text), text, ask_as(style), f"{path}/{style}", tiers)
        if "variants" in rows.columns:
            mine = rows.select(key, F.lit(style).alias("query_type"), F.posexplode("variants").alias("i", "question"))
            out = mine if out is None else out.unionByName(mine)
    return docs.sparkSession.createDataFrame([], f"{key} {dict(docs.dtypes)[key]}, query_type string, i int, question string") if out is None else out


def variants(reply: str | None, text: str) -> list[str]:
    body = (reply or "").strip()
    start, end = body.find("["), body.rfind("]") + 1
    try:
        found = json.loads(body[start:end]) if 0 <= start < end else body.split("\n")
    except ValueError:
        found = body.split("\n")
    kept = [x.strip() for x in found if isinstance(x, str) and x.strip() and x.strip() != text.strip()]
    return list(dict.fromkeys(kept))[:VARIANTS]


def embedded(docs: DataFrame, text: str, encode: Callable[[list[str]], list[list[float]]], path: str, tiers: int = 1) -> DataFrame:
    """docs with ``v``, the vector of ``text``: only texts that no earlier run has encoded are encoded, so an
    edited text costs one, wherever it stands and however often. Null texts have none."""

    def ask(part: DataFrame) -> DataFrame:
        def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                vectors = encode(frame["text"].tolist())
                yield pd.DataFrame({"digest": frame["digest"].to_numpy(), "ok": True, "reply": None, "v": [list(map(float, v)) for v in vectors]})

        return part.mapInPandas(solve, "digest string, ok boolean, reply string, v array<double>")

    out = _once(docs, text, ask, path, tiers)
    return out if "v" in out.columns else out.withColumn("v", F.lit(None).cast("array<double>"))
