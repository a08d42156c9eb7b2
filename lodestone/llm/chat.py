"""Chat formatting: whole conversations as training text with a loss mask on the assistant's words.

The template writes a user's turn as ``[INST]text[/INST]``, an assistant's as ``<s>text</s>`` and any other
role's as ``[ROLE]role[/ROLE]<s>text</s>``. Control strings inside texts and roles get a backslash after
their first character, and those that have such backslashes already get one more; reading back takes one
away, so every text survives.

Offset-aligned masks: a conversation is rendered whole and encoded once, with the offsets of its tokens.
Turns' spans and tokens' spans are both sorted, so a binary search finds the turn that a token meets; a
token has loss if it meets an assistant's text, and its loss span is that part of it alone, so a token that
runs over an edge trains on nothing but the text.

Defined results: rows go by turn (null first), then role, then text; a null role or text is empty; equal
rows are turns each; a row without a conv_id is a conversation of its own; an empty table gives no rows;
further columns are not read. A conversation is one record of the result and so is built in one task; no
other rows meet there.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, small_batches, table
from .wordhash import parts

VOCABULARY = "byte_bpe_50k.json"
USER, ASSISTANT = "user", "assistant"
_CONTROL = re.compile(r"(<)(\\*)(/?s>)|(\[)(\\*)(/?(?:INST|ROLE)\])")
_MARK = re.compile(r"</?s>|\[/?(?:INST|ROLE)\]")
_SPANS = "array<struct<start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Turn(NamedTuple):
    role: str
    text: str


class Read(NamedTuple):
    """A turn of a rendered conversation: where its escaped text lies."""

    role: str
    start: int
    end: int


def vocabulary() -> str:
    """The installed file of a public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[1] or m[4]}\\{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[1] or m[4]}{(m[2] or m[5] or '')[1:]}{m[3] or m[6]}", text)


def render(turns: list[Turn]) -> tuple[str, list[Read]]:
    """The conversation's text, and each turn's span in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role == USER:
            before, after = "[INST]", "[/INST]"
        else:
            before, after = ("" if role == ASSISTANT else f"[ROLE]{escape(role)}[/ROLE]") + "<s>", "</s>"
        spans.append(Read(role, at + len(before), at + len(before) + len(body)))
        out += [before, body, after]
        at = spans[-1].end + len(after)
    return "".join(out), spans


def read_back(formatted: str) -> list[Read]:
    """Turns of a rendered conversation, by its marks alone."""
    marks = [(m.group(), m.start(), m.end()) for m in _MARK.finditer(formatted)]
    out, role = [], None
    for (opened, _, start), (closed, end, _) in zip(marks[::2], marks[1::2], strict=True):
        if closed != opened[0] + "/" + opened[1:]:
            raise ValueError(f"{opened} is closed by {closed}")
        if opened == "[ROLE]":
            role = unescape(formatted[start:end])
            continue
        out.append(Read(USER if opened == "[INST]" else ASSISTANT if role is None else role, start, end))
        role = None
    return out


def loss_spans(offsets: np.ndarray, turns: list[Read]) -> tuple[np.ndarray, np.ndarray]:
    """(mask, spans) of tokens (start, end), sorted: whether each meets an assistant's text, and the part
    that does (0, 0 where none). Empty turns meet nothing. A token that meets several texts spans from the
    first's to the last's; the byte-level rule keeps marks of letters between two texts, so none does."""
    mine = np.array([(t.start, t.end) for t in turns if t.role == ASSISTANT and t.end > t.start], dtype=np.int64).reshape(-1, 2)
    if not len(mine) or not len(offsets):
        return np.zeros(len(offsets), dtype=bool), np.zeros((len(offsets), 2), dtype=np.int64)
    first = np.searchsorted(mine[:, 1], offsets[:, 0], side="right")  # the first text that ends after the token starts
    last = np.searchsorted(mine[:, 0], offsets[:, 1], side="left") - 1  # the last that starts before it ends
    mask = (first <= last) & (offsets[:, 1] > offsets[:, 0])
    a, b = np.minimum(first, len(mine) - 1), np.maximum(last, 0)
    spans = np.stack([np.maximum(offsets[:, 0], mine[a, 0]), np.minimum(offsets[:, 1], mine[b, 1])], axis=1)
    return mask, np.where(mask[:, None], spans, 0)


def format_chats(rows: DataFrame, path: str) -> DataFrame:
    """(conv_id, formatted, ids, offsets, loss, spans) of each conversation of rows (conv_id, turn, role, text):
    token ids, their character offsets in the formatted text, whether each has loss and the characters that
    do. ``path``: a tokenizer's file."""
    ship(rows.sparkSession)
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}["conv_id"]
    listed = rows.select("conv_id", alone.alias("_alone"), turn.alias("t")).groupBy("conv_id", "_alone").agg(F.sort_array(F.collect_list("t")).alias("t"))
    listed = listed.select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for batch in parts(batches, 128):
            done = [render(list(map(Turn, r, t))) for r, t in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist())]
            cols: list[list] = [[], [], [], []]
            for (_, turns), e in zip(done, tokenizer.encode_batch([text for text, _ in done], add_special_tokens=False)):
                offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
                mask, spans = loss_spans(offsets, turns)
                for col, x in zip(cols, (e.ids, offsets, mask, spans)):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([text for text, _ in done]), pa.array(cols[0], pa.list_(pa.int32())), _pairs(cols[1]), pa.array(cols[2], pa.list_(pa.bool_())), _pairs(cols[3])], ["conv_id", "formatted", "ids", "offsets", "loss", "spans"])

    return listed.mapInArrow(solve, f"conv_id {kind}, formatted string, ids array<int>, offsets {_SPANS}, loss array<boolean>, spans {_SPANS}")


def _pairs(held: list[np.ndarray]) -> pa.ListArray:
    """Arrays of (start, end) as Arrow lists of structs."""
    edges = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
    flat = np.concatenate([*held, np.zeros((0, 2), np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"]))


def loss_text(formatted: str, loss: np.ndarray, spans: np.ndarray) -> str:
    """Text under the loss mask, unescaped turn by turn. Tokens that share a character (its bytes are split
    between them) count it once."""
    held = spans[np.asarray(loss, dtype=bool)]
    if not len(held):
        return ""
    turn = np.searchsorted([t.start for t in read_back(formatted)], held[:, 0], side="right")
    reach = np.maximum.accumulate(held[:, 1])
    # Runs of tokens without a gap, within a turn.
    first = np.flatnonzero(np.concatenate([[True], (held[1:, 0] > reach[:-1]) | (turn[1:] != turn[:-1])]))
    runs = zip(turn[first].tolist(), held[first, 0].tolist(), reach[np.append(first[1:], len(held)) - 1].tolist())
    return "".join(unescape("".join(formatted[a:b] for _, a, b in mine)) for _, mine in groupby(runs, lambda r: r[0]))


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them: (conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars)."""
    kind = {f.name: f.dataType.simpleString() for f in chats.schema}["conv_id"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 128):
            out = []
            spans = batch.column("spans")
            pairs = np.stack([spans.flatten().field(i).to_numpy() for i in (0, 1)], axis=1)
            edges = np.concatenate([[0], np.cumsum(spans.value_lengths().to_numpy(zero_copy_only=False))])
            masks = batch.column("loss").flatten().to_numpy(zero_copy_only=False)
            for i, text in enumerate(batch.column("formatted").to_pylist()):
                turns, whole = read_back(text), hashlib.sha256()
                for t in turns:
                    whole.update(f"{t.role}\n{unescape(text[t.start : t.end])}\n".encode("utf-8", "surrogatepass"))
                kept = loss_text(text, masks[edges[i] : edges[i + 1]], pairs[edges[i] : edges[i + 1]])
                out.append((len(turns), whole.hexdigest(), len(kept), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            n, whole, chars, sha, size = map(list, zip(*out))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(whole), pa.array(chars, pa.int64()), pa.array(sha), pa.array(size, pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInArrow(solve, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, USER, hard), (-7, 1, ASSISTANT, hard)], rows.schema)
    return digests(format_chats(rows.union(more), vocabulary()))


_MATCHES = r"len(regexp_extract_all({0}, '<\\*/?s>|\[\\*/?(?:INST|ROLE)\]'))"
_LENGTH = "(length({0}) + " + _MATCHES + ")"
OP13_SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]', NULL FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_LENGTH.format("text")} + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 + {_LENGTH.format("role")} END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id, alone"""
