"""Language ID: word-first backoff.

Known words are scored by their log frequency in each language; a word known in none falls back to
its character n-grams, from the longest order down to the first at which any of them is known. A
text's language is the one with the largest mean score over its words.

Fitted on a bounded sample: about ``DOCS`` learnable documents of each language, drawn by a hash of the
id, or fewer of each where that would make more than ``ALL_DOCS``; every language is learnt, and all words and
n-grams of the sample are kept. Tables hold what was counted, (n-gram, language) by (n-gram, language); what
was not counted has one frequency a language. Tables of few languages are also kept written out, which is only
faster. Each text is scored whole. A word is a run of letters; numerals such as superscripts are none.

Defined results: null, empty and letterless texts are ``und`` with score 0; ties go to the
language first in code-point order; repeated rows are scored each; with nothing to learn from, every
text is ``und``; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, small_batches, table
from .wordhash import parts

#: Bytes up to which a table's rows are written out; languages up to which their sizes go to every task.
FULL, SMALL_LANGS = 32_000_000, 100_000
DOCS, ALL_DOCS, ORDERS = 1500, 100_000, (5, 4, 3, 2, 1)
LETTERS = re.compile(r"[^\W\d_]+")
#: Words whose scores a Python worker remembers, and bytes of those scores.
CACHE_WORDS, CACHE_BYTES = 200_000, 16_000_000


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    words = LETTERS.findall(text.lower())
    if words and not "".join(words).isalpha():  # the pattern lets numerals pass that are no digits
        words = ["".join(run) for w in words for letters, run in groupby(w, str.isalpha) if letters]
    return words


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update((lang, w) for w in words_of(text))
        langs, words = zip(*counts) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "gram", "n"])


class Table(dict):
    """gram -> its place: ``langs`` and ``logs`` from ``edges[place]`` to the next edge are the languages it was
    counted in and its log frequencies there; ``rest`` is the log frequency of an uncounted gram by language."""

    def __init__(self, counts: dict[str, dict[int, int]], langs: int):
        super().__init__((g, i) for i, g in enumerate(counts))
        self.edges = np.concatenate([[0], np.cumsum([len(c) for c in counts.values()])]).astype(np.int64)
        self.langs = np.fromiter((i for c in counts.values() for i in c), dtype=np.int32, count=self.edges[-1])
        found = np.fromiter((n for c in counts.values() for n in c.values()), dtype=np.float64, count=self.edges[-1])
        total = np.bincount(self.langs, found, minlength=langs) + 0.5 * max(1, len(counts))
        self.logs = np.log((found + 0.5) / total[self.langs]).astype(np.float32)
        self.rest = np.log(0.5 / total).astype(np.float32)
        self.write_out()

    def __reduce__(self):
        return _table, (dict(self), self.edges, self.langs, self.logs, self.rest)

    def write_out(self) -> None:
        self.full = None
        if 4 * len(self) * len(self.rest) <= FULL:
            self.full = np.tile(self.rest, (len(self), 1))
            self.full[np.repeat(np.arange(len(self)), np.diff(self.edges)), self.langs] = self.logs

    def mean(self, places: list[int]) -> np.ndarray:
        """Mean log frequency of some grams in each language."""
        return self.full[places].mean(axis=0) if self.full is not None else np.mean([self.scores(p) for p in places], axis=0)

    def scores(self, place: int) -> np.ndarray:
        """Log frequency of a gram in each language."""
        if self.full is not None:
            return self.full[place]
        out, a, b = self.rest.copy(), self.edges[place], self.edges[place + 1]
        out[self.langs[a:b]] = self.logs[a:b]
        return out


def _table(places: dict[str, int], *arrays: np.ndarray) -> Table:
    out = Table.__new__(Table)
    out.update(places)
    out.edges, out.langs, out.logs, out.rest = arrays
    out.write_out()
    return out


class Model:
    """Log frequencies by language: ``words`` and, for each order, ``grams``."""

    def __init__(self, langs: list[str], words: Table, grams: dict[int, Table]):
        self.langs, self.words, self.grams, self.key = langs, words, grams, uuid.uuid4().hex

    def score_word(self, word: str) -> np.ndarray:
        if (row := self.words.get(word)) is not None:
            return self.words.scores(row)
        padded = f"^{word}$"
        for n in ORDERS:
            table_ = self.grams[n]
            found = [row for i in range(len(padded) - n + 1) if (row := table_.get(padded[i : i + n])) is not None]
            if found:
                return table_.mean(found)
        return np.zeros(len(self.langs))


class Known(dict):
    """word -> row of ``scores``, filled as words come; kept from task to task for one model."""

    last: "Known | None" = None

    def __init__(self, model: Model):
        self.model = model
        self.limit = max(1000, min(CACHE_WORDS, CACHE_BYTES // (4 * max(1, len(model.langs)))))
        self.scores = np.zeros((self.limit, len(model.langs)), dtype=np.float32)

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.scores[row] = self.model.score_word(word)
        return row

    def mean(self, words: list[str]) -> np.ndarray:
        """Mean score of words, in runs that fit the cache."""
        total = np.zeros(len(self.model.langs))
        step = self.limit // 2
        for i in range(0, len(words), step):
            part = words[i : i + step]
            if len(self) + len(part) > self.limit:
                self.clear()
            rows = np.fromiter(map(self.__getitem__, part), dtype=np.int64, count=len(part))
            total += self.scores[rows].sum(axis=0, dtype=np.float64)
        return total / len(words)

    @classmethod
    def of(cls, model: Model) -> "Known":
        if cls.last is None or cls.last.model.key != model.key:
            cls.last = cls(model)
        return cls.last


def fit(docs: DataFrame, docs_per_lang: int = DOCS, all_docs: int = ALL_DOCS) -> Model:
    """docs: learnable rows (doc_id, text, lang). The counts of the sample's words go to the driver, which
    is bounded by docs_per_lang documents of each language and about ``all_docs`` in all. Languages are those
    the sample has words of."""
    ship(docs.sparkSession)
    docs = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    langs_ = sizes.count()
    each = min(docs_per_lang, max(1, all_docs // max(1, langs_)))
    # A row a language: sent to every task where these are few, so that no text moves before it is drawn.
    sizes = F.broadcast(sizes) if langs_ <= SMALL_LANGS else sizes
    drawn = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) < F.least(F.lit(1.0), each / F.col("_n")) * (1 << 20)
    sample = docs.select("doc_id", "text", "lang").join(sizes, "lang").filter(drawn)
    counted = sample.select("text", "lang").mapInArrow(_word_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(counted.column("lang").unique().to_pylist())
    at = {lang: i for i, lang in enumerate(langs)}
    words: dict[str, dict[int, int]] = {}
    grams: dict[int, dict[str, dict[int, int]]] = {n: {} for n in ORDERS}
    for batch in counted.to_batches(10_000):
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            words.setdefault(word, {})[at[lang]] = n
    for word, counts in words.items():
        padded = f"^{word}$"
        for n, table_ in grams.items():
            for i in range(len(padded) - n + 1):
                held = table_.setdefault(padded[i : i + n], {})
                for j, c in counts.items():
                    held[j] = held.get(j, 0) + c
    return Model(langs, Table(words, len(langs)), {n: Table(g, len(langs)) for n, g in grams.items()})


def predict(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """docs (text, *carry) with lang_pred and score."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded as the fitting sample is
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = Known.of(model)
        for batch in parts(batches):
            best, sure = [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text) if text else []
                if not words or not model.langs:
                    best.append("und")
                    sure.append(0.0)
                    continue
                mean = known.mean(words)
                weight = np.exp((mean - mean.max()) * min(len(words), 10))
                best.append(model.langs[int(mean.argmax())])
                sure.append(float(weight.max() / weight.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(best, pa.string()), pa.array(sure, pa.float64())], names=[*carry, "lang_pred", "score"])

    schema = ", ".join([*[f"`{c}` {fields[c]}" for c in carry], "lang_pred string", "score double"])
    return docs.select("text", *carry).mapInArrow(score, schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    return predict(docs, fit(docs.filter("not held_out and doc_id is not null")), ["doc_id", "held_out"])
