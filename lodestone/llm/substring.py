"""Substring dedup with a log-structured index of window fingerprints.

Every window of ``WINDOW`` words is represented by the smallest ``GRAM``-word hash in it, so equal
windows have equal representatives. Successive windows with one representative form a *segment*
(g, d1, d2, m): representative, a 96-bit BLAKE2b digest of the segment's words, number of windows. A *run*
of the index is an immutable table of distinct segments, bucketed and sorted by g, each with its first
place (b, p): batch, and in one long the document's number in the batch's order and the first word. The few
representatives with very many segments stand in an unbucketed part of the run, so no bucket holds a hot one.

A batch is merge-joined with the runs; none of the steps forms pairs:
1. segments of history whose representative the batch has are found by merge join (a run's buckets are
   read as they lie, only the batch's representatives are dealt); representatives seen once in both are
   dropped (they hold no repeated window);
2. a segment whose words occur earlier (equal digests) is repeated whole;
3. where a representative has several different segments, the first place of each is opened into its
   windows, and each window whose words occur earlier (equal 128-bit digests) is repeated;
4. repeated windows are collected per document and their words removed.
The batch's distinct segments become a new run; ``FANOUT`` runs of a level are compacted into one of the
next, keeping first places. A hash only ever proposes a candidate; equality is that of a cryptographic
digest of the words, so different passages are not taken for equal.

The index lives in ``folder``: runs, texts (bucketed by document, so later batches open places without
moving texts) and a manifest, appended to at each commit, from which any later session goes on.

Order is (batch, doc_id, hash of the text, start), so batches of rising doc_id give the order of doc_ids.
A text may have 2^24 words, a batch 2^39 documents; more are refused with an error.
Defined results: null, empty and short texts have no window and lose nothing; rows equal in doc_id and
text are one document, each gets its result; a null doc_id comes before all others; an empty batch
gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import drop_at_exit
from .common import scratch_dir, ship, small_batches, table
from .wordhash import Words, grams, parts, slices, words_of

WINDOW, GRAM, FANOUT = 20, 6, 2
#: Batches that one table is fed to the index in: enough for a compaction.
BATCHES = 3
#: A representative is hot from so many segments on, and from this share of a run's; so few can be hot.
HOT_ROWS, HOT_SHARE = 1000, 20_000
DOC = ["doc", "mark"]
KEY = ["g", "d1", "d2", "m"]
SEGMENT = "g long, d1 long, d2 int, m int, p long"
RUN = "g long, d1 long, d2 int, m int, b int, p long"
TEXT = "doc_id long, doc long, mark long, text string, r long"
#: Bits of a packed hash that hold the place of its gram; bits of a place that hold its first word; bits of
#: a document's number that hold its row within a sorted part.
_LOW, _WORD, _ROW = 20, 24, 23


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def segments(words: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """words: hashes of several documents in a row; ends: where each ends. (g, number of windows, first
    word) of segments. Ties go to the leftmost gram, so no segment holds a window twice; windows across
    a multiple of ``1 << _LOW``, where places start anew, are a segment each."""
    none = np.zeros(0, dtype=np.int64)
    n = len(words)
    if n < window:
        return none, none, none
    hashes = grams(words, gram)
    low = np.uint64(_LOW)
    packed = hashes >> low << low | (np.arange(len(hashes)) % (1 << _LOW)).astype(np.uint64)
    best = _sliding_min(packed, window - gram + 1)
    starts = np.arange(n - window + 1)
    across = starts % (1 << _LOW) + window - gram >= 1 << _LOW
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(starts)]
    fits = starts + window <= ends[doc]
    new = np.empty(len(starts), dtype=bool)
    new[0] = True
    new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1]) | across[1:] | across[:-1]
    first = np.flatnonzero(new & fits)
    if not len(first):
        return none, none, none
    # A document's windows are its first ones, so a segment ends at the next one or with its document.
    after = np.append(np.flatnonzero(new), len(starts))
    stop = np.minimum(after[np.searchsorted(after, first, side="right")], ends[doc[first]] - window + 1)
    return (best[first] >> low).view(np.int64), stop - first, first


def _segment_rows(window: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            number, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for i, j in slices([len(t) for t in texts]):
                words = Words(texts[i:j])
                if words.sizes.max(initial=0) > 1 << _WORD:
                    raise ValueError("a text has more than 2^24 words")
                ends = np.cumsum(words.sizes)
                g, m, first = segments(words.hashes() if len(words.begin) else np.zeros(0, dtype=np.uint64), ends, window, gram)
                doc = np.searchsorted(ends, first, side="right")
                digests = words.digests(first, first + m + window - 2)
                begin = np.concatenate([[0], ends])[doc]
                columns = [g, digests[:, 0], digests[:, 1].astype(np.int32), m.astype(np.int32), number[i + doc] << _WORD | first - begin]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["g", "d1", "d2", "m", "p"])

    return rows


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat starts and lengths of a list column of packed spans, and where each row's begin."""
    begin = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat >> _WORD, flat & ((1 << _WORD) - 1), begin


def _window_rows(window: int):
    """(b, r, text, spans) -> (w1, w2, b, p) of the spans' windows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            b, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            texts, (a, m, begin) = batch.column(2).to_pylist(), _spans(batch.column(3))
            owner = np.repeat(np.arange(len(texts)), np.diff(begin))
            for i, j in slices([len(t) for t in texts], 100_000):
                words = Words(texts[i:j])
                first = np.concatenate([[0], np.cumsum(words.sizes)])
                mine = slice(begin[i], begin[j])
                count, own = m[mine], owner[mine]
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                local = np.repeat(a[mine], count) + step
                row = np.repeat(own, count)
                starts = first[row - i] + local
                digests = words.digests(starts, starts + window - 1)
                columns = [digests[:, 0], digests[:, 1], b[row].astype(np.int32), r[row].astype(np.int64) << _WORD | local]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["w1", "w2", "b", "p"])

    return rows


def _kept_rows(window: int, with_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            n_words, n_removed, shas, kept_texts = [], [], [], []
            a, m, begin = _spans(batch.column(2))
            for r, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                gone = 0
                kept = words
                if begin[r + 1] > begin[r]:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    mine = slice(begin[r], begin[r + 1])
                    np.add.at(edge, a[mine], 1)
                    np.add.at(edge, a[mine] + m[mine] - 1 + window, -1)
                    covered = np.cumsum(edge)[:-1] > 0
                    gone = int(covered.sum())
                    kept = [w for w, c in zip(words, covered.tolist()) if not c]
                joined = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(gone)
                shas.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    kept_texts.append(joined.decode("utf-8", "surrogatepass"))
            out = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out.append(pa.array(kept_texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return rows


class FingerprintIndex:
    """Finds and removes repeated passages batch by batch: ``add`` a batch, then ``commit`` it.

    ``folder`` may hold an index of an earlier session, which is gone on with; without one, the index lives
    in the session's shared scratch folder and goes when the application ends. ``buckets``: of a new index's
    tables, by default the session's shuffle partitions."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT, folder: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.folder = folder or f"{scratch_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.own = folder is None
        self.state = self._manifest() or {"version": 0, "window": window, "gram": gram, "fanout": fanout, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "texts": [], "runs": []}
        if self.own:
            drop_at_exit(spark, self.folder)
        self.open = None
        self.runs = [{**run, "main": self._table(run["path"], RUN, ["g"], KEY)} for run in self.state["runs"]]
        self.texts = [self._table(path, TEXT, DOC, DOC) for path in self.state["texts"]]

    def _manifest(self) -> dict | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return json.loads(max(((r.version, r.state) for r in self.spark.read.schema("version long, state string").json(f"{self.folder}/manifest").collect()), default=(0, "null"))[1])

    def _table(self, path: str, schema: str, by: list[str], order: list[str]) -> DataFrame:
        """A bucketed table written before, under a name of this session's catalog."""
        name = f"lodestone_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({', '.join(by)}) SORTED BY ({', '.join(order)}) INTO {self.state['buckets']} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _scratch(self, df: DataFrame, name: str) -> DataFrame:
        path = self._write(df, name)
        self.open["scratch"].append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _bucketed(self, df: DataFrame, name: str, by: list[str], order: list[str], dealt: bool = False) -> tuple[str, DataFrame]:
        """Write df by buckets. dealt: it is in such parts already."""
        path, called, n = f"{self.folder}/{name}-{uuid.uuid4().hex}", f"lodestone_{uuid.uuid4().hex}", self.state["buckets"]
        (df if dealt else df.repartition(n, *by)).write.bucketBy(n, *by).sortBy(*order).option("path", path).saveAsTable(called)
        return path, self.spark.table(called)

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _history(self, asked: DataFrame) -> DataFrame | None:
        """Segments of all runs whose g is one of ``asked`` (distinct)."""
        found = []
        for run in self.runs:
            found.append(run["main"].join(asked.hint("merge"), "g", "left_semi").select(*KEY, "b", "p"))
            if run["hot"]:
                rows = self.spark.read.schema(RUN).parquet(run["hot"])
                few = rows.select("g").distinct().join(asked, "g", "left_semi")  # as few as few_values
                found.append(rows.join(F.broadcast(few), "g", "left_semi").select(*KEY, "b", "p"))
        return reduce(DataFrame.unionByName, found) if found else None

    def add(self, docs: DataFrame, with_text: bool = False) -> DataFrame:
        """docs: (doc_id, text). Their rows (doc_id, n_words, n_removed, kept_sha256[, kept_text])."""
        if self.open is not None:
            self.commit()
        spark, number, window, gram = self.spark, len(self.texts), self.state["window"], self.state["gram"]
        self.open = {"scratch": []}
        text, n = F.coalesce("text", F.lit("")), self.state["buckets"]
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))
        # Sorted parts are numbered in their order, and rows within them.
        at = F.monotonically_increasing_id()
        part, row = F.shiftright(at, 33), at.bitwiseAND((1 << 33) - 1)
        fits = (part < 1 << 63 - _WORD - _ROW) & (row < 1 << _ROW)
        number_ = F.when(fits, F.shiftleft(part, _ROW).bitwiseOR(row)).otherwise(F.raise_error(F.lit("a batch has too many documents")).cast("long"))
        ranks = self._scratch(docs.select(*DOC).distinct().repartitionByRange(n, *DOC).sortWithinPartitions(*DOC).select(*DOC, number_.alias("r")), "ranks")
        path, mine = self._bucketed(docs.repartition(n, *DOC).join(ranks, DOC).select("doc_id", *DOC, "text", "r"), "texts", DOC, DOC, dealt=True)
        self.texts.append(mine)
        self.open["texts"] = path
        new = self._scratch(spark.read.schema(TEXT).parquet(path).select("r", "text").mapInArrow(_segment_rows(window, gram), SEGMENT), "batch")
        self.open["batch"] = new
        new = new.withColumn("b", F.lit(number)).select(*KEY, "b", "p")
        here = F.col("b") == number

        counts = self._scratch(new.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "counts")
        self.open["hot"] = few_values(counts.filter(F.col("n") >= max(HOT_ROWS, new.count() // HOT_SHARE)).select("g"))
        again, old = counts.filter("n > 1").select("g"), self._history(counts.select("g"))
        if old is not None:
            old = self._scratch(old, "old")
            again = again.unionByName(old.select("g")).distinct()
        # Written first: the joins then stand on plain exchanges, whose hot parts Spark splits.
        seen = self._scratch(new.join(self._scratch(again, "again"), "g", "left_semi"), "seen")
        both = seen if old is None else seen.unionByName(old)
        # A batch holds a segment's words once in a run, so of several places those of the least batch are one.
        firsts = both.groupBy(*KEY).agg(F.min("b").alias("b"), F.min(F.when(here, F.col("p"))).alias("mine"), F.min_by("p", "b").alias("other"), F.count(F.lit(1)).alias("n"))
        firsts = self._scratch(firsts.select(*KEY, "b", "mine", F.when(here, F.col("mine")).otherwise(F.col("other")).alias("p"), "n"), "firsts")

        span = F.shiftleft(F.col("p").bitwiseAND((1 << _WORD) - 1), _WORD).bitwiseOR(F.col("m").cast("long")).alias("span")
        of = F.shiftright("p", _WORD).alias("r")
        later = lambda rows: rows.filter((F.col("first") < number) | (F.col("p") != F.col("mine")))
        whole = later(seen.join(firsts.filter("n > 1").select(*KEY, F.col("b").alias("first"), "mine"), KEY)).select(of, span)
        several = firsts.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("g")
        need = firsts.join(self._scratch(several, "several"), "g", "left_semi").groupBy("b", of).agg(F.collect_list(span).alias("spans"))
        need = self._scratch(need, "need")
        opened = [t.join(self._placed(need.filter(F.col("b") == i), i, ranks).hint("shuffle_hash"), DOC).select("b", t["r"], "text", "spans") for i, t in enumerate(self.texts)]
        windows = self._scratch(reduce(DataFrame.unionByName, opened).mapInArrow(_window_rows(window), "w1 long, w2 long, b int, p long"), "windows")
        earliest = windows.groupBy("w1", "w2").agg(F.min("b").alias("first"), F.min(F.when(here, F.col("p"))).alias("mine"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        single = later(windows.filter(here).join(earliest, ["w1", "w2"])).withColumn("m", F.lit(1)).select(of, span)
        found = whole.unionByName(single).groupBy("r").agg(F.collect_set("span").alias("spans"))
        found = self._placed(found, number, ranks).select(*DOC, "spans")
        # Read by the caller at any time after: kept as long as the index.
        spans = spark.read.schema(found.schema).parquet(self._write(found, "spans"))
        kept = self.open["scratch"].pop(1)  # the batch's segments, for commit
        for used in self.open["scratch"]:
            self._remove(used)
        self.open["scratch"] = [kept]
        out = mine.join(spans.hint("shuffle_hash"), DOC, "left").select("doc_id", "text", "spans")
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
        return out.mapInArrow(_kept_rows(window, with_text), schema)

    def _placed(self, rows: DataFrame, number: int, ranks: DataFrame) -> DataFrame:
        """rows (r, ...) of a batch with their documents' keys: from the texts' small columns, or, of the
        batch in hand, from its numbers."""
        keys = ranks if number == len(self.texts) - 1 else self.spark.read.schema(TEXT).parquet(self.state["texts"][number]).select(*DOC, "r").distinct()
        return rows.join(keys, "r").drop("r")

    def _run(self, rows: DataFrame, level: int, hot: DataFrame | None) -> dict:
        """Write distinct segments with their first places as a run, hot representatives aside."""
        first = lambda df: df.groupBy(*KEY).agg(F.min("b").alias("b"), F.min_by("p", "b").alias("p")) if level else df.groupBy(*KEY, "b").agg(F.min("p").alias("p"))
        aside = None
        if hot is not None:
            aside = self._write(first(rows.join(F.broadcast(hot), "g", "left_semi")).select(*KEY, "b", "p"), "hot")
            rows = rows.join(F.broadcast(hot), "g", "left_anti")
        # Runs of distinct segments need no combining before they are dealt, a batch's do.
        rows = first(rows.repartition(self.state["buckets"], "g")) if level else first(rows)
        path, main = self._bucketed(rows.select(*KEY, "b", "p"), "run", ["g"], KEY, dealt=level > 0)
        return {"level": level, "path": path, "hot": aside, "main": main}

    def _hot_of(self, runs: list[dict]) -> DataFrame | None:
        """Representatives with that many segments in one of the runs that all together may be hot; a
        run's buckets are counted as they lie. Those that were hot stay so."""
        rows = sum(r["main"].count() for r in runs)
        least = max(HOT_ROWS, rows // HOT_SHARE) // len(runs)
        found = [r["main"].groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("g") for r in runs]
        found += [self.spark.read.schema(RUN).parquet(r["hot"]).select("g") for r in runs if r["hot"]]
        return few_values(reduce(DataFrame.unionByName, found).distinct())

    def commit(self) -> None:
        """Make the last batch's segments a run, compact full levels and append to the manifest."""
        number, fanout = len(self.texts) - 1, self.state["fanout"]
        self.state["texts"].append(self.open["texts"])
        self.runs.append(self._run(self.open["batch"].withColumn("b", F.lit(number)), 0, self.open["hot"]))
        level, old = 0, []
        while len(full := [r for r in self.runs if r["level"] == level]) >= fanout:
            rows = [r["main"].select(*KEY, "b", "p") for r in full] + [self.spark.read.schema(RUN).parquet(r["hot"]).select(*KEY, "b", "p") for r in full if r["hot"]]
            merged = self._run(reduce(DataFrame.unionByName, rows), level + 1, self._hot_of(full))
            self.runs = [r for r in self.runs if r["level"] != level] + [merged]
            old += full
            level += 1
        self.state["version"] += 1
        self.state["runs"] = [{k: r[k] for k in ("level", "path", "hot")} for r in self.runs]
        self.spark.createDataFrame([(self.state["version"], json.dumps(self.state))], "version long, state string").coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
        for path in [*self.open["scratch"], *(x for r in old for x in (r["path"], r["hot"]) if x)]:
            self._remove(path)
        self.open = None


def few_values(few: DataFrame) -> DataFrame | None:
    """A short list as a literal table; None if it is empty. At most HOT_SHARE values reach a share of
    1 / HOT_SHARE of a run, FANOUT * FANOUT times as many its part in one of the runs merged."""
    values = [tuple(r) for r in few.collect()]
    return few.sparkSession.createDataFrame(values, few.schema) if values else None


def remove_repeats(docs: DataFrame, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """docs (doc_id, text) fed to a fresh index in ``batches`` runs of rising doc_id."""
    ship(docs.sparkSession)
    index, key = FingerprintIndex(docs.sparkSession), F.coalesce("doc_id", F.lit(-(1 << 63)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    out: DataFrame | None = None
    for i in range(len(cuts) + 1):
        part = docs
        if i:
            index.commit()
            part = part.filter(F.col("doc_id") > cuts[i - 1])
        if i < len(cuts):
            part = part.filter(key <= cuts[i])
        found = index.add(part, with_text)
        out = found if out is None else out.unionByName(found)
    return out


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
