"""Packing: first-fit decreasing with a tournament tree of bin capacities, per randomised group.

A document is its token ids and an end id. Pieces of exactly one sequence are cut off first; the
remainders of a group of documents are sorted by falling length and each goes to the first bin with
room, found in log(bins) steps by a tree whose nodes hold the most room of any bin below them.
Groups are drawn by a hash of the document, hold about ``GROUP_DOCS`` documents, and pack on their own.

Defined results: a null or empty text is the end id alone; repeated rows are packed each by itself;
an empty table gives no pieces; further columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_for, ship, small_batches, table
from .wordhash import parts, tidy

LENGTH = 4096
END_ID = 2
GROUP_DOCS = 2048
#: Words whose ids a task remembers: the latest half, and those of the half before till they are met again.
CACHE_WORDS = 600_000


_PARTS = re.compile(rb"([A-Za-z\x80-\xff]*)([!-/:-@\[-`{-~]*)")


class WordEncoder:
    """ids of whole texts, word by word: the vocabulary's splitting rule never crosses white space,
    so a text's ids are those of its words in turn, and a word's ids are remembered. It also splits
    letters from the marks that follow them, so the two are looked up apart; unknown words of letters
    alone are encoded as one text, whose ids are cut after each id that ends a word."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        # A task has one core; threads of the library's own would each keep memory besides.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known, self.before = Tokenizer.from_file(path), limit // 2, {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")

    def _learn_plain(self, words: list[bytes]) -> None:
        """Words of lower-case letters, a few hundred to a text."""
        runs = [words[i : i + 200] for i in range(0, len(words), 200)]
        for i in range(0, len(runs), 20):
            some = runs[i : i + 20]
            texts = [b" ".join(run).decode() for run in some]
            for run, e in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) != len(run):
                    self._learn_each([w.decode() for w in run])
                    continue
                raw, a = ids.tobytes(), 0
                for w, b in zip(run, (4 * cuts).tolist()):
                    self.known[w] = raw[a:b]
                    a = b

    def _learn_each(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.known[w.encode()] = np.array(e.ids, dtype="<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        known, plain, odd, joined = self.known, set(), set(), []
        for w in words:
            if w.isalpha() and w.islower():
                plain.add(w)
                continue
            stem, tail = m.groups() if (m := _PARTS.fullmatch(w)) else (b"", b"")
            low = stem.decode("utf-8", "replace").lower()
            if low and low.isalpha() and "\u03c2" not in low and "\u03c3" not in low:
                if (key := low.encode()) not in known:
                    plain.add(key)
                if tail and tail not in known:
                    odd.add(tail.decode())
                if key != w:
                    joined.append((w, key, tail))
            else:
                odd.add(w.decode())
        self._learn_plain(list(plain))
        self._learn_each(list(odd))
        for w, key, tail in joined:
            known[w] = known[key] + known[tail] if tail else known[key]

    @staticmethod
    def folded(text: str) -> bytes:
        """Words with one space between them, A-Z as a-z: the vocabulary does that itself. Texts that may
        hold its special tokens, which mind case, keep theirs."""
        raw = text.encode()
        return b" ".join((raw if b"<|" in raw else raw.lower()).split())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Words are found as runs of bytes (a full stop or
        comma after a letter apart) and numbered by their bytes; each different one is looked up once."""
        folded = [self.folded(t) for t in texts]
        data = b" ".join([x for x in folded if x]) + b" "
        if len(data) == 1:
            return [b""] * len(texts)
        raw = np.frombuffer(data, dtype=np.uint8)
        gaps = np.flatnonzero(raw == 32)
        begin = np.concatenate([[0], gaps[:-1] + 1])
        last, before = raw[gaps - 1], raw[np.maximum(gaps - 2, 0)]
        stops = ((last == 46) | (last == 44)) & (gaps - begin > 1) & (before >= 97) & (before <= 122)
        starts = np.sort(np.concatenate([begin, gaps[stops] - 1]))
        buffers = [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]
        numbered = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        which, different = numbered.indices.to_numpy(), numbered.dictionary
        held = different.buffers()[2].to_pybytes()
        edge = np.frombuffer(different.buffers()[1], dtype=np.int64)[: len(different) + 1]
        ends = edge[1:] - (np.frombuffer(held, dtype=np.uint8)[edge[1:] - 1] == 32)
        words = [held[a:b] for a, b in zip(edge[:-1].tolist(), ends.tolist())]
        found = list(map(self.known.get, words))
        new = {w for w, ids in zip(words, found) if ids is None}
        if new:
            if len(self.known) + len(new) > self.limit:
                self.before, self.known = self.known, {}
                new = set(words)
            again = {w: self.before[w] for w in new if w in self.before}
            self.known |= again
            self.learn(new - again.keys())
            found = [self.known[w] for w in words]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        flat, first = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(size) - size
        count = size[which]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.arange(upto[-1]) + np.repeat(first[which] - upto[:-1], count)]
        after = np.cumsum([len(x) + 1 if x else 0 for x in folded])
        cuts = upto[np.searchsorted(starts, after)].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *cuts[:-1]], cuts)]


def batched(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of at most ``most`` characters together (or one longer text)."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > most:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run


class FirstFit:
    """Bins of one size; add(n) gives the number of the first bin with room for n and its fill."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.most, self.size, self.bins = [size] * (2 * self.leaves), size, 0

    def add(self, n: int) -> tuple[int, int]:
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < n:
                at += 1
        fill = self.size - most[at]
        most[at] -= n
        bin_, at = at - self.leaves, at // 2
        while at:
            best = max(most[2 * at], most[2 * at + 1])
            if most[at] == best:
                break
            most[at] = best
            at //= 2
        self.bins = max(self.bins, bin_ + 1)
        return bin_, fill


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, remembered: int = CACHE_WORDS) -> DataFrame:
    """docs: (doc_id, text). One row per piece, before packing. ``remembered``: words whose ids a task remembers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One encoder a task: a worker process that goes on to other work keeps no words.
        encoder, end = WordEncoder(tokenizer_path, remembered), int(end_id).to_bytes(4, "little")
        for batch in parts(batches):
            ids, at = batch.column(0).to_pylist(), 0
            for texts in batched([t or "" for t in batch.column(1).to_pylist()]):
                out: tuple[list, ...] = ([], [], [], [], [])
                for body in encoder.encode(texts):
                    body += end
                    total = len(body) // 4
                    for start in range(0, total, length):
                        piece = body[4 * start : 4 * (start + length)]
                        for column, value in zip(out, (ids[at], start, len(piece) // 4, zlib.crc32(piece), total)):
                            column.append(value)
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        del encoder
        tidy()

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS, seed: int = 17, remembered: int = CACHE_WORDS) -> DataFrame:
    """Pieces with sequence_id and offset. sequence_id: the group's number times 2^32 plus the bin's. Rows of
    one doc_id, or of none, are dealt to groups like any others, each by its place in the table."""
    groups = parts_for(docs.count(), group_docs)
    cut = pieces(docs, tokenizer_path, length, end_id, remembered)
    cut = cut.withColumn("_g", F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), F.monotonically_increasing_id()), F.lit(groups)))

    def fit(group: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        group = group.take(pc.sort_indices(group, sort_keys=order))
        bins, placed = FirstFit(group.num_rows, length), []
        full = 0
        for n in group["length"].to_pylist():
            if n == length:
                placed.append((full, 0))
                full += 1
            else:
                b, at = bins.add(n)
                placed.append((full + b, at))
        base = group["_g"][0].as_py() << 32
        group = group.append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64()))
        return group.append_column("offset", pa.array([at for _, at in placed], pa.int64())).drop_columns("_g")

    return cut.groupBy("_g").applyInArrow(fit, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
