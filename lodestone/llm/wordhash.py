"""64-bit hashes of words and of runs of words, on whole batches of documents.

A word's hash takes its bytes eight at a time through a one-to-one scrambling, so words of up to eight
bytes and one length never collide and no word has a structure (such as two words of the same letters in
mirrored order) that others cancel out; longer words collide by chance only, at 2^-64 a pair. Operators
that must not err even then compare words or 128-bit digests of them.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A longer word is hashed by itself.
LONG = 64
_STEP = 0x9E3779B97F4A7C15
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_HEADS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw_text(text: str | None, lower: bool = False) -> bytes:
    """UTF-8 bytes; ``lower``: A-Z become a-z."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.lower() if lower else raw


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D)."""
    return raw_text(text).split()


class Words:
    """Words of several texts in a row. ``data``: their bytes with one space between words; ``begin``,
    ``end``: where each word lies there; ``sizes``: the number of words of each text."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        joined = [b" ".join(raw_text(t, lower).split()) for t in texts]
        self.sizes = np.array([x.count(b" ") + 1 if x else 0 for x in joined], dtype=np.int64)
        self.data = b" ".join([x for x in joined if x])
        n = len(self.data)
        gaps = np.flatnonzero(np.frombuffer(self.data, dtype=np.uint8) == 32) if n else np.zeros(0, dtype=np.int64)
        self.begin = np.concatenate([[0], gaps + 1]) if n else gaps
        self.end = np.append(gaps, n) if n else gaps

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word."""
        padded = np.frombuffer(self.data + bytes(8), dtype=np.uint8)
        eight = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
        size = self.end - self.begin
        out = mix((eight[self.begin] & _HEADS[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(_STEP))
        at = 8
        more = np.flatnonzero((size > 8) & (size <= LONG))
        while len(more):
            left = size[more] - at
            out[more] = mix(out[more] * _FOLD ^ (eight[self.begin[more] + at] & _HEADS[np.minimum(left, 8)]))
            at += 8
            more = more[left > 8]
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.begin[i] : self.end[i]], digest_size=8).digest(), "little")
        return out

    def digests(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """128-bit digests, as rows of two longs, of the words ``first`` to ``last`` (included) of each run."""
        data, blake = self.data, hashlib.blake2b
        found = [blake(data[a:b], digest_size=16).digest() for a, b in zip(self.begin[first].tolist(), self.end[last].tolist())]
        return np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k successive items: halves are hashed and folded, never added."""
    if k == 1:
        return hashes
    half = 1 << ((k - 1).bit_length() - 1)
    parts_ = {1: hashes}
    size = 1
    while size < half:
        x = parts_[size]
        parts_[size * 2] = mix(x[:-size] * _FOLD + x[size:]) if len(x) > size else x[:0]
        size *= 2
    left, rest = parts_[half], k - half
    n = max(0, len(hashes) - k + 1)
    return mix((left[:n] * _FOLD + grams(hashes, rest)[half : half + n]) ^ np.uint64(k))


def text_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of several texts in a row, and the number of words of each text."""
    words = Words(texts, lower)
    return words.hashes() if len(words.begin) else np.zeros(0, dtype=np.uint64), words.sizes


def tidy() -> None:
    """Give a worker process's free memory back to the system, as Spark keeps the process for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut to a few hundred rows, so that a task's Python objects stay few."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    tidy()


def slices(sizes: list[int], most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Runs of items whose sizes sum to ``most`` at most (or one larger item)."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
