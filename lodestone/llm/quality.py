"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and unlabelled web text train a linear scorer of how a text is written (shares of
character kinds and of pairs of kinds, word and line habits). The risk of the negative class is
estimated from the unlabelled texts less the positives' share (the class prior) and held at or above
zero; where a batch drives it below, the step goes back up instead, as the estimator prescribes.

The class prior is estimated from the trusted positives and the unlabelled texts alone: the mean score
of unlabelled texts over that of positives, by scorers trained in turn with the estimate before. Labels
of the negative class have no part in it, as labelled rows need not be drawn like the others. Fitted on
bounded samples: about ``POSITIVES`` trusted positives and ``UNLABELLED`` other texts, one to a doc_id,
drawn by a hash of the id. Each text is scored whole. Features are shares of byte classes and habits of
words and lines, no words: the scorer judges how a text is written, not what it says.

Defined results: null and empty texts have the features of no text and get that score; repeated rows
are scored each; without positives to learn from every score is 0.5; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, small_batches, table
from .langid import held_out
from .wordhash import tidy

POSITIVES, UNLABELLED = 3000, 3000
#: Texts scored at a time.
CHUNK = 256
STEPS, RATE, BATCH, DECAY = 800, 0.02, 512, 1e-3

#: Kinds of UTF-8 bytes: lower, upper, digit, space, line end, lead byte, later byte, then punctuation.
_MARKS = b".,;:!?|#*%$&@/\\-_=+<>()[]{}\"'`~^"
KINDS = 7 + len(_MARKS) + 1


def _kinds() -> np.ndarray:
    kind = np.full(256, 7 + len(_MARKS), dtype=np.int64)
    kind[97:123], kind[65:91], kind[48:58], kind[192:256], kind[128:192] = 0, 1, 2, 5, 6
    for b in b" \t\x0b\x0c\r":
        kind[b] = 3
    kind[10] = 4
    for i, b in enumerate(_MARKS):
        kind[b] = 7 + i
    return kind


_KIND = _kinds()
FEATURES = KINDS + KINDS * KINDS + 12


def features(text: str | None) -> np.ndarray:
    out = np.zeros(FEATURES, dtype=np.float32)
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return out
    kind = _KIND[np.frombuffer(raw, dtype=np.uint8)]
    n = len(kind)
    out[:KINDS] = np.sqrt(np.bincount(kind, minlength=KINDS) / n)
    if n > 1:
        out[KINDS : KINDS + KINDS * KINDS] = np.sqrt(np.bincount(kind[:-1] * KINDS + kind[1:], minlength=KINDS * KINDS) / (n - 1))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w, lengths = len(words), np.fromiter(map(len, words), dtype=np.float32, count=len(words))
    distinct, lines_n = len(set(words)), len(lines)
    pairs = len(set(zip(words, words[1:])))
    out[-12:] = (
        np.log1p(n) / 10,
        np.log1p(w) / 10,
        float(lengths.mean()) / 10 if w else 0,
        float(lengths.std()) / 10 if w else 0,
        distinct / w if w else 0,
        pairs / (w - 1) if w > 1 else 1,
        distinct / np.sqrt(w) / 10 if w else 0,
        len(set(lines)) / lines_n if lines_n else 1,
        np.log1p(w / max(1, lines_n)) / 10,
        min(1.0, float(lengths.max()) / 100) if w else 0,
        sum(a == b for a, b in zip(words, words[1:])) / (w - 1) if w > 1 else 0,
        1.0,
    )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Scorer:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return _sigmoid(z @ self.weights + self.bias)


def _standard(pos: np.ndarray, unl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the features of both samples, and their spread."""
    n = len(pos) + len(unl)
    mean = (pos.sum(axis=0, dtype=np.float64) + unl.sum(axis=0, dtype=np.float64)) / n
    squares = sum(np.einsum("ij,ij->j", x, x, dtype=np.float64) for x in (pos, unl)) / n
    return mean.astype(np.float32), (np.sqrt(np.maximum(0, squares - mean**2)) + 0.02).astype(np.float32)


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    out = np.subtract(x, mean, out=out, dtype=np.float32)
    return np.clip(np.divide(out, scale, out=out), -6, 6, out=out)


def _descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative PU risk with the logistic loss, by Adam on mini-batches."""
    rng, d = np.random.default_rng(seed), p.shape[1]
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    w[-1] = np.log(prior / (1 - prior))
    averaged = np.zeros(d + 1)
    for t in range(1, steps + 1):
        a, b = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        sa, sb = _sigmoid(a @ w[:-1] + w[-1]), _sigmoid(b @ w[:-1] + w[-1])
        mean_grad = lambda x, g: np.append(x.T @ g, g.sum()) / len(x)
        negative = -np.log1p(-np.clip(sb, 0, 1 - 1e-12)).mean() + prior * np.log1p(-np.clip(sa, 0, 1 - 1e-12)).mean()
        grad_negative = mean_grad(b, sb) - prior * mean_grad(a, sa)
        grad = prior * mean_grad(a, sa - 1) + grad_negative if negative >= 0 else -grad_negative
        grad[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t > steps // 2:
            averaged += w
    averaged /= steps - steps // 2
    return averaged[:-1], float(averaged[-1])


def _prior(p: np.ndarray, u: np.ndarray, rounds: int = 3) -> float:
    """Share of positives among unlabelled texts, of scaled features."""
    found = 0.5
    for _ in range(rounds):
        weights, bias = _descend(p, u, found, 200)
        high = max(1e-6, float(_sigmoid(p @ weights + bias).mean()))
        found = min(0.98, max(0.02, float(_sigmoid(u @ weights + bias).mean()) / high))
    return found


def train_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float | None = None, steps: int = STEPS, consume: bool = False) -> Scorer:
    """The scorer of least non-negative PU risk; ``prior``: of the positive class, estimated if None.
    consume: the samples may be overwritten."""
    mean, scale = _standard(pos, unl)
    p, u = (_scaled(x, mean, scale, x if consume else None) for x in (pos, unl))
    return Scorer(mean, scale, *_descend(p, u, _prior(p, u) if prior is None else prior, steps))


def estimated_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among unlabelled texts."""
    mean, scale = _standard(pos, unl)
    return _prior(_scaled(pos, mean, scale), _scaled(unl, mean, scale))


def _sampled(df: DataFrame, most: int, salt: str) -> DataFrame:
    """About ``most`` rows, by hash of the id."""
    share = min(1.0, most / max(1, df.count()))
    return df.filter(F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def _collect(df: DataFrame) -> np.ndarray:
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["doc_id", "f"])

    one = df.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = one.mapInArrow(vectors, "doc_id long, f binary").toArrow()
    out = np.empty((found.num_rows, FEATURES), dtype=np.float32)
    for row, f in zip(out, found.column("f")):
        row[:] = np.frombuffer(f.as_buffer(), dtype=np.float32)
    return out[np.argsort(found.column("doc_id").to_numpy(), kind="stable")]


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Scorer:
    """docs: (doc_id, text); labels: (doc_id, quality), learnable rows only."""
    ship(docs.sparkSession)
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("doc_id is not null and quality is not null")
    trusted = docs.join(_sampled(marks.filter("quality = 1"), positives, "trusted"), "doc_id", "left_semi")
    web = _sampled(docs.filter("doc_id is not null"), unlabelled, "web")
    pos, unl = _collect(trusted), _collect(web)
    if not len(pos) or not len(unl):
        return Scorer(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0)
    return train_nnpu(pos, unl, consume=True)


def predict(docs: DataFrame, model: Scorer, carry: list[str]) -> DataFrame:
    """docs (text, *carry) with score and predicted. Carried columns stay in Arrow as they came."""
    ship(docs.sparkSession)
    names = [*carry, "text"] if "text" not in carry else carry
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    at, kept = names.index("text"), len(carry)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                scores = model(np.stack([features(t.as_py()) for t in part.column(at)]))
                columns = [*part.columns[:kept], pa.array(scores, pa.float64()), pa.array(scores >= 0.5).cast(pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[*carry, "score", "predicted"])
        tidy()

    schema = ", ".join([*[f"`{c}` {fields[c]}" for c in carry], "score double", "predicted int"])
    return docs.select(*names).mapInArrow(score, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 3, 1))
    model = fit(docs.filter("not held_out"), labels.select("doc_id", "quality"))
    return predict(docs, model, ["doc_id", "held_out"])
