"""Target-distribution importance resampling over hashed n-grams.

A text's features are its runs of ``sizes`` consecutive words, hashed into buckets. A bucket's gain is the
log ratio of its smoothed share in a target corpus to that in the raw one; a document's weight is the mean
gain of its features, and a Gumbel draw on top of it samples documents by weight without replacement.

Overlap chunking: a text longer than ``CHUNK_BYTES`` is split at word boundaries; every chunk owns the
features that start in it and carries the next n - 1 words, so no feature is lost or counted twice, and
the chunks of one text go to different tasks. Counts and gains are summed by document.

Defined results: a null or wordless text has no features and weight 0; rows equal in key and text are
documents each, and weigh alike; a null key draws as the empty string and comes last in ties; an empty
table gives no rows; an empty target counts as one of no features; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, ship, small_batches, table
from .wordhash import parts

BUCKETS = 10_000
CHUNK_BYTES = 1 << 16
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20

#: Digits, letters and all bytes beyond ASCII make words; A-Z count as a-z.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_PIECES = "h1 long, h2 long, first boolean, piece binary, owned long"
_FEATURES = "h1 long, h2 long, first boolean, words long, n long, buckets binary"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORDS).split()


def cut(raw: bytes, carry: int, most: int = CHUNK_BYTES) -> Iterator[tuple[bytes, int]]:
    """(piece, owned): pieces of a text in order. A piece ends at the first word boundary from ``most``
    bytes on; the ``carry`` words after its ``owned`` ones belong to the next pieces."""
    folded = raw.translate(_WORDS)
    edges = []
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + most) if at + most < len(folded) else -1
        edges.append((at, end if end >= 0 else len(folded)))
        at = edges[-1][1]
    words = [folded[a:b].split() for a, b in edges]
    after: list[bytes] = []
    out = []
    for own in reversed(words):
        out.append((b" ".join([*own, *after]), len(own)))
        after = [*own[:carry], *after][:carry]
    yield from reversed(out)


def bucket_ids(words: list[bytes], owned: int, sizes: tuple[int, int], buckets: int) -> np.ndarray:
    """Buckets of the features that start at the first ``owned`` words."""
    found = []
    for n in range(sizes[0], sizes[1] + 1):
        runs = words[:owned] if n == 1 else [b" ".join(words[i : i + n]) for i in range(min(owned, len(words) - n + 1))]
        found.append(np.fromiter(map(zlib.crc32, runs), dtype=np.uint32, count=len(runs)))
    return np.concatenate(found) % np.uint32(buckets)


def features(df: DataFrame, key: str, text: str, sizes: tuple[int, int] = (1, 1), buckets: int = BUCKETS, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(key, h1, h2, first, words, n, buckets): one row a chunk. h1 and h2 name the text, ``first`` marks
    its first chunk, ``words`` are those owned, ``buckets`` the n features' as unsigned 16- or 32-bit numbers."""
    ship(df.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in df.schema}[key]
    width = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.xxhash64(body).alias("h1"), F.hash(body).cast("long").alias("h2"), body.alias("text"))
    few, carry = rows.filter(F.octet_length("text") <= chunk), sizes[1] - 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 16):
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                out = list(cut(row.column("text")[0].as_py().encode("utf-8", "surrogatepass"), carry, chunk))
                for j in range(0, len(out), 64):
                    some = out[j : j + 64]
                    pick = pa.array([0] * len(some))
                    yield pa.RecordBatch.from_arrays([*(row.column(c).take(pick) for c in ("key", "h1", "h2")), pa.array([j + x == 0 for x in range(len(some))]), pa.array([p for p, _ in some], pa.binary()), pa.array([o for _, o in some], pa.int64())], ["key", "h1", "h2", "first", "piece", "owned"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            whole = "text" in batch.schema.names
            owned = None if whole else batch.column("owned").to_pylist()
            words, n, held = [], [], []
            for i, raw in enumerate(batch.column("text" if whole else "piece").to_pylist()):
                listed = words_of(raw.encode("utf-8", "surrogatepass") if whole else raw)
                mine = len(listed) if whole else owned[i]
                ids = bucket_ids(listed, mine, sizes, buckets)
                words.append(mine)
                n.append(len(ids))
                held.append(ids.astype(width).tobytes())
            first = pa.array([True] * batch.num_rows) if whole else batch.column("first")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "h1", "h2")), first, pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(held, pa.binary())], ["key", "h1", "h2", "first", "words", "n", "buckets"])

    long_ones = rows.filter(F.octet_length("text") > chunk).mapInArrow(split, f"key {kind}, {_PIECES}")
    dealt = long_ones.repartition(F.xxhash64("piece"))
    return few.mapInArrow(hashed, f"key {kind}, {_FEATURES}").unionByName(dealt.mapInArrow(hashed, f"key {kind}, {_FEATURES}"))


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of features; each task adds up its own before anything is shuffled."""
    width = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for held in batch.column("buckets").to_pylist():
                total += np.bincount(np.frombuffer(held, dtype=width), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return found.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln) of its smoothed share in the target against the raw one."""
    spark = raw.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = F.coalesce("s", F.lit(0)).cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    total = lambda df, name: df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(name))
    rows = both.join(F.broadcast(total(raw, "all_s"))).join(F.broadcast(total(target, "all_t")))  # one row each
    ratio = ((t + 1) * (F.col("all_s") + buckets)) / ((s + 1) * (F.col("all_t") + buckets))
    return rows.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weigh(found: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(key, words, n_features, weight, copies): one row a distinct (key, text). ``gain`` has one row a bucket;
    as many numbers go to the tasks, whatever the corpus."""
    width = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")
    listed = np.zeros(buckets, dtype=np.int64)
    for r in gain.collect():
        listed[r.bucket] = r.gain
    kind = {f.name: f.dataType.simpleString() for f in found.schema}["key"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(listed[np.frombuffer(held, dtype=width)].sum()) for held in batch.column("buckets").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "h1", "h2", "first", "words", "n")), pa.array(sums, pa.int64())], ["key", "h1", "h2", "first", "words", "n", "gain"])

    parts_ = found.mapInArrow(add, f"key {kind}, h1 long, h2 long, first boolean, words long, n long, gain long")
    whole = parts_.groupBy("key", "h1", "h2").agg(F.count_if("first").alias("copies"), F.sum("words").alias("words"), F.sum("n").alias("n"), F.sum("gain").alias("gain"))
    # Equal rows have equal chunks: what one row has is an exact part of the sum. The mean is floored.
    mean = F.when(F.col("n") > 0, F.expr("(gain - pmod(gain, n)) div n")).otherwise(F.lit(0))
    return whole.select("key", F.expr("words div copies").alias("words"), F.expr("n div copies").alias("n_features"), mean.cast("long").alias("weight"), "copies")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """floor(1000 x a Gumbel variate) of a record's key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(key, n_features, weight, score, rank): of the documents with ``least_words`` words, the
    floor(percent / 100) of them with the highest scores are ranked 1, 2, 3, ...; others have null.

    Scores are whole numbers of a narrow range: their histogram gives the score down to which all are
    drawn and how many come before each score, so only rows of one score are ever ordered together."""
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)), "scores")
    fit = F.col("words") >= least_words
    by_score = scored.filter(fit).groupBy("score").agg(F.sum("copies").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = by_score.withColumn("before", before)
    wanted = (scored.filter(fit).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] * percent) // 100
    places = places.filter(F.col("before") < wanted).select("score", "before")
    order = Window.partitionBy("score").orderBy(F.col("key").asc_nulls_last(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    kept = ["key", "n_features", "weight", "score"]
    same = scored.filter(fit).groupBy(*kept).agg(F.sum("copies").alias("copies")).join(places, "score")
    first = F.col("before") + F.coalesce(F.sum("copies").over(order), F.lit(0)) + 1
    rank = F.col("_rank").cast("long")
    ranked = same.withColumn("_first", first).select(*kept, F.explode(F.sequence("_first", F.col("_first") + F.col("copies") - 1)).alias("_rank"))
    ranked = ranked.select(*kept, F.when(rank <= wanted, rank).alias("rank"))
    rest = scored.filter(~fit).unionByName(scored.filter(fit).join(places, "score", "left_anti"), allowMissingColumns=True)
    rest = rest.select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_rank")).select(*kept, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)


def resample(raw: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", sizes: tuple[int, int] = (1, 1), buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of ``raw``, weighed towards the target's texts."""
    found = materialize(features(raw, key, text, sizes, buckets, chunk), "features")
    aim = features(target.withColumn("_key", F.lit(0)), "_key", target_text, sizes, buckets, chunk)
    gain = gains(bucket_counts(found, buckets), bucket_counts(aim, buckets), buckets)
    return draw(weigh(found, gain, buckets), percent, least_words, seed)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, aim = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return resample(docs, aim).select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


#: CRC-32 of words: 256 table entries from the polynomial, then one step a byte.
OP11_SQL = r"""WITH steps AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8)::BIGINT[], lambda x, k:
    CASE WHEN x & 1 = 1 THEN xor(3988292384::BIGINT, x >> 1) ELSE x >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT row, w, count(*) AS n FROM (SELECT row, unnest(ws) AS w FROM d) GROUP BY ALL),
v AS (SELECT w, xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM b), steps),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN v USING (w) GROUP BY ALL), t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (w) GROUP BY ALL),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (SELECT coalesce(sum(s), 0) + 10000 FROM s)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (SELECT coalesce(sum(t), 0) + 10000 FROM t)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT row, floor(sum(n * gain) / sum(n)::DOUBLE)::BIGINT AS weight FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY row),
x AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT
  + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (row)),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS place FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= floor(10 * (SELECT count(*) FROM x WHERE n_features >= 20) / 100) THEN place END::BIGINT AS rank FROM r"""
