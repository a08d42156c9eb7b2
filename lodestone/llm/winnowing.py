"""Document fingerprints by winnowing, in DataFrame expressions only.

A text's words are hashed once each; the hash of a k-gram is the cyclic polynomial (rolling) hash of its
words' hashes, built by folding shifted copies of the whole sequence, so the work grows with the text and
not with k. Of each 64-bit gram hash 40 bits are kept beside the gram's position. Of every window of ``w``
successive hashes the smallest is chosen, ties to the rightmost, by folding shifted copies too, and
a choice shared by windows is kept once. Two texts that share ``w + k - 1`` successive words share a
fingerprint; positions tell where. A word of more than ``LONG`` characters, or with a character of a script
that is written without blanks, counts as so many words of one character.

Every text is winnowed over its words, whatever its length. Short texts have few of them: those of up to
``SHORT`` characters are winnowed over their characters as well (items are runs of ``RUN`` characters, and
their positions are marked ``c``).

Defined results: a text shorter than k items is one gram, one with fewer than w grams one window; null,
empty and blank texts have no fingerprint, and two such texts are alike (1.0), one such text is unlike
any other (0.0). Positions count modulo 2^23. A null doc_id comes before all others; rows of one doc_id
follow each other by the CRC of their text. A single document is followed by itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table

GRAM, WINDOW = 2, 3
LONG = 48
#: Thai and Lao, Burmese, Khmer, kana, Han.
BLANKLESS = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]"
#: Characters of a short text, and of one of its items.
SHORT, RUN = 192, 3
#: Bits below a hash: the position counted down, so that the rightmost of equal hashes is the smallest,
#: above it whether items are characters.
POSITION_BITS = 24
PLACES = 1 << (POSITION_BITS - 1)
_MASK = (1 << POSITION_BITS) - 1
#: doc_ids are dealt in runs of 2^9 successive values, so no task holds more than 512 different ones.
RUN_BITS = 9


def tokens(text: Column) -> Column:
    """Words of a text, those that are runs of characters cut into characters."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    solid = lambda x: (F.length(x) > LONG) | ((F.octet_length(x) > F.length(x)) & x.rlike(BLANKLESS))
    one = lambda x: F.when(solid(x), F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))).otherwise(F.array(x))
    return let(words, lambda ws: F.when(F.exists(ws, solid), F.flatten(F.transform(ws, one))).otherwise(ws))


def _rotated(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n)) if n % 64 else x


def _shifted(xs: Column, by: int, fold: Callable[[Column, Column], Column]) -> Column:
    """fold(x[i], x[i + by]) for all i that have both."""
    n = F.size(xs) - by
    return F.zip_with(F.slice(xs, 1, n), F.slice(xs, by + 1, n), fold)


def rolling(hashes: Column, k: int) -> Column:
    """Cyclic polynomial hashes of the k-grams of at least k items: rot(h[i], k - 1) ^ ... ^ h[i + k - 1]."""

    def doubled(xs: Column, n: int) -> Column:
        return let(xs, lambda x: _shifted(x, n, lambda a, b: _rotated(a, n % 64).bitwiseXOR(b)))

    have, out = 1, hashes
    while have * 2 <= k:
        out = doubled(out, have)
        have *= 2
    if k == have:
        return out
    # The first ``have`` items and the last of a gram's others.
    left, rest = out, rolling(hashes, k - have)
    both = F.struct(left.alias("l"), rest.alias("r"))
    grams = lambda s: F.zip_with(F.slice(s["l"], 1, F.size(s["r"]) - have), F.slice(s["r"], have + 1, F.size(s["r"]) - have), lambda a, b: _rotated(a, (k - have) % 64).bitwiseXOR(b))
    return let(both, grams)


def smallest(hashes: Column, w: int) -> Column:
    """Minimum of every window of w of at least w hashes."""

    def least(xs: Column, n: int) -> Column:
        return let(xs, lambda x: _shifted(x, n, lambda a, b: F.least(a, b)))

    have, out = 1, hashes
    while have * 2 <= w:
        out = least(out, have)
        have *= 2
    return out if have == w else least(out, w - have)


def _chosen(items: Column, k: int, w: int, mark: int) -> Column:
    """array<long> of the chosen hashes of a sequence of strings."""

    def packed(grams: Column) -> Column:
        return F.transform(grams, lambda h, i: h.bitwiseAND(F.lit(~_MASK)).bitwiseOR(F.lit(mark * PLACES + PLACES - 1) - (i % PLACES).cast("long")))

    def grams(hs: Column) -> Column:
        # Fewer than k items: one gram of them all.
        return F.when(F.size(hs) == 0, hs).when(F.size(hs) < k, F.array(F.xxhash64(hs))).otherwise(rolling(hs, k))

    def least(hs: Column) -> Column:
        return F.array_distinct(F.when(F.size(hs) == 0, hs).when(F.size(hs) < w, F.array(F.array_min(hs))).otherwise(smallest(hs, w)))

    return let(let(let(F.transform(items, lambda x: F.xxhash64(x)), grams), packed), least)


def winnow(text: Column, k: int = GRAM, w: int = WINDOW) -> Column:
    """array<long> of chosen hashes, each with its position in the low bits; characters' first."""
    runs = F.when(F.length(text) >= 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - RUN + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(RUN))))

    def both(ws: Column) -> Column:
        n, none = F.length(text), F.array().cast("array<long>")
        words = _chosen(ws, k, w, 0)
        return F.when((n <= SHORT) & (F.size(ws) > 0), F.concat(_chosen(runs, k, w, 1), words)).otherwise(F.coalesce(words, none))

    return let(tokens(text), both)


def as_text(prints: Column) -> Column:
    """hash:position, separated by blanks, in order of position; positions of characters have a ``c``."""
    low = lambda v: v.bitwiseAND(F.lit(_MASK))
    one = lambda v: F.concat(F.hex(F.shiftrightunsigned(v, POSITION_BITS)), F.when(low(v) >= PLACES, ":c").otherwise(":"), (F.lit(PLACES - 1) - low(v) % PLACES).cast("string"))
    return F.array_join(F.transform(prints, one), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hashes, positions aside."""
    hashes = lambda x: F.array_distinct(F.transform(x, lambda v: F.shiftright(v, POSITION_BITS)))

    def jaccard(s: Column) -> Column:
        both = F.size(F.array_intersect(s["a"], s["b"]))
        union = F.size(s["a"]) + F.size(s["b"]) - both
        return F.when(union == 0, 1.0).otherwise(both / union)

    return let(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), jaccard)


def successor_runs(runs: DataFrame, levels: int) -> DataFrame:
    """(run, next) for distinct run numbers; next is null for the last."""
    if levels <= 0:
        return runs.select("run", F.lead("run").over(Window.partitionBy(F.lit(0)).orderBy("run")).alias("next"))
    up = runs.withColumn("up", F.shiftright("run", RUN_BITS))
    inside = up.withColumn("next", F.lead("run").over(Window.partitionBy("up").orderBy("run")))
    firsts = up.groupBy("up").agg(F.min("run").alias("first"))
    above = successor_runs(firsts.select(F.col("up").alias("run")), levels - 1)
    into = above.join(firsts.select(F.col("up").alias("next"), "first"), "next").select(F.col("run").alias("up"), "first")
    return inside.join(into, "up", "left").select("run", F.coalesce("next", "first").alias("next"))


def with_next(docs: DataFrame, carry: list[str]) -> DataFrame:
    """docs (doc_id, text, ...) with next_<c> of the document next in doc_id, the last one's being the
    first. Ids are dealt in bounded runs; only a run's last document looks into another run."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    low, high = docs.agg(F.min(key), F.max(key)).first()
    if low is None:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in carry])
    levels = next(n for n in range(9) if (low >> RUN_BITS * (n + 1)) == (high >> RUN_BITS * (n + 1)) or n == 8)
    order = Window.partitionBy("_run").orderBy("_key", "_crc")
    rows = docs.withColumn("_key", key).withColumn("_run", F.shiftright("_key", RUN_BITS)).withColumn("_crc", F.crc32(F.coalesce("text", F.lit("")))).repartition("_run")
    placed = rows.withColumn("_at", F.row_number().over(order)).withColumn("_last", F.lead("_at").over(order).isNull())
    placed = reduce(lambda d, c: d.withColumn(f"next_{c}", F.lead(c).over(order)), carry, placed)
    own = docs.columns + [f"next_{c}" for c in carry]
    # Asking for doc_id too makes all three uses of ``rows`` read the same columns, so one exchange serves them.
    firsts = rows.withColumn("_at", F.row_number().over(order)).filter((F.col("_at") == 1) & (key >= low)).select(F.col("_run").alias("_to"), *[F.col(c).alias(f"first_{c}") for c in carry])
    runs = docs.select(F.shiftright(key, RUN_BITS).alias("run")).distinct()
    follow = successor_runs(runs, levels).select(F.col("run").alias("_run"), F.coalesce("next", F.lit(low >> RUN_BITS)).alias("_to"))
    ends = placed.filter("_last").drop(*[f"next_{c}" for c in carry]).join(follow, "_run").join(firsts, "_to")
    ends = ends.select(*docs.columns, *[F.col(f"first_{c}").alias(f"next_{c}") for c in carry])
    return placed.filter("not _last").select(*own).unionByName(ends.select(*own))


def fingerprint_pairs(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """docs (doc_id, text): fingerprints of each text, of its edited text, and their likenesses."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("prints", winnow(F.col("text"), k, w)), ["text", "prints"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("_e", let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), winnow(e, k, w).alias("prints"))))
    return rows.select("doc_id", n.cast("long").alias("n_chars"), F.col("_e.sha").alias("edited_sha256"), "prints", F.col("_e.prints").alias("edited_prints"), "next_prints")


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_pairs(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("prints")).alias("fingerprint"), as_text(F.col("edited_prints")).alias("edited_fingerprint"), likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"), likeness(F.col("prints"), F.col("next_prints")).alias("near_next"))
