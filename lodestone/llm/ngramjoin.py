"""N-gram Jaccard self-join by rare-first prefixes.

1. Each text becomes its set of k-word shingles (64-bit hashes); texts of one sequence of words (128-bit
   digest) form one class, a node of the graph, of which one text goes on. Frequencies of all shingles of all
   documents are counted into a sketch of ``SKETCH`` counters, a fixed 2 MB; it is broadcast.
2. A set's shingles are ordered by (frequency, hash), one order for all sets, rare first. Sets linked at
   similarity t share a shingle of their first n - ceil(t n) + 1. These prefixes are joined by shingle;
   pairs are kept by length, by the matched positions, and by a suffix bound: the sets' histograms
   over 64 hash ranges may not differ by more than a linked pair's sets do. So far no text has moved.
3. Pairs left are verified on the words of whole texts, once per pair: shingles count as shared only if
   their words are equal, whatever their hashes.

Large groups of near copies would give all their pairs. So for shingles shared by more than
``SMALL`` sets, ``ROUNDS`` rounds first join each set with one leader of its shingle, the links are
closed into components, and pairs inside a component need no further check. What is then left, pairs
of different components under one shingle, is joined in full, so no link between components is missed.
Sets under one shingle, and the pairs of one leader, are dealt to tasks by ``SPLIT``.

Defined results: null, empty and blank texts have no shingles and stay alone; texts of fewer words
than k have one shingle, the whole; rows are judged each by its own text, also where doc_ids repeat; a
null doc_id links others like any row, but is never a component_id (null if no member has a doc_id);
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, materialize, remove, ship, small_batches, table
from .components import components
from .wordhash import Words, grams, parts, slices

GRAM, SHARE = 4, (85, 100)
SKETCH = 1 << 18
SMALL, ROUNDS = 16, 3
PARTS = 64
#: Rows of one shingle or leader that meet in a task.
SPLIT = 64
#: Nodes of classes without a doc_id of their own: from here on, by digest.
SURROGATE = 1 << 62


def shingle_sets(texts: list[str | None], k: int) -> list[tuple[np.ndarray, bytes]]:
    """Sorted distinct shingle hashes of each text, and a digest of its words."""
    out: list[tuple[np.ndarray, bytes]] = []
    for i, j in slices([len(t or "") for t in texts]):
        words = Words(texts[i:j], lower=True)
        hashes = words.hashes() if len(words.begin) else np.zeros(0, dtype=np.uint64)
        runs, begin = grams(hashes, k), 0
        for n in words.sizes.tolist():
            data = b""
            if n >= k:
                found = np.unique(runs[begin : begin + n - k + 1])
            else:
                found = grams(hashes[begin : begin + n], n) if n else hashes[:0]
            if n:
                data = words.data[words.begin[begin] : words.end[begin + n - 1]]
            out.append((found, hashlib.blake2b(data, digest_size=16).digest()))
            begin += n
    return out


def _halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)]


def _scan(k: int):
    """kind 0: (doc_id, mark, n, h1, h2) of a document; kind 1: (chunk, counts) of this task's sketch."""
    chunk, names = SKETCH // 64, ["kind", "doc_id", "mark", "n", "h1", "h2", "counts"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, some = np.zeros(SKETCH, dtype=np.uint32), False
        for batch in parts(batches):
            n, digests = [], []
            for s, digest in shingle_sets(batch.column(2).to_pylist(), k):
                n.append(len(s))
                digests.append(digest)
                np.add.at(sketch, (s >> np.uint64(46)).astype(np.int64), 1)
                some = True
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([0] * size, pa.int32()), batch.column(0), batch.column(1), pa.array(n, pa.int64()), *_halves(digests), pa.nulls(size, pa.binary())], names=names)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([1] * 64, pa.int32()), pa.array(range(64), pa.int64()), *[pa.array([0] * 64, pa.int64())] * 4, pa.array([sketch[i * chunk : (i + 1) * chunk].tobytes() for i in range(64)], pa.binary())], names=names)

    return rows


def _add_up(table_: pa.Table) -> pa.Table:
    width = 8 if table_.num_rows and len(table_.column("counts")[0].as_py()) > SKETCH // 64 * 4 else 4
    total = sum(np.frombuffer(x.as_py(), dtype=np.uint64 if width == 8 else np.uint32).astype(np.uint64) for x in table_.column("counts"))
    return pa.table({"chunk": table_.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _order(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Rare first: by counter, then by hash."""
    return s[np.lexsort((s, sketch[(s >> np.uint64(46)).astype(np.int64)]))]


def prefix_length(n: int, share: tuple[int, int]) -> int:
    return n - -(-share[0] * n // share[1]) + 1


def _prefixes(k: int, share: tuple[int, int], shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.frombuffer(shared.value, dtype=np.uint64)
        for batch in parts(batches):
            n, digests, firsts, ranges, common = [], [], [], [], []
            for s, digest in shingle_sets(batch.column(2).to_pylist(), k):
                n.append(len(s))
                digests.append(digest)
                firsts.append(_order(s, sketch)[: prefix_length(len(s), share)].view(np.int64) if len(s) else [])
                ranges.append(np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=PARTS), 32767).astype(np.int16))
                common.append(float(np.log1p(sketch[(s >> np.uint64(46)).astype(np.int64)]).mean()) if len(s) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *_halves(digests), pa.array(firsts, pa.list_(pa.int64())), pa.array(ranges, pa.list_(pa.int16())), pa.array(common, pa.float64())], names=["key", "mark", "n", "h1", "h2", "prefix", "ranges", "common"])

    return rows


class Verifier:
    """Counts the shingles that texts share with one text, by their words."""

    def __init__(self, text: str | None, k: int):
        self.k, self.words = k, Words([text], lower=True).data.split()
        self.known: dict[bytes, int] = {}
        ids = np.array([self.known.setdefault(w, len(self.known)) for w in self.words], dtype=np.int64)
        self.packs = len(self.known) ** k < 1 << 63
        self.mine = self._packed(ids) if self.packs else set(zip(*(self.words[i:] for i in range(k))))

    def _packed(self, ids: np.ndarray) -> np.ndarray:
        """Distinct shingles of known words as numbers in base len(known)."""
        n = len(ids) - self.k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        code, sure = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for i in range(self.k):
            code = code * len(self.known) + ids[i : i + n]
            sure &= ids[i : i + n] >= 0
        return np.unique(code[sure])

    def shared(self, text: str | None) -> int:
        words = Words([text], lower=True).data.split()
        if not self.packs:
            return len(self.mine & set(zip(*(words[i:] for i in range(self.k)))))
        get = self.known.get
        theirs = self._packed(np.array([get(w, -1) for w in words], dtype=np.int64))
        return len(np.intersect1d(self.mine, theirs, assume_unique=True))


def _verify(k: int, share: tuple[int, int]):
    """(a, b, na, nb, text_a, text_b) -> pairs that link."""
    num, den = share

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of = None, None
        for batch in parts(batches, 64):
            a, b, na, nb, ta, tb = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                if of is None or a[i] != last:
                    last, of = a[i], Verifier(ta[i], k)
                same = of.shared(tb[i])
                if den * same >= num * (na[i] + nb[i] - same):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return rows


def _suffix_fits(share: tuple[int, int]) -> Column:
    """Suffix filter of a row (na, ra, nb, rb): how far the histograms of linked sets may differ."""
    num, den = share
    total = F.col("na") + F.col("nb")
    apart = F.aggregate(F.zip_with("ra", "rb", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda t, x: t + x)
    return apart <= total - 2 * F.ceil(F.lit(num) * total / F.lit(num + den))


def _fits(share: tuple[int, int]) -> Column:
    """Length and positional filters of a row (na, pa, nb, pb)."""
    num, den = share
    need = F.ceil((F.lit(num) * (F.col("na") + F.col("nb"))) / F.lit(num + den))
    room = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    return (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (room >= need)


def _salted(n: Column) -> Column:
    """In how many parts n rows are dealt out."""
    return F.ceil(n / F.lit(SPLIT)).cast("int")


def jaccard_components(docs: DataFrame, k: int = GRAM, share: tuple[int, int] = SHARE) -> DataFrame:
    """docs: (doc_id, text). (doc_id, n_shingles, component_id, class_id, mark, group) of each row: class_id
    is the smallest doc_id with the same words, mark the hash of the text by which the row can be found,
    group one number for each component with words."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    big: list[str] = []
    step: list[str] = []
    used: list[str] = []
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    scanned = materialize(docs.mapInArrow(_scan(k), "kind int, doc_id long, mark long, n long, h1 long, h2 long, counts binary"), "shingle-scan")
    sets = scanned.filter("kind = 0").select("doc_id", "mark", "n", "h1", "h2")
    partial = scanned.filter("kind = 1").select(F.col("doc_id").alias("chunk"), F.pmod(F.monotonically_increasing_id(), F.lit(32)).alias("part"), "counts")
    partial = partial.groupBy("chunk", "part").applyInArrow(_add_up, "chunk long, counts binary")
    summed = {r[0]: bytes(r[1]) for r in partial.groupBy("chunk").applyInArrow(_add_up, "chunk long, counts binary").collect()}
    empty = bytes(SKETCH // 64 * 8)
    shared = spark.sparkContext.broadcast(b"".join(summed.get(i, empty) for i in range(64)))  # fixed size: 8 * SKETCH bytes

    found = materialize(sets.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id")), "shingle-found", used)
    shared_ids = found.filter("class_id is not null").groupBy("class_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    classes = found.join(shared_ids, "class_id", "left").withColumn("id", F.when(F.col("k").isNull() & F.col("class_id").isNotNull(), F.col("class_id")).otherwise(F.lit(SURROGATE).bitwiseOR(F.col("h1").bitwiseAND(F.lit(SURROGATE - 1)))))
    classes = materialize(classes.select("h1", "h2", "class_id", "id"), "shingle-classes")

    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    keyed = docs.select(key.alias("key"), "mark", "text")
    prefixes = keyed.mapInArrow(_prefixes(k, share, shared), "key long, mark long, n long, h1 long, h2 long, prefix array<long>, ranges array<short>, common double")
    heads = prefixes.join(classes.select("h1", "h2", F.coalesce("class_id", F.lit(-(1 << 63))).alias("key"), "id"), ["h1", "h2", "key"]).dropDuplicates(["h1", "h2", "key"])
    heads = materialize(heads.select("id", "key", "mark", "n", "prefix", "ranges", "common"), "shingle-heads", big)
    tokens = heads.select("id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("p", "token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("c")).filter("c > 1")
    rows = materialize(tokens.join(counts, "token").select("token", "id", "n", "p", "c"), "shingle-rows", used)
    # Of a large group, the set of the commonest shingles is the first leader.
    large = rows.filter(F.col("c") > SMALL)
    groups = large.join(heads.select("id", "common"), "id").groupBy("token").agg(F.max(F.struct("common", -F.col("id"))).alias("lead"))
    groups = materialize(groups.select("token", (-F.col("lead.col2")).alias("id")), "shingle-groups", used)
    members = rows.select("id").distinct()
    slim = materialize(heads.join(members, "id", "left_semi").select("id", "key", "mark", "n", "ranges"), "shingle-members", used)
    # A text is found by its doc_id and hash; equal rows give it once.
    texts = keyed.join(slim.select("key", "mark", "id"), ["key", "mark"]).dropDuplicates(["key", "mark"]).select("id", "text")
    texts = bucketed(texts, "shingle-texts", ["id"], used)
    remove(spark, big)

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs (a, b, s): s parts that the pairs of a are dealt in."""
        of = lambda x: slim.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("ranges").alias(f"r{x}"))
        near = materialize(pairs.join(of("a"), "a").join(of("b"), "b").filter(_suffix_fits(share)).select("a", "b", "s", "na", "nb"), "shingle-near", step)
        leads = near.groupBy("a").agg(F.max("s").alias("s")).withColumnRenamed("a", "id")
        text_a = texts.join(leads, "id").select(F.col("id").alias("a"), F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("part"))
        text_b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        both = near.withColumn("part", F.pmod(F.xxhash64("b"), F.col("s")).cast("int")).join(text_b, "b").join(text_a, ["a", "part"])
        return both.select("a", "b", "na", "nb", "text_a", "text_b").mapInArrow(_verify(k, share), "a long, b long")

    tried: DataFrame | None = None
    links: DataFrame | None = None
    labels = members.withColumn("component", F.col("id"))
    order = [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]

    def settle(pairs: DataFrame) -> None:
        """pairs (a, b, s), one row each."""
        nonlocal tried, links, labels
        pairs = pairs.select("*", *order)
        if tried is not None:
            pairs = pairs.join(tried, ["lo", "hi"], "left_anti")
        pairs = materialize(pairs, "shingle-pairs", used)
        # Without pairs or links nothing changes, and the driver plans nothing more.
        if pairs.isEmpty():
            return remove(spark, step)
        new = materialize(verified(pairs.select("a", "b", "s")), "shingle-links", used)
        remove(spark, step)
        seen = pairs.select("lo", "hi")
        tried = seen if tried is None else tried.unionByName(seen)
        if new.isEmpty():
            return
        links = new if links is None else links.unionByName(new)
        linked = components(links)
        labels = materialize(members.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "shingle-labels")

    for turn in range(ROUNDS):
        now = large.join(labels, "id")
        open_ = now.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.struct(F.xxhash64(F.lit(turn), "token", "id"), "id", "n", "p", "component")).alias("lead")).filter("low != high")
        if turn == 0:
            best = large.join(groups.select("token", "id"), ["token", "id"]).join(labels, "id").select("token", F.struct(F.lit(0).alias("h"), "id", "n", "p", "component").alias("lead"))
            open_ = open_.drop("lead").join(best, "token")
        # Written first: the join then stands on plain exchanges, whose hot parts Spark splits.
        open_ = materialize(open_, "shingle-leads", step)
        if open_.isEmpty():  # every large group is one component, and stays so
            remove(spark, step)
            break
        pairs = now.join(open_.select("token", F.col("lead.id").alias("a"), F.col("lead.n").alias("nb"), F.col("lead.p").alias("pb"), F.col("lead.component").alias("other")), "token")
        pairs = pairs.filter("component != other").withColumnsRenamed({"n": "na", "p": "pa", "id": "b"}).filter(_fits(share))
        settle(pairs.groupBy("a", "b").agg(_salted(F.max("c")).alias("s")))

    now = rows.join(labels, "id")
    open_ = now.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("open")).filter("low != high")
    open_ = materialize(open_, "shingle-leads", step)
    now = now.join(open_.select("token", _salted(F.col("open")).alias("s")), "token")
    now = materialize(now.select("token", "s", "id", "n", "p", "component"), "shingle-open", used)
    # The rows of a shingle are dealt into s parts on the left, each of which meets all its rows on the right.
    left = now.select("token", "s", F.pmod(F.xxhash64("id"), F.col("s")).cast("int").alias("part"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("component").alias("ca"))
    right = now.select("token", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("part"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("component").alias("cb"))
    settle(left.join(right, ["token", "part"]).filter("a < b and ca != cb").filter(_fits(share)).groupBy("a", "b").agg(F.max("s").alias("s")))

    if links is None:
        labels = materialize(labels, "shingle-labels")
    remove(spark, used)
    named = classes.join(labels, "id", "left").select("h1", "h2", "class_id", F.coalesce("component", "id").alias("component"))
    least = materialize(named.groupBy("component").agg(F.min("class_id").alias("component_id")), "shingle-least")
    final = named.join(least, "component").select("h1", "h2", "class_id", "component_id", F.col("component").alias("group"))
    out = sets.join(final, ["h1", "h2"], "left")
    lone = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "mark", "group")


def op5_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard_components(table(spark, sf_dir, "documents")).drop("mark", "group")
