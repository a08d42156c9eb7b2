"""Dictionary entities, rule and cluster classification, topic validation and model comparison."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_signal
from ..session import ship
from ..sources.scratch import drop_at_exit, folder

#: Order of rules, order of labels, weights and thresholds.
RULE_ORDER = ["ERROR", "ADMIN", "LANGUAGE", "TOOL", "CONCEPT"]
MAJORITY = 0.8
WEIGHTS = {"outlier_ratio": 0.35, "keyword_overlap": 0.25, "confidence_mean": 0.25, "cross_course_topics": 0.15}
LIMITS = {"outlier_ratio": 0.15, "keyword_overlap": 0.1, "confidence_mean": 0.7, "cross_course_topics": 10}
GENERIC = ["error", "homework", "course", "model", "project", "issue"]

#: Most dictionary terms sent to every task; more are joined by a shuffle.
SMALL_DICTIONARY = 100_000
#: Most topics whose vectors are sent to every task.
MOST_TOPICS = 10_000
#: Most terms that a note's documents are searched for row by row; for more, words are joined with them.
NOTE_TERMS = 1000


def entities(docs: DataFrame, text: str, patterns: dict[str, list[str]], small: int = SMALL_DICTIONARY) -> DataFrame:
    """(id, pos, term, label) of dictionary terms, by whole tokens; overlaps go to the longest, then the
    leftmost. Terms of any number of tokens match. Marks between words do not count, unless the term has
    marks itself ("c++", ".net", "k-means"): then they stand in the text as in the term, and where two terms
    have the same tokens, the longer one wins. A term without a token matches nothing, one under two labels
    takes the first. The dictionary is a parameter held by the driver: up to ``small`` terms go to every task as
    one automaton, which finds all of them in one pass over a text; of a larger one, every run of tokens that
    is as long as a term is joined with it."""
    spark = docs.sparkSession
    terms = {}
    for label, listed in patterns.items():
        for t in listed:
            tokens = re.findall(r"\w+", t.lower())
            if tokens:
                terms.setdefault(t.lower(), (" ".join(tokens), len(tokens), label))
    # lead: marks before the first token; body: the rest of a term with marks, null for one of plain words.
    marked = {t: re.match(r"\W*", t).end() for t, (key, _, _) in terms.items() if key != t}
    if terms and len(terms) <= small:
        return _scanned(docs, text, terms, marked)
    known = spark.createDataFrame([(key, t, label, t[:marked[t]] if t in marked else None, t[marked[t]:] if t in marked else None) for t, (key, _, label) in terms.items()], "key string, term string, label string, lead string, body string")
    rows = _tokens(docs, text)

    def spans(n: int) -> DataFrame:
        starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - n + 1, F.lit(1)))
        before = F.element_at("raw", F.col("_i")) if marked else F.lit(None).cast("string")
        here = F.array_join(F.slice("raw", F.col("_i") + 1, n), "") if marked else F.lit(None).cast("string")
        out = rows.filter(F.size("ws") >= n).select("id", "ws", "raw", F.explode(starts).alias("_i"))
        return out.select("id", (F.col("_i") - 1).alias("pos"), F.array_join(F.slice("ws", F.col("_i"), n), " ").alias("key"), before.alias("before"), here.alias("here"), F.lit(n).alias("n"))

    lengths = sorted({n for _, n, _ in terms.values()}) or [1]
    found = reduce(DataFrame.unionByName, [spans(n) for n in lengths]).join(known, "key")
    found = found.filter("body IS NULL OR (startswith(here, body) AND endswith(before, lead))")
    # Greedy by (length, place): a span loses if a longer one, or an equally long one to its left, overlaps it.
    per = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "pos", (-F.length("term")).alias("chars"), "term", "label"))).alias("all"))
    clash = lambda a, b: (a["pos"] < b["pos"] - b["neg"]) & (b["pos"] < a["pos"] - a["neg"])
    empty = F.expr("CAST(array() AS array<struct<neg:int,pos:int,chars:int,term:string,label:string>>)")
    kept = F.aggregate("all", empty, lambda acc, x: F.when(F.exists(acc, lambda a: clash(a, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return per.select("id", F.explode(kept).alias("e")).select("id", F.col("e.pos").alias("pos"), F.col("e.term").alias("term"), F.col("e.label").alias("label"))


def _tokens(docs: DataFrame, text: str) -> DataFrame:
    """(id, ws, raw): a text's tokens, and what stands before the first and each token with the marks after it."""
    low, word, mark = F.lower(text), r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    return docs.select("id", F.regexp_extract_all(low, F.lit(f"{word}+"), F.lit(0)).alias("ws"), F.concat(F.array(F.regexp_extract(low, f"^{mark}*", 0)), F.regexp_extract_all(low, F.lit(f"{word}+{mark}*"), F.lit(0))).alias("raw"))


def _scanned(docs: DataFrame, text: str, terms: dict[str, tuple[str, int, str]], marked: dict[str, int]) -> DataFrame:
    """The entities of a dictionary that fits an automaton over tokens between blanks. terms: term -> (tokens
    joined by blanks, their number, label); marked: terms with marks -> length of those before the first token."""
    ship(docs.sparkSession)
    by_key: dict[str, list[tuple[int, str, str, int | None]]] = {}
    for term, (key, n, label) in terms.items():
        by_key.setdefault(f" {key} ", []).append((n, term, label, marked.get(term)))
    rows = _tokens(docs, text) if marked else _tokens(docs, text).withColumn("raw", F.lit(None).cast("array<string>"))
    kind = dict(docs.dtypes)["id"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for key, held in by_key.items():
            machine.add_word(key, (len(key), held))
        machine.make_automaton()
        for batch in batches:
            at, pos, names, labels = [], [], [], []
            for i, (ws, raw) in enumerate(zip(batch.column("ws").to_pylist(), batch.column("raw").to_pylist())):
                found = []
                if ws:
                    starts = dict(zip(accumulate([1, *(len(w) + 1 for w in ws[:-1])]), range(len(ws))))
                    for end, (size, held) in machine.iter(" " + " ".join(ws) + " "):
                        p = starts[end - size + 2]
                        for n, term, label, lead in held:
                            if lead is None or "".join(raw[p + 1 : p + 1 + n]).startswith(term[lead:]) and raw[p].endswith(term[:lead]):
                                found.append((-n, p, -len(term), term, label))
                taken: list[tuple[int, int]] = []
                for neg, p, _, term, label in sorted(found):
                    if all(p >= b or p - neg <= a for a, b in taken):
                        taken.append((p, p - neg))
                        at.append(i)
                        pos.append(p)
                        names.append(term)
                        labels.append(label)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(names, pa.string()), pa.array(labels, pa.string())], ["id", "pos", "term", "label"])

    return rows.mapInArrow(find, f"id {kind}, pos int, term string, label string")


def title_variants(patterns: dict[str, list[str]]) -> dict[str, list[str]]:
    """Each term as it is and without its blanks. Upper and lower case are one in matching, so a title's capitals
    need no variant of their own."""
    return {label: list(dict.fromkeys(x for t in listed for x in (t, t.replace(" ", "")))) for label, listed in patterns.items()}


def tag(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (id, ...) with entities in order, the first as primary."""
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "label"))).alias("_e"))
    rows = docs.join(lists, "id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumn("ner_entities", F.coalesce(F.array_distinct("_e.term"), none)).withColumn("ner_labels", F.coalesce(F.col("_e.label"), none)).withColumn("ner_primary_entity", F.try_element_at("_e.term", F.lit(1))).drop("_e")


def priority_category(text: Column, labels: Column, error_signals: list[str]) -> Column:
    """ADMIN, then an error signal in the text, then LANGUAGE, TOOL, CONCEPT, else OTHER."""
    errors = reduce(lambda a, b: a | b, [text.contains(s) for s in error_signals], F.lit(False))
    out = F.when(F.array_contains(labels, "ADMIN"), "ADMIN").when(errors, "ERROR")
    for label in ("LANGUAGE", "TOOL", "CONCEPT"):
        out = out.when(F.array_contains(labels, label), label)
    return out.otherwise("OTHER")


def first_strong_category(labels: Column) -> Column:
    """The first label that is not CONCEPT, else CONCEPT if any, else OTHER."""
    strong = F.filter(labels, lambda x: x.isin("ADMIN", "ERROR", "TOOL", "LANGUAGE"))
    return F.coalesce(F.try_element_at(strong, F.lit(1)), F.when(F.array_contains(labels, "CONCEPT"), "CONCEPT"), F.lit("OTHER"))


def majority(rows: DataFrame, topic: str = "topic", category: str = "category", least: float = MAJORITY) -> DataFrame:
    """(topic, majority): the commonest category but OTHER, if its share of all the topic's rows is
    ``least`` or more; ties by name; -1 is no topic."""
    counts = rows.filter(F.col(topic) != -1).groupBy(topic, category).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(topic).agg(F.sum("n").alias("all"))
    order = Window.partitionBy(topic).orderBy(F.desc("n"), category)
    best = counts.filter(F.col(category) != "OTHER").withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    return best.join(sizes, topic).filter(F.col("n") >= least * F.col("all")).select(topic, F.col(category).alias("majority"))


def reclassify(rows: DataFrame, text: str, signals: dict[str, list[str]], skip_rules: bool = False, skip_cluster: bool = False, order: list[str] | None = None) -> DataFrame:
    """rows (id, topic, category, ...) with new_category and source: unchanged, rules, cluster or
    fallback. Votes are taken on the categories as given, so the result does not depend on row order."""
    q, rule = F.trim(F.lower(text)), F.lit(None).cast("string")
    if not skip_rules:
        for name in reversed(order or RULE_ORDER):
            if signals.get(name):
                rule = F.when(any_signal(signals[name], q), name).otherwise(rule)
    votes = majority(rows)
    out = rows.join(votes, "topic", "left").withColumn("_rule", rule)
    vote = F.lit(None).cast("string") if skip_cluster else F.col("majority")
    other = F.col("category") == "OTHER"
    source = F.when(~other, "unchanged").when(F.col("_rule").isNotNull(), "rules").when(vote.isNotNull(), "cluster").otherwise("fallback")
    new = F.when(~other, F.col("category")).otherwise(F.coalesce("_rule", vote, F.lit("OTHER")))
    return out.withColumn("new_category", new).withColumn("source", source).drop("majority", "_rule")


def missed_terms(docs: DataFrame, found: DataFrame, text: str, stop: list[str], least: int = 1) -> DataFrame:
    """Words of documents without an entity."""
    rows = docs.join(found.select("id").distinct(), "id", "left_anti")
    words = rows.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-z][a-z]{2,}\b"), F.lit(0))).alias("term")).filter(~F.col("term").isin(stop))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


#: Substrings that give a missed term its label, in order.
SUGGESTIONS = [
    ("ERROR", ["could", "recognized", "insufficient", "missing", "stuck", "timeout", "crash", "failed"]),
    ("ADMIN", ["leaderboard", "office", "books", "resources", "zoom", "call", "certificate", "deadline"]),
    ("TOOL", ["wsl", "curl", "wget", "chrome", "vm", "vms", "remote", "html", "linux", "codespaces", "compute", "engine"]),
]
SUGGESTED_LANGUAGES = ["bash", "shell", "powershell"]


def suggest(missed: DataFrame, least: int = 3, most: int = 50) -> DataFrame:
    """Labels for the commonest missed terms."""
    label = F.lit(None).cast("string")
    for name, parts in reversed([*SUGGESTIONS]):
        label = F.when(reduce(lambda a, b: a | b, [F.col("term").contains(p) for p in parts]), name).otherwise(label)
    label = F.coalesce(label, F.when(F.col("term").isin(SUGGESTED_LANGUAGES), "LANGUAGE"))
    top = missed.orderBy(F.desc("n"), "term").limit(most).filter(F.col("n") >= least)
    return top.withColumn("label", label).filter("label IS NOT NULL AND length(term) > 2")


def validate(rows: DataFrame) -> DataFrame:
    """One row of topic measures; rows: (topic, topic_probability, course). -1 marks outliers."""
    total = rows.agg(F.count(F.lit(1)).alias("total_documents"), F.count_if(F.col("topic") == -1).alias("outlier_count"), F.round(F.avg(F.when(F.col("topic") != -1, F.col("topic_probability"))), 4).alias("confidence_mean"), F.count_if((F.col("topic") != -1) & (F.col("topic_probability") < 0.5)).alias("low_confidence_count"))
    sizes = rows.filter("topic != -1").groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("course").alias("courses"))
    stats = sizes.agg(F.count(F.lit(1)).alias("num_topics"), F.min("n").alias("size_min"), F.max("n").alias("size_max"), F.round(F.avg("n"), 1).alias("size_mean"), F.round(F.median("n"), 1).alias("size_median"), F.round(F.stddev_samp("n"), 1).alias("size_std"), F.count_if(F.col("n") <= 3).alias("tiny_topics"), F.count_if(F.col("courses") > 1).alias("cross_course_topics"))
    both = total.join(F.broadcast(stats))
    return both.withColumn("outlier_ratio", F.round(F.col("outlier_count") / F.col("total_documents"), 4)).withColumn("largest_topic_share", F.round(F.col("size_max") / F.col("total_documents"), 4))


def keyword_overlap(keywords: DataFrame) -> DataFrame:
    """Mean Jaccard over all pairs of topics; keywords: (topic, word). Shared words come from a join on
    the word; pairs that share none add nothing but count in the mean."""
    k = keywords.distinct()
    sizes = k.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    a = k.join(sizes, "topic").select(F.col("topic").alias("a"), "word", F.col("n").alias("na"))
    b = k.join(sizes, "topic").select(F.col("topic").alias("b"), "word", F.col("n").alias("nb"))
    shared = a.join(b, "word").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    total = shared.agg(F.coalesce(F.sum(F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))), F.lit(0.0)).alias("s"))
    n = sizes.agg(F.count(F.lit(1)).alias("t"))
    return total.join(F.broadcast(n)).select(F.when(F.col("t") >= 2, F.round(F.col("s") / (F.col("t") * (F.col("t") - 1) / 2), 4)).alias("keyword_overlap"))


def composite(models: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of min-max scaled measures, 1 best; equal values count 1, missing ones 0.5. One row
    per model."""
    weights = weights or WEIGHTS
    w = Window.partitionBy(F.lit(0))
    parts = []
    for name, weight in weights.items():
        low, high = F.min(name).over(w), F.max(name).over(w)
        scaled = (F.col(name) - low) / (high - low)
        scaled = scaled if name == "confidence_mean" else 1 - scaled
        parts.append(weight * F.when(F.col(name).isNull(), 0.5).when(high == low, 1.0).otherwise(scaled))
    return models.withColumn("composite", F.round(reduce(lambda a, b: a + b, parts) / sum(weights.values()), 6))


def _status(violations: list[Column]) -> Column:
    n = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(False)).cast("int") for v in violations])
    return F.when(n == 0, "OK").when(n == 1, "WARN").otherwise("FAIL")


def fixed_status(models: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """OK, WARN (one violation) or FAIL. Outliers alone count twice."""
    x = limits or LIMITS
    outlier = F.col("outlier_ratio") >= x["outlier_ratio"]
    return models.withColumn("status", _status([outlier, outlier, F.col("keyword_overlap") >= x["keyword_overlap"], F.col("confidence_mean") < x["confidence_mean"], F.col("cross_course_topics") > x["cross_course_topics"]]))


def adaptive_status(models: DataFrame, share: float = 0.25) -> DataFrame:
    """Thresholds from the models' own percentiles (linear)."""
    at = models.agg(F.percentile("outlier_ratio", F.lit(1 - share)).alias("_o"), F.percentile("keyword_overlap", F.lit(1 - share)).alias("_k"), F.percentile("confidence_mean", F.lit(share)).alias("_c"))
    rows = models.join(F.broadcast(at))
    return rows.withColumn("status", _status([F.col("outlier_ratio") > F.col("_o"), F.col("keyword_overlap") > F.col("_k"), F.col("confidence_mean") < F.col("_c"), F.col("cross_course_topics") > LIMITS["cross_course_topics"]])).drop("_o", "_k", "_c")


def pareto(models: DataFrame) -> DataFrame:
    """Models that no other beats on every measure; one row per model, so the theta join is small."""
    rows = models.filter("outlier_ratio IS NOT NULL AND keyword_overlap IS NOT NULL AND confidence_mean IS NOT NULL")
    o = rows.select(*[F.col(c).alias(f"o_{c}") for c in ("outlier_ratio", "keyword_overlap", "confidence_mean")])
    as_good = (F.col("o_outlier_ratio") <= F.col("outlier_ratio")) & (F.col("o_keyword_overlap") <= F.col("keyword_overlap")) & (F.col("o_confidence_mean") >= F.col("confidence_mean"))
    better = (F.col("o_outlier_ratio") < F.col("outlier_ratio")) | (F.col("o_keyword_overlap") < F.col("keyword_overlap")) | (F.col("o_confidence_mean") > F.col("confidence_mean"))
    return rows.join(o, as_good & better, "left_anti").select("model")


def ctfidf(docs: DataFrame, topic: str, text: str, k: int = 10, stop: list[str] | None = None) -> DataFrame:
    """Class-based TF-IDF: tf in the topic's text times ln(1 + mean words per topic / total tf)."""
    words = docs.select(topic, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("term"))
    if stop:
        words = words.filter(~F.col("term").isin(stop))
    tf = words.groupBy(topic, "term").agg(F.count(F.lit(1)).alias("tf"))
    total = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    mean = tf.groupBy(topic).agg(F.sum("tf").alias("w")).agg(F.avg("w").alias("a"))
    sizes = tf.groupBy(topic).agg(F.sum("tf").alias("w"))
    score = F.col("tf") / F.col("w") * F.log(1 + F.col("a") / F.col("f"))
    rows = tf.join(total, "term").join(sizes, topic).join(F.broadcast(mean)).withColumn("score", F.round(score, 9))
    order = Window.partitionBy(topic).orderBy(F.desc("score"), "term")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(topic, "rank", "term", "score")


def cluster(vectors: DataFrame, k: int, cutoff: float = 0.2, seed: int = 42) -> DataFrame:
    """An analogue of density clustering: spherical k-means; vectors whose cosine with their centre is
    below ``cutoff`` become outliers (-1). (id, topic, topic_probability)"""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from .retrieval import dot, unit

    rows = vectors.select("id", "v", array_to_vector(F.col("v")).alias("features"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(rows)
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, centre array<double>")
    placed = model.transform(rows).withColumn("v", vector_to_array("features")).join(F.broadcast(centres), "prediction")
    near = F.round(dot(unit(F.col("v")), unit(F.col("centre"))), 6)
    return placed.select("id", F.when(near >= cutoff, F.col("prediction")).otherwise(-1).alias("topic"), near.alias("topic_probability"))


def reassign_outliers(rows: DataFrame, vectors: DataFrame, least: float = 0.1) -> DataFrame:
    """Outliers go to the topic whose mean vector is nearest, if the cosine is ``least`` or more. Topics'
    means, one row each, are broadcast."""
    from .retrieval import dot, unit

    few(rows)
    both = rows.join(vectors.select("id", "v"), "id")
    dims = both.filter("topic != -1").select("topic", F.posexplode("v").alias("i", "x")).groupBy("topic", "i").agg(F.avg("x").alias("x"))
    means = dims.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("m"))
    all_ = means.agg(F.collect_list(F.struct("topic", "m")).alias("all"))
    scored = both.filter("topic = -1").join(F.broadcast(all_)).withColumn("best", F.array_max(F.transform("all", lambda t: F.struct(F.round(dot(unit(F.col("v")), unit(t["m"])), 6).alias("s"), (-t["topic"]).alias("neg")))))
    moved = scored.select("id", F.when(F.col("best.s") >= least, -F.col("best.neg")).otherwise(-1).alias("topic"), F.col("best.s").alias("topic_probability"))
    return rows.filter("topic != -1").select("id", "topic", "topic_probability").unionByName(moved)


def silhouette(points: DataFrame) -> DataFrame:
    """Mean simplified silhouette with cosine distance: (b - a) / max(a, b), a and b being the distances to
    the own and the nearest other topic's mean; points: (id, v, topic), outliers left out."""
    from .retrieval import dot, unit

    rows = points.filter("topic != -1").withColumn("v", unit(F.col("v")))
    few(rows)
    dims = rows.select("topic", F.posexplode("v").alias("i", "x")).groupBy("topic", "i").agg(F.avg("x").alias("x"))
    means = dims.groupBy("topic").agg(unit(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"])).alias("m"))
    all_ = means.agg(F.collect_list(F.struct("topic", "m")).alias("all"))
    far = rows.join(F.broadcast(all_))
    dist = lambda keep: F.array_min(F.transform(F.filter("all", keep), lambda t: 1 - dot(F.col("v"), t["m"])))
    far = far.withColumn("a", dist(lambda t: t["topic"] == F.col("topic"))).withColumn("b", dist(lambda t: t["topic"] != F.col("topic")))
    return far.agg(F.round(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")), 6).alias("silhouette"), F.countDistinct("topic").alias("topics"))


def cluster_quality(points: DataFrame) -> DataFrame:
    """Exact mean silhouette with cosine distance, and the Davies-Bouldin index with Euclidean distance, of
    points (id, v, topic), outliers left out; one row, both null for fewer than two topics. The distances of a
    point to a topic's members add up to n - u . S, S being the sum of their unit vectors, so no pairs of
    points are formed. The only member of a topic counts 0, as does a point that lies on two topics at once."""
    from .retrieval import dot, unit

    rows = points.filter("topic != -1").select("id", "topic", "v", unit(F.col("v")).alias("u"))
    few(rows)
    dims = rows.select("topic", F.posexplode(F.arrays_zip("u", "v")).alias("i", "e")).groupBy("topic", "i").agg(F.sum("e.u").alias("su"), F.avg("e.v").alias("m"), F.count(F.lit(1)).alias("n"))
    part = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda e: e[c])
    means = dims.groupBy("topic").agg(part("su").alias("su"), part("m").alias("m"), F.max("n").alias("n"))
    far = rows.join(F.broadcast(means.agg(F.collect_list(F.struct("topic", "su", "n")).alias("all"))))
    dist = lambda keep, less: F.array_min(F.transform(F.filter("all", keep), lambda t: F.when(t["n"] > less, (t["n"] - dot(F.col("u"), t["su"])) / (t["n"] - less))))
    far = far.select(dist(lambda t: t["topic"] == F.col("topic"), 1).alias("a"), dist(lambda t: t["topic"] != F.col("topic"), 0).alias("b"))
    one = F.when(F.col("a").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    sil = far.agg(F.round(F.avg(F.when(F.col("b").isNotNull(), one)), 6).alias("silhouette"))

    apart = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, d: acc + d))
    wide = rows.join(means.select("topic", "m"), "topic").groupBy("topic").agg(F.avg(apart("v", "m")).alias("s"))
    spread = means.join(wide, "topic").select("topic", "m", "s")
    others = spread.join(F.broadcast(spread.agg(F.collect_list(F.struct("topic", "m", "s")).alias("all"))))
    worst = F.array_max(F.transform(F.filter("all", lambda t: t["topic"] != F.col("topic")), lambda t: F.try_divide(F.col("s") + t["s"], apart(F.col("m"), t["m"]))))
    db = others.agg(F.round(F.avg(worst), 6).alias("davies_bouldin"), F.count(F.lit(1)).alias("topics"))
    return sil.join(F.broadcast(db))


def few(rows: DataFrame) -> None:
    """Refuses more than MOST_TOPICS topics: one vector of each is sent to every task."""
    n = rows.select("topic").distinct().count()
    if n > MOST_TOPICS:
        raise ValueError(f"{n} topics; at most {MOST_TOPICS} can be held by every task")


def dense_topics(rows: DataFrame, k: int = 5) -> DataFrame:
    """The k largest topics; -1 is none."""
    return rows.filter("topic != -1").groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").limit(k)


def subtopics(points: DataFrame, least: int = 40, parts: int = 2, rounds: int = 10) -> DataFrame:
    """(id, topic, subtopic) of topics with more than ``least`` members: spherical k-means on each topic's
    vectors, started from its first members by id. Means, not members, travel: each round is one
    aggregation over all topics, whose means are written to the scratch folder."""
    from .retrieval import dot, unit

    spark = points.sparkSession
    place = f"{folder(spark)}/subtopics-{uuid4().hex}"
    drop_at_exit(spark, place)
    big = points.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > least) & (F.col("topic") != -1)).select("topic")
    rows = points.join(big, "topic").select("id", "topic", unit(F.col("v")).alias("v"))
    first = Window.partitionBy("topic").orderBy("id")
    centres = rows.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= parts).select("topic", (F.col("_r") - 1).alias("s"), F.col("v").alias("m"))
    placed = rows
    for turn in range(rounds):
        listed = centres.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("s", "m"))).alias("all"))
        best = F.array_max(F.transform("all", lambda c: F.struct(F.round(dot(F.col("v"), c["m"]), 9).alias("d"), (-c["s"]).alias("neg"))))
        placed = rows.join(listed, "topic").select("id", "topic", "v", (-best["neg"]).alias("s"))
        if turn + 1 < rounds:
            dims = placed.select("topic", "s", F.posexplode("v").alias("i", "x")).groupBy("topic", "s", "i").agg(F.avg("x").alias("x"))
            means = dims.groupBy("topic", "s").agg(unit(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"])).alias("m"))
            means.write.parquet(f"{place}/{turn}")
            centres = spark.read.schema(means.schema).parquet(f"{place}/{turn}")
    return placed.select("id", "topic", F.col("s").alias("subtopic"))


def subtopic_keywords(docs: DataFrame, placed: DataFrame, text: str, k: int = 5) -> DataFrame:
    """(topic, subtopic, rank, term, score): the words that set each subtopic apart, all subtopics of all topics
    being the classes. placed: (id, topic, subtopic)."""
    rows = docs.join(placed.select("id", F.struct("topic", "subtopic").alias("_class")), "id")
    found = ctfidf(rows, "_class", text, k)
    return found.select("_class.topic", "_class.subtopic", "rank", "term", "score")


def concept_notes(docs: DataFrame, terms: DataFrame, text: str = "answer") -> DataFrame:
    """(id, note): a note naming the first three, by name, of the given terms that a document holds."""
    few = terms.select("term").distinct().orderBy("term").limit(NOTE_TERMS + 1).collect()
    if len(few) > NOTE_TERMS:
        words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]{2,}"), F.lit(0)))
        held = docs.select("id", F.explode(words).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
        lists = held.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("term")), 1, 3).alias("t"))
    else:
        # Few terms are looked up among a document's words, so that three of them leave its row.
        wanted = F.array(*[F.lit(r.term) for r in few]).cast("array<string>")
        words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]{2,}"), F.lit(0))
        own = docs.select("id", F.slice(F.sort_array(F.array_intersect(words, wanted)), 1, 3).alias("t")).filter(F.size("t") > 0)
        lists = own.groupBy("id").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("t")))), 1, 3).alias("t"))
    return lists.select("id", F.concat(F.lit("Concepts: "), F.array_join("t", ", ")).alias("note"))
