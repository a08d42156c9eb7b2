"""Corpus audits: one pass of conditional aggregates each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keyword lists and bounds of the audits.
INTENTS = {
    "troubleshooting": ["error", "failed", "cannot", "unable", "denied", "exception", "bug"],
    "setup": ["install", "setup", "docker", "environment"],
    "conceptual": ["what", "why", "explain", "difference", "vs"],
    "homework": ["homework", "assignment", "deadline", "leaderboard"],
}
CODE_WORDS = ["docker", "python", "pip", "git", "aws", "gcp", "spark", "mlflow", "terraform", "kubernetes"]
PLACEHOLDERS = ["todo", "coming soon", "n/a", "tbd", "fixme", "placeholder", "see above", "see below"]
STOPLIST = (
    "the a an how do i my to is in of and it me for with can what why when using use get that this not on be so but or we you are does "
    "have has been will would should could just all if no am up out some any very really need go going way also as at its from like make "
    "more than too one about which there their them"
).split()
SHORT_ANSWER, LEAST_ANSWER, LONG_ANSWER = 50, 10, 2000


def blank(c: Column) -> Column:
    return c.isNull() | c.rlike(r"^\s*$")


def validate(docs: DataFrame, courses: list[str]) -> DataFrame:
    """Counts of each kind of issue."""
    one = docs.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(blank(F.col("id").cast("string")) | blank(F.col("question")) | blank(F.col("answer")) | blank(F.col("course"))).alias("empty_required"),
        F.count_if(F.length(F.trim("answer")) < LEAST_ANSWER).alias("short_answers"),
        F.count_if(~F.col("course").isin(courses)).alias("unknown_course"),
        F.count_if(F.col("answer").contains("<{") | F.col("answer").contains("<IMAGE")).alias("artifacts"),
    )
    repeated = docs.groupBy("id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("duplicate_ids"))
    return one.join(F.broadcast(repeated))


def quarantine(docs: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose required fields are filled, the others with a reason)."""
    reason = F.array_join(F.array_compact(F.array(*[F.when(blank(F.col(c).cast("string")), F.lit(c)) for c in required])), ",")
    marked = docs.withColumn("reason", reason)
    return marked.filter("reason = ''").drop("reason"), marked.filter("reason <> ''")


def metadata(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count_if(F.col("id").isNull()).alias("missing_ids"), (F.count("id") - F.countDistinct("id")).alias("duplicate_ids"), F.count_if(blank(F.col("course"))).alias("missing_courses"), F.countDistinct("course").alias("n_courses"), F.count_if(blank(F.col("section"))).alias("missing_sections"), F.countDistinct("section").alias("n_sections"))


def content(docs: DataFrame) -> DataFrame:
    a, q = F.col("answer"), F.col("question")
    n = F.length(a)
    spaces = n - F.length(F.regexp_replace(a, r"[ \t\n\r\f\x0b]", ""))
    return docs.agg(
        F.count_if(F.trim(a) == "").alias("empty_answers"),
        F.count_if(F.lower(F.trim(a)).isin(PLACEHOLDERS)).alias("placeholder_answers"),
        F.count_if(spaces > n * 0.5).alias("excessive_whitespace"),
        F.sum(n - F.length(F.regexp_replace(a, r"[\x00-\x1f\x7f]", ""))).alias("control_chars"),
        F.count_if((n < LEAST_ANSWER) | (n > LONG_ANSWER)).alias("length_outliers"),
        F.count_if(((F.length(q) < 20) & (n > 1000)) | ((F.length(q) > 200) & (n < 50))).alias("ratio_outliers"),
    )


def length_stats(docs: DataFrame, by: str, text: str) -> DataFrame:
    """min, max, mean and the sorted lengths' elements at n//10, n//2 and n*9//10, per group.

    Lengths are counted first, so a group is ranked by its distinct lengths, not its rows."""
    counted = docs.groupBy(by, F.length(text).alias("len")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(by).orderBy("len")
    upto = counted.withColumn("end", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    at = lambda i: F.min(F.when(F.col("end") > F.floor(i), F.col("len")))
    return upto.groupBy(by).agg(F.first("n").alias("n"), F.min("len").alias("min"), F.max("len").alias("max"), F.round(F.sum(F.col("len") * F.col("c")) / F.first("n"), 1).alias("mean"), at(F.col("n") / 10).alias("p10"), at(F.col("n") / 2).alias("p50"), at(F.col("n") * 9 / 10).alias("p90"))


def length_buckets(docs: DataFrame, text: str, *by: str) -> DataFrame:
    n = F.length(text)
    name = F.when(n < 50, "very_short").when(n < 200, "short").when(n < 800, "medium").otherwise("long")
    return docs.groupBy(*by, name.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def answer_signals(docs: DataFrame, *by: str) -> DataFrame:
    a = F.col("answer")
    return docs.groupBy(*by).agg(F.count_if(a.contains("```")).alias("has_code_block"), F.count_if(a.contains("http")).alias("has_url"), F.count_if(a.rlike(r"[*\-]\s|\d+\.")).alias("has_list"))


def code_share(docs: DataFrame, by: str) -> DataFrame:
    code = F.col("answer").contains("```") | F.lower("answer").contains("<code>")
    return docs.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(code).alias("with_code"), F.round(F.avg(code.cast("double")) * 100, 2).alias("code_pct"))


def code_misses(docs: DataFrame, words: list[str], most: int = 50) -> DataFrame:
    """Questions that speak of code while the answer has none; the first ``most`` by id."""
    said = F.array_intersect(F.regexp_extract_all(F.lower("question"), F.lit(r"[a-z]+"), F.lit(0)), F.array(*[F.lit(w) for w in words]))
    rows = docs.filter(~F.col("answer").contains("```") & ~F.lower("answer").contains("<code>")).withColumn("matched", F.array_sort(F.array_distinct(said)))
    return rows.filter(F.size("matched") > 0).select("id", F.substring("question", 1, 100).alias("question"), "course", "matched").orderBy("id").limit(most)


def short_answers(docs: DataFrame) -> DataFrame:
    return docs.filter(F.length(F.trim("answer")) < SHORT_ANSWER).select("id", "course", F.length("answer").alias("answer_length"))


def imbalance(docs: DataFrame, by: str) -> DataFrame:
    counts = docs.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    all_ = counts.agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"))
    return counts.join(F.broadcast(all_)).select(by, "n", F.round(F.col("n") / F.col("total") * 100, 1).alias("pct"), F.round(F.col("n") / F.col("least"), 2).alias("weight_vs_smallest"), F.round(F.col("most") / F.col("least"), 4).alias("max_min_ratio"), (F.col("most") / F.col("least") > 3).alias("imbalanced"))


def intent_counts(docs: DataFrame, by: str, intents: dict[str, list[str]] | None = None) -> DataFrame:
    """A document counts for each intent whose keyword its question holds, else for 'other'; over all
    and per group, in one grouping-sets pass."""
    q = F.lower("question")
    found = F.array_compact(F.array(*[F.when(_contains_any(q, words), F.lit(name)) for name, words in (intents or INTENTS).items()]))
    rows = docs.select(by, F.explode(F.when(F.size(found) == 0, F.array(F.lit("other"))).otherwise(found)).alias("intent"))
    return rows.groupingSets([["intent"], [by, "intent"]], by, "intent").agg(F.count(F.lit(1)).alias("n"), F.grouping(by).alias("overall")).withColumn("overall", F.col("overall") == 1)


def _contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def word_freq(docs: DataFrame, text: str, most: int, pattern: str = r"(?U)\b[a-z][a-z-]*[a-z]\b", least: int = 3, stop: list[str] | None = None) -> DataFrame:
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("word"))
    kept = words.filter((F.length("word") >= least) & ~F.col("word").isin(STOPLIST if stop is None else stop))
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(most)


def fenced_languages(docs: DataFrame, most: int = 10) -> DataFrame:
    """Tags after fence marks; closing fences count as 'unknown'."""
    tags = docs.select(F.explode(F.regexp_extract_all("answer", F.lit(r"```(\w*)"), F.lit(1))).alias("lang"))
    return tags.groupBy(F.when(F.col("lang") == "", "unknown").otherwise(F.col("lang")).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most)


def inline_code(docs: DataFrame) -> DataFrame:
    code = F.lower("code")
    kind = F.when(_contains_any(code, ["import", "def ", "class ", "print(", "pip ", "python"]), "python").when(_contains_any(code, ["docker", "kubectl", "helm"]), "k8s").otherwise("other")
    return docs.select(F.explode(F.regexp_extract_all("answer", F.lit(r"`([^`]+)`"), F.lit(1))).alias("code")).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def code_blocks(docs: DataFrame, *by: str) -> DataFrame:
    """Fenced blocks: complete, truncated or malformed."""
    blocks = docs.select(*by, F.explode(F.regexp_extract_all("answer", F.lit(r"(?s)```.*?```"), F.lit(0))).alias("b"))
    complete, started = F.col("b").rlike(r"```(?:\w+)?\n(?:[^\n]*\n)+```"), F.col("b").rlike(r"```(?:\w+)?\n")
    return blocks.groupBy(*by).agg(F.count_if(complete).alias("complete"), F.count_if(~complete & started).alias("truncated"), F.count_if(~complete & ~started).alias("malformed"))


def correlation(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(F.length("question").cast("double"), F.length("answer").cast("double")), 3).alias("pearson_r"))


def signal_reclassify(docs: DataFrame, text: str, signals: dict[str, list[str]]) -> DataFrame:
    """First class, in order, one of whose signals the text holds; else OTHER."""
    t, out = F.lower(text), None
    for name, words in signals.items():
        hit = _contains_any(t, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return docs.withColumn("category", out.otherwise("OTHER"))
