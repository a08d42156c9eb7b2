"""Line dedup by site-relative frequency.

Per host, the pages that hold a line are divided by the host's pages; lines above ``ratio`` that stand
on at least ``least`` pages are boilerplate and are dropped from every page of that host. Copies of a page
(equal texts on a host) count as one page, so a page is not boilerplate for having been copied.

Lines are compared without the white space around them, by their 64-bit hash within a host; blank lines stay.
A host has at most (mean lines of a page / ratio) such lines, so its list is short. The lists are
broadcast while they hold at most ``BROADCAST_LINES`` lines together, else joined by host.

Defined results: a null text has no lines and stays null; an empty one stays empty; a page may lose
all its lines and stays as an empty text; null hosts are one host; repeated rows are treated
alike; an empty table gives no rows; further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hidden, let, materialize, table

RATIO, LEAST = 0.1, 3
BROADCAST_LINES = 50_000
_SPACE = " \t\x0b\x0c\r"


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_SPACE)))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(_host, _lines): hashes of each host's boilerplate lines."""
    lines = F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != ""), _line_hash))
    rows = pages.filter(F.col(text).isNotNull()).select(F.col(host).alias("_host"), F.xxhash64(text).alias("_page"), lines.alias("_all"))
    totals = rows.select("_host", "_page").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    held = rows.select("_host", "_page", F.explode("_all").alias("_line")).distinct().groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    over = held.join(totals.withColumnRenamed("_host", "_of"), F.col("_host").eqNullSafe(F.col("_of"))).filter(F.col("_n") > ratio * F.col("_pages"))
    return over.groupBy("_host").agg(F.sort_array(F.collect_list("_line")).alias("_lines"))


def drop_boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, least: int = LEAST, counts: bool = True) -> DataFrame:
    """pages with ``text`` cut and, with ``counts``, the columns _n_lines, _n_dropped of its non-blank lines."""
    rows, name = hidden(pages)
    host, text = name[host], name[text]
    lists = materialize(boilerplate(rows, host, text, ratio, least), "boilerplate")
    size = lists.agg(F.sum(F.size("_lines"))).first()[0] or 0
    if size <= BROADCAST_LINES:
        lists = F.broadcast(lists)
    both = rows.join(lists, F.col(host).eqNullSafe(F.col("_host")), "left")

    def judged(line: Column) -> Column:
        key = F.btrim(line, F.lit(_SPACE))
        worded = key != ""
        return F.struct(line.alias("line"), worded.alias("worded"), (worded & F.coalesce(F.array_contains("_lines", F.xxhash64(key)), F.lit(False))).alias("gone"))

    def told(rows: Column) -> Column:
        kept = F.transform(F.filter(rows, lambda x: ~x["gone"]), lambda x: x["line"])
        return F.struct(F.array_join(kept, "\n").alias("text"), F.size(F.filter(rows, lambda x: x["worded"])).alias("n"), F.size(F.filter(rows, lambda x: x["gone"])).alias("gone"))

    done = both.withColumn("_t", let(F.transform(F.split(text, "\n", -1), judged), told))
    none, there = F.lit(0), F.col(text).isNotNull()
    out = [F.when(there, F.col("_t.text")).alias(c) if x == text else F.col(x).alias(c) for c, x in name.items()]
    if counts:
        out += [F.when(there, F.col(f"_t.{x}")).otherwise(none).alias(c) for c, x in (("_n_lines", "n"), ("_n_dropped", "gone"))]
    return done.select(*out)


def page_text(html: Column) -> Column:
    """Visible text of a page, one line per element."""
    bare = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", "\n")
    return F.regexp_replace(bare, r"\n[ \t\r\n]*", "\n")


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/:?#]+)", 1)
    # Written once: the lines are read twice, tags are cut out once.
    pages = materialize(pages.select("page_id", host.alias("host"), page_text(F.col("html")).alias("text")), "page-text")
    out = drop_boilerplate(pages, "host", "text")
    return out.select("page_id", "host", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_dropped").cast("long").alias("n_dropped"), F.col("text").alias("kept_text"))


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) AS host,
    regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', chr(10), 'gs'), '\n[ \t\r\n]*', chr(10), 'g') AS text
  FROM pages),
l AS (SELECT page_id, host, text, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM p),
t AS (SELECT *, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS key FROM l),
n AS (SELECT host, count(DISTINCT text) AS pages FROM p GROUP BY host),
b AS (SELECT t.host, key FROM t JOIN n USING (host) WHERE key <> '' GROUP BY t.host, key, pages
      HAVING count(DISTINCT text) >= 3 AND count(DISTINCT text) > 0.1::DOUBLE * pages),
m AS (SELECT t.*, b.key IS NOT NULL AS gone FROM t LEFT JOIN b ON t.host = b.host AND t.key = b.key)
SELECT page_id, any_value(host) AS host, count(*) FILTER (WHERE key <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept_text
FROM m GROUP BY page_id"""
