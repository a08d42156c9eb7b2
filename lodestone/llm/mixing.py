"""Mixing sources to target weights: entropy balancing under token constraints.

Documents start with rate 1 and may rise to ``cap``. Of all rates that meet every source's token
target, the ones nearest to the start in (bounded) relative entropy are exponential tilts of the
odds, ``r = cap / (1 + (cap - 1) exp(-lambda_source * size / mean_size))``. The convex dual has one
unknown per source; safeguarded Newton steps solve all of them at once, each step one distributed
aggregation over (source, size) counts. Rates become whole copies by systematic rounding along
sizes, at the offset of ``OFFSETS`` that comes nearest the target; what is still missing or too much
is settled with the shortest documents, so a source ends within about one short document of its
target.

Defined results: null texts have size 0 and take nothing; null sources form one source, last in
order; equal rows are separate documents; an empty table gives no rows. More than MAX_SOURCES sources
are refused, as the mixture's weights are held by the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gapless_rank, hidden, materialize, orderable, parts_for, table, word_count

MAX_SOURCES = 10_000
ROWS_PER_BUCKET = 50_000
OFFSETS = [i / 20 for i in range(1, 20)]
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
UNIT = 1_000_000


def waterfill(sizes: Sequence[int], weights: Sequence[float], cap: float) -> list[float]:
    """Share the sum of ``sizes`` by weight; no share above cap times its size, the excess reshared."""
    total, left = float(sum(sizes)), list(range(len(sizes)))
    out, room = [0.0] * len(sizes), total
    while left:
        mass = sum(weights[i] for i in left)
        over = [i for i in left if room * weights[i] / mass > cap * sizes[i]]
        if not over:
            for i in left:
                out[i] = room * weights[i] / mass
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left = [i for i in left if i not in set(over)]
        room = total - sum(out[i] for i in range(len(sizes)) if i not in set(left))
    return out


def _rate(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * size / mean))
    return F.lit(float(cap)) / (1 + (cap - 1) * F.exp(-z))


def _given(cells: DataFrame, **values: Sequence) -> DataFrame:
    """cells with a column for each list of values, one value to a source's number ``_s``."""
    columns = {n: pa.array(v, pa.int64() if all(isinstance(x, int) for x in v) else pa.float64()) for n, v in values.items()}
    # At most MAX_SOURCES rows; a table of Arrow's reaches the JVM without Python workers on the executors.
    small = cells.sparkSession.createDataFrame(pa.table({"_s": pa.array(range(len(next(iter(values.values())))), pa.int32()), **columns}))
    return cells.join(F.broadcast(small), "_s")


def solve_tilts(cells: DataFrame, sizes: Sequence[int], counts: Sequence[int], targets: Sequence[float], cap: float, steps: int = 60, tolerance: float = 1e-7) -> list[float]:
    """The dual variables, one per source; cells: (_s, size, n). +-700 means all or nothing."""
    k = len(sizes)
    mean = [max(1.0, s / max(1, c)) for s, c in zip(sizes, counts)]
    lam, low, high = [0.0] * k, [-math.inf] * k, [math.inf] * k
    done = [False] * k
    for i in range(k):
        if sizes[i] == 0 or targets[i] >= cap * sizes[i] * (1 - 1e-12):
            lam[i], done[i] = 1e9, True
        elif targets[i] <= 0:
            lam[i], done[i] = -1e9, True
    for _ in range(steps):
        if all(done):
            break
        r = _rate(F.col("_lam"), F.col("size"), F.col("_mean"), cap)
        words = F.col("n") * F.col("size")
        slope = words * F.col("size") / F.col("_mean") * r * (1 - r / cap)
        exact = lambda c: F.sum(F.round(c, 3).cast("decimal(30,3)")).cast("double")
        for s, got, rise in _given(cells, _lam=lam, _mean=mean).groupBy("_s").agg(exact(words * r), exact(slope)).collect():
            if done[s]:
                continue
            miss = got - targets[s]
            if abs(miss) <= tolerance * max(1.0, targets[s]):
                done[s] = True
                continue
            low[s], high[s] = (low[s], lam[s]) if miss > 0 else (lam[s], high[s])
            step = lam[s] - miss / rise if rise > 0 else math.nan
            if not low[s] < step < high[s] or abs(step - lam[s]) > 4 + 4 * abs(lam[s]):
                if math.isinf(low[s]):
                    step = high[s] - 2 - 2 * abs(high[s])
                elif math.isinf(high[s]):
                    step = low[s] + 2 + 2 * abs(low[s])
                else:
                    step = (low[s] + high[s]) / 2
            lam[s] = float(f"{step:.9g}")
    return lam


def mix_plan(slim: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, carry: Sequence[str] = ()) -> DataFrame:
    """slim: (doc_id, source, size, *carry). One row per row of slim, with source_size, target, rate, copies.
    Which of a source's documents of one size get a copy more is drawn by a hash of the doc_id."""
    cells = materialize(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    found = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("w"), F.sum("n").alias("d")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    names, sizes, counts = [r[0] for r in found], [int(r[1]) for r in found], [int(r[2]) for r in found]
    targets = waterfill(sizes, [weights[i % len(weights)] for i in range(len(names))], cap)
    known = slim.sparkSession.createDataFrame(pa.table({"_name": pa.array(names, pa.string()), "_s": pa.array(range(len(names)), pa.int32())}))  # at most MAX_SOURCES rows
    placed = lambda df: df.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    cells = placed(cells)
    lam = solve_tilts(cells, sizes, counts, targets, cap)
    mean = [max(1.0, s / max(1, c)) for s, c in zip(sizes, counts)]
    cells = _given(cells, _lam=lam, _mean=mean)
    rate = F.when(F.col("_lam") > 1e8, float(cap)).when(F.col("_lam") < -1e8, 0.0).otherwise(_rate(F.col("_lam"), F.col("size"), F.col("_mean"), cap))
    long_first = Window.partitionBy("_s").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("rate", rate).withColumn("_u", F.round(F.col("n") * F.col("rate") * UNIT).cast("long"))
    cells = cells.withColumn("_end", F.sum("_u").over(long_first))

    def copies(offset: Column) -> Column:
        at = lambda c: F.floor((c + offset) / F.lit(float(UNIT)))
        return at(F.col("_end")) - at(F.col("_end") - F.col("_u"))

    tried = cells.groupBy("_s").agg(*[F.sum(copies(F.lit(round(o * UNIT))) * F.col("size")).alias(f"o{i}") for i, o in enumerate(OFFSETS)]).collect()
    chosen, miss = [0] * len(sizes), [0.0] * len(sizes)
    for s, *took in tried:
        best = min(range(len(OFFSETS)), key=lambda i: (abs(took[i] - targets[s]), i))
        chosen[s], miss[s] = round(OFFSETS[best] * UNIT), targets[s] - took[best]
    cells = _given(cells, _offset=chosen, _miss=miss)
    cells = cells.withColumn("_c", copies(F.col("_offset")))
    room = F.when(F.col("_miss") > 0, cap * F.col("n") - F.col("_c")).otherwise(F.col("_c")) * (F.col("size") > 0).cast("long")
    short_first = Window.partitionBy("_s").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_room", room).withColumn("_used", F.coalesce(F.sum(F.col("_room") * F.col("size")).over(short_first), F.lit(0)))
    more = F.least(F.col("_room"), F.floor(F.greatest(F.lit(0.0), F.abs(F.col("_miss")) - F.col("_used")) / F.greatest(F.col("size"), F.lit(1))))
    cells = cells.withColumn("_c", F.col("_c") + F.signum(F.col("_miss")).cast("long") * more)
    shares = cells.select("_s", "size", F.col("n").alias("_all"), F.col("_c").alias("_copies"), "rate")
    drawn = placed(slim).withColumn("_h", F.xxhash64(F.lit("mix"), "doc_id"))
    ranked = gapless_rank(drawn, ["_s", "size"], ["_h", "doc_id"], parts_for(slim.count(), ROWS_PER_BUCKET), "_rank", shares)
    given = F.floor(F.col("_copies") / F.col("_all")) + (F.col("_rank") < F.col("_copies") % F.col("_all")).cast("long")
    out = _given(ranked, source_size=sizes, target=targets)
    return out.select("doc_id", "source", "size", *carry, "source_size", "target", "rate", given.cast("long").alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as its copies say. Only doc_id, source and
    text are read; all columns are kept, whatever their names."""
    rows, name = hidden(docs)
    doc, source, text = (F.col(name[c]) for c in ("doc_id", "source", "text"))
    # Rows of one document, source and size are told apart by their text, and equal ones by their number.
    mark = F.xxhash64(F.coalesce(text, F.lit("")))
    rows = rows.withColumn("_z", word_count(text)).withColumn("_m", mark)
    plan = mix_plan(rows.select(doc.alias("doc_id"), source.alias("source"), F.col("_z").alias("size"), F.col("_m").alias("mark")), weights, cap, ["mark"])
    # Rows alike in all of these have equal texts: their copies are added up and dealt out again.
    plan = plan.groupBy("doc_id", "source", "size", "mark").agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows")).filter("_all > 0")
    plan = plan.withColumnsRenamed({"doc_id": "_d", "source": "_o", "size": "_s", "mark": "_n"}).select("_d", "_o", "_s", "_n", "_all", "_rows")
    single, several = plan.filter("_rows = 1"), plan.filter("_rows > 1")
    on = lambda p: doc.eqNullSafe(p["_d"]) & source.eqNullSafe(p["_o"]) & (F.col("_z") == p["_s"]) & (F.col("_m") == p["_n"])
    both = rows.join(single, on(single)).withColumn("_k", F.col("_all").cast("int"))
    alike = rows.join(several, on(several))
    turn = F.row_number().over(Window.partitionBy("_d", "_o", "_s", "_n").orderBy(*orderable(rows, name.values()))) - 1
    alike = alike.withColumn("_t", turn).withColumn("_k", (F.floor(F.col("_all") / F.col("_rows")) + (F.col("_t") < F.col("_all") % F.col("_rows")).cast("long")).cast("int")).drop("_t")
    both = both.unionByName(alike).filter("_k > 0")
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_k")))).select(*[F.col(x).alias(c) for c, x in name.items()])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plan = mix_plan(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", "rate")
