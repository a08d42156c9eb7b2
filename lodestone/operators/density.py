"""Density clustering of vectors, with outliers: the tree of mutual-reachability distances, cut where clusters
are most stable.

A point's core distance is that to its ``samples``-th nearest other point (cosine distance, six places); two
points are as far apart as the largest of their distance and both core distances. The minimum spanning tree of
these distances is grown in Boruvka rounds: every component takes its least edge to another, from lists of
nearest neighbours as long as these settle it, else from a pass of blocks over the points whose lists do not.
Ties go to the smaller ids, so the tree is the same however the points are dealt out.

The hierarchy is read off the tree's edges by rising length, ``CHUNK`` edges a step: a step's edges are joined
with the components their ends lie in by then and put together in one task, whose memory is the chunk's; the
next step starts from the tables it leaves. Components of fewer than ``least`` points never count: a point
falls out of the first component of ``least`` points that it becomes part of, going up. Clusters, a few a
hundred points at most, are then chosen on the driver by their excess of mass.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from ..sources.scratch import drop_at_exit, folder

#: Neighbours listed for a point beyond those its core distance needs, edges of a step, most clusters in a tree.
MORE_NEIGHBOURS, CHUNK, MOST_CLUSTERS = 10, 1_000_000, 200_000
BLOCK_ROWS = 4096
#: Points on one place are as close as the last place of a distance.
CLOSEST = 1e-6
_EDGE = "id long, lo long, hi long, w double"


class _Place:
    """A scratch folder for the tables of one run."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{folder(spark)}/density-{uuid4().hex}", 0
        drop_at_exit(spark, self.path)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")


def neighbours(points: DataFrame, k: int) -> DataFrame:
    """(id, other, d, rank): the k nearest other points of each, by distance and id; points: (id, v)."""
    from .retrieval import _block_scores, top

    found = top(_block_scores(points, points.withColumnRenamed("id", "query_id"), k + 1, None), k + 1)
    others = found.filter("query_id != doc_id").select(F.col("query_id").alias("id"), F.col("doc_id").alias("other"), F.greatest(F.round(1 - F.col("score"), 6), F.lit(0.0)).alias("d"))
    order = Window.partitionBy("id").orderBy("d", "other")
    return others.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _least_outside(points: DataFrame, asked: DataFrame) -> DataFrame:
    """The least edge (id, lo, hi, w) from each of ``asked`` to a point of another component; both (id, v, core,
    comp). Blocks of either side meet where they lie; a task holds two blocks and returns a row a point."""
    from .retrieval import blocks, matrix, met

    left = blocks(asked.select("id", "v", "core", "comp"), "id", BLOCK_ROWS)
    right = blocks(points.select(*[F.col(c).alias(f"{c}2") for c in ("id", "v", "core", "comp")]), "id2", BLOCK_ROWS)

    def search(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(ask) and len(have):
            have = have.sort_values("id2")
            unit = lambda v: (m := np.stack(v.to_list())) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            x, y, core, ids, comp = unit(ask["v"]), unit(have["v2"]), have["core2"].to_numpy(), have["id2"].to_numpy(), have["comp2"].to_numpy()
            for i in range(0, len(ask), 512):
                part = ask.iloc[i : i + 512]
                d = np.maximum(np.round(1 - np.round(x[i : i + 512] @ y.T, 6), 6), 0.0)
                w = np.maximum(np.maximum(d, core[None, :]), part["core"].to_numpy()[:, None])
                w[part["comp"].to_numpy()[:, None] == comp[None, :]] = np.inf
                best = w.min(axis=1)
                # Of equal lengths the edge with the smallest ids: that to the smallest id.
                other, mine = ids[(w == best[:, None]).argmax(axis=1)], part["id"].to_numpy()
                some = np.isfinite(best)
                out.append(pd.DataFrame({"id": mine, "lo": np.minimum(mine, other), "hi": np.maximum(mine, other), "w": best})[some])
        return pd.concat(out) if out else pd.DataFrame({"id": np.zeros(0, "int64"), "lo": np.zeros(0, "int64"), "hi": np.zeros(0, "int64"), "w": np.zeros(0)})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                side = lambda end: pd.DataFrame({f"{c}{end}": list(matrix(row.column(f"v{end}"))) if c == "v" else row.column(f"{c}{end}")[0].values.to_numpy(zero_copy_only=False) for c in ("id", "v", "core", "comp")})  # noqa: B023, E731
                yield pa.RecordBatch.from_pandas(search(side(""), side("2")), preserve_index=False)

    found = met(left, right).mapInArrow(pairs, _EDGE)
    return found.groupBy("id").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("id", "e.lo", "e.hi", "e.w")


def spanning_tree(points: DataFrame, samples: int, more: int = MORE_NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """(edges (lo, hi, w), points (id, core)) of the mutual-reachability distances; points: (id, v)."""
    spark = points.sparkSession
    ship(spark)
    place = _Place(spark)
    points = place.keep(points.select("id", "v").filter("v is not null"))
    near = place.keep(neighbours(points, samples + more))
    core = place.keep(near.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("rank") == samples, F.col("d"))), F.max("d")).alias("core"), F.max("d").alias("reach"), F.count(F.lit(1)).alias("n")))
    # Distances beyond a full list are no shorter than its last; a list that is not full holds all points.
    core = core.select("id", "core", F.when(F.col("n") < samples + more, F.lit(float("inf"))).otherwise(F.greatest("core", "reach")).alias("bound"))
    other = core.select(F.col("id").alias("other"), F.col("core").alias("core2"))
    lists = place.keep(near.join(core, "id").join(other, "other").select("id", "other", F.greatest("d", "core", "core2").alias("w")))
    labels = place.keep(points.join(core, "id", "left").select("id", F.col("id").alias("comp"), F.coalesce("core", F.lit(0.0)).alias("core"), F.coalesce("bound", F.lit(float("inf"))).alias("bound")))
    tree: list[DataFrame] = []
    left = labels.count()
    while left > 1:
        mine, theirs = labels.select("id", "comp"), labels.select(F.col("id").alias("other"), F.col("comp").alias("comp2"))
        # Edges within a component are done with.
        lists = place.keep(lists.join(mine, "id").join(theirs, "other").filter("comp != comp2"))
        edges = lists.select("comp", F.struct("w", F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi")).alias("e"))
        listed = place.keep(edges.groupBy("comp").agg(F.min("e").alias("e")))
        lists = lists.select("id", "other", "w")
        # A component's listed edge stands unless a point of it may have an unlisted one that is no longer.
        open_ = place.keep(labels.join(listed, "comp", "left").filter(F.col("e").isNull() & (F.col("bound") < float("inf")) | (F.col("bound") <= F.col("e.w"))).select("id", "comp", "core"))
        if open_.isEmpty():
            best = listed
        else:
            full = points.join(labels.select("id", "comp", "core"), "id")
            found = _least_outside(full, points.join(open_, "id")).join(mine, "id").select("comp", F.struct("w", "lo", "hi").alias("e"))
            best = place.keep(listed.unionByName(found).groupBy("comp").agg(F.min("e").alias("e")))
        tree.append(place.keep(best.select("e.lo", "e.hi", "e.w").distinct()))
        # Every component points to one other; of two that point to each other the smaller is the root.
        ends = best.select("comp", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi")).join(mine.select(F.col("id").alias("lo"), F.col("comp").alias("a")), "lo").join(mine.select(F.col("id").alias("hi"), F.col("comp").alias("b")), "hi")
        to = place.keep(ends.select("comp", F.when(F.col("a") == F.col("comp"), F.col("b")).otherwise(F.col("a")).alias("up")))
        back = to.select(F.col("comp").alias("up"), F.col("up").alias("again"))
        to = place.keep(to.join(back, "up", "left").select("comp", F.when((F.col("again") == F.col("comp")) & (F.col("comp") < F.col("up")), F.col("comp")).otherwise(F.col("up")).alias("up")))
        while True:
            jump = to.select(F.col("comp").alias("up"), F.col("up").alias("top"))
            stepped = place.keep(to.join(jump, "up", "left").select("comp", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") != F.col("up")).alias("moved")))
            to = stepped.select("comp", "up")
            if stepped.filter("moved").isEmpty():
                break
        labels = place.keep(labels.join(to, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"), "core", "bound"))
        now = labels.select("comp").distinct().count()
        if now == left:
            break  # nothing is left to join
        left = now
    none = spark.createDataFrame([], "lo long, hi long, w double")
    edges = none
    for part in tree:
        edges = edges.unionByName(part)
    return place.keep(edges.distinct()), labels.select("id", "core")


def _steps(rows: pd.DataFrame, least: int) -> pd.DataFrame:
    """One chunk of edges put together in order. rows: (n, w, a, b, size_a, size_b, in_a, in_b): ends are
    components, with their sizes and clusters (-1: none yet). Returned, by ``kind``: m, a component's new name
    (x -> y) with the size and cluster of the whole; e, a small component x that enters cluster y at w; c, a
    cluster x of size ``size`` that is part of y from w on."""
    up: dict[int, int] = {}
    size: dict[int, int] = {}
    inside: dict[int, int] = {}
    waiting: dict[int, list[int]] = {}
    out: list[tuple] = []

    def root(x: int) -> int:
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for n, w, a, b, sa, sb, ca, cb in rows.sort_values("n").itertuples(index=False):
        for x, s, c in ((a, sa, ca), (b, sb, cb)):
            if x not in up:
                up[x], size[x], inside[x] = x, s, c
                waiting[x] = [x] if c < 0 else []
        x, y = root(a), root(b)
        whole = size[x] + size[y]
        if inside[x] >= 0 and inside[y] >= 0:  # two clusters make a third
            out += [("c", inside[x], n, w, size[x]), ("c", inside[y], n, w, size[y])]
            now = n
        elif inside[x] < 0 and inside[y] < 0:
            now = n if whole >= least else -1
        else:
            now = max(inside[x], inside[y])
        held = waiting.pop(x) + waiting.pop(y)
        if now >= 0:
            out += [("e", z, now, w, 0) for z in held]
            held = []
        keep, gone = (x, y) if size[x] >= size[y] else (y, x)
        up[gone], size[keep], inside[keep], waiting[keep] = keep, whole, now, held
    for x in up:
        top = root(x)
        out.append(("m", x, top, float(inside[top]), size[top]))
    return pd.DataFrame(out, columns=["kind", "x", "y", "w", "size"])


def hierarchy(edges: DataFrame, points: DataFrame, least: int, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(entries (id, cluster, w), clusters (cluster, parent, w, size)) of a spanning tree's edges (lo, hi, w) over
    points (id): the cluster each point is part of first and from which length on, and the cluster each is
    part of next. Points that never meet ``least`` others have no entry."""
    spark = edges.sparkSession
    place = _Place(spark)
    total = edges.count()
    order = [F.col("w"), F.col("lo"), F.col("hi")]
    parts = max(1, -(-total // chunk))
    dealt = place.keep(edges.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("lo", "hi", "w", F.monotonically_increasing_id().alias("_id")))
    starts = dealt.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.min("_id").alias("_from"), F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("_part", "_from", before.alias("_before"))  # a row a chunk
    ranked = place.keep(dealt.withColumn("_part", F.shiftright("_id", 33)).join(starts, "_part").select("_part", "lo", "hi", "w", (F.col("_id") - F.col("_from") + F.col("_before")).alias("n")))
    comps = place.keep(points.select("id", F.col("id").alias("comp")))
    states = place.keep(points.select(F.col("id").alias("comp"), F.lit(1).cast("long").alias("size"), F.lit(-1).cast("long").alias("inside")))
    entries, clusters = [], []
    for (part,) in ranked.select("_part").distinct().orderBy("_part").collect():
        end = lambda x, c: comps.join(states, "comp").select(F.col("id").alias(x), F.col("comp").alias(c), F.col("size").alias(f"size_{c}"), F.col("inside").alias(f"in_{c}"))
        mine = ranked.filter(F.col("_part") == part).join(end("lo", "a"), "lo").join(end("hi", "b"), "hi")
        mine = mine.select("n", "w", "a", "b", "size_a", "size_b", "in_a", "in_b")
        done = place.keep(mine.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(lambda rows: _steps(rows.drop(columns="_one"), least), "kind string, x long, y long, w double, size long"))
        entered = done.filter("kind = 'e'").select(F.col("x").alias("comp"), F.col("y").alias("cluster"), "w")
        entries.append(place.keep(comps.join(entered, "comp").select("id", "cluster", "w")))
        clusters.append(done.filter("kind = 'c'").select(F.col("x").alias("cluster"), F.col("y").alias("parent"), "w", "size"))
        moved = done.filter("kind = 'm'").select(F.col("x").alias("comp"), F.col("y").alias("to"), F.col("size").alias("_s"), F.col("w").cast("long").alias("_i"))
        comps = place.keep(comps.join(moved.select("comp", "to"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))
        tops = moved.select(F.col("to").alias("comp"), F.col("_s").alias("size"), F.col("_i").alias("inside")).distinct()
        states = place.keep(states.join(moved.select("comp"), "comp", "left_anti").unionByName(tops))
    union = lambda dfs, ddl: spark.createDataFrame([], ddl) if not dfs else dfs[0] if len(dfs) == 1 else union(dfs[:-1], ddl).unionByName(dfs[-1])
    return union(entries, "id long, cluster long, w double"), union(clusters, "cluster long, parent long, w double, size long")


def nearness(w: Column) -> Column:
    return 1 / F.greatest(w, F.lit(CLOSEST))


def density_topics(points: DataFrame, least: int = 10, samples: int = 5, more: int = MORE_NEIGHBOURS, chunk: int = CHUNK) -> DataFrame:
    """(id, topic, topic_probability) of points (id, v): -1 with probability 0 for outliers. Topics are numbered
    by falling size, then by their smallest id. A cluster is chosen if it is more stable than the best
    choice among its parts; the whole tree is never a cluster. Points without a vector take no part."""
    spark = points.sparkSession
    edges, cores = spanning_tree(points, samples, more)
    entries, clusters = hierarchy(edges, cores, least, chunk)
    place = _Place(spark)
    entries, clusters = place.keep(entries), place.keep(clusters)
    fallen = entries.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(nearness(F.col("w"))).alias("mass"))
    n = fallen.count()
    if n > MOST_CLUSTERS:
        raise ValueError(f"{n} clusters; at most {MOST_CLUSTERS} are chosen from: raise the least size")
    chosen = choose({r.cluster: (r.n, r.mass) for r in fallen.collect()}, [tuple(r) for r in clusters.collect()])
    at = spark.createDataFrame(list(chosen.items()), "cluster long, chosen long")
    rows = place.keep(entries.join(at, "cluster").select("id", "chosen", nearness(F.col("w")).alias("near")))
    sizes = rows.groupBy("chosen").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"), F.max("near").alias("most"))
    named = sizes.withColumn("topic", (F.row_number().over(Window.orderBy(F.desc("size"), "first")) - 1).cast("int"))
    inside = rows.join(named, "chosen").select("id", "topic", F.round(F.col("near") / F.col("most"), 6).alias("topic_probability"))
    out = cores.select("id").join(inside, "id", "left")
    return out.select("id", F.coalesce("topic", F.lit(-1)).alias("topic"), F.coalesce("topic_probability", F.lit(0.0)).alias("topic_probability"))


def choose(fallen: dict[int, tuple[int, float]], parts: list[tuple[int, int, float, int]]) -> dict[int, int]:
    """The chosen cluster that each cluster lies in, of those that lie in one. fallen: points that fall out of
    a cluster itself and the sum of their nearness; parts: (cluster, parent, w, size)."""
    birth = {c: 1 / max(w, CLOSEST) for c, _, w, _ in parts}
    children: dict[int, list[tuple[int, int]]] = {}
    for c, parent, _, size in parts:
        children.setdefault(parent, []).append((c, size))
    every = sorted({*birth, *children, *fallen})  # a cluster's number is larger than its parts'
    stable: dict[int, float] = {}
    own: dict[int, bool] = {}
    for c in every:
        n, mass = fallen.get(c, (0, 0.0))
        inner = children.get(c, [])
        here = mass + sum(size * birth[x] for x, size in inner) - (n + sum(size for _, size in inner)) * birth.get(c, 0.0)
        best = sum(stable[x] for x, _ in inner)
        own[c] = c in birth and (not inner or round(here, 6) >= round(best, 6))
        stable[c] = here if own[c] else best
    out: dict[int, int] = {}
    parent = {c: p for c, p, _, _ in parts}
    for c in reversed(every):
        if (up := out.get(parent.get(c, -1))) is not None:
            out[c] = up
        elif own[c]:
            out[c] = c
    return out
