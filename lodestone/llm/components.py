"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): long pairs. (id, component) for every id of an edge, component being the smallest
    id it is linked with.

    Alternates large-star and small-star steps, each a grouped minimum and a join: every id hooks its
    larger (smaller) neighbours to the least one. Rounds grow with the logarithm of the longest path;
    each round is written to the scratch folder, nothing goes to the driver but a checksum.
    """
    both = edges.filter("a is not null and b is not null and a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    old: list[str] = []
    pairs, before = materialize(both, "cc", old), None
    while True:
        # Large star: all larger neighbours of u point to the least of u and its neighbours.
        near = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(pairs.select("hi", "lo"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").filter("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo != hi").distinct()
        # Small star: all smaller neighbours of u, and u, point to the least of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("m").alias("x"), F.col("lo").alias("y")).union(low.select("m", "hi"))
        new: list[str] = []
        pairs = materialize(small.filter("x != y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(), "cc", new)
        remove(edges.sparkSession, old)
        old = new
        now = tuple(pairs.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(lo, hi))"), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 30)))).first())
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return pairs.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(roots)
