"""A Merkle manifest of a dataset: one hash tree a group of rows, one over the groups' roots.

A row's leaf is the SHA-256 of its columns; in a group, ordered by key, every ``FANOUT`` consecutive nodes
become the hash of their hex digests, level by level, until one node, the group's subroot, is left.
Subroots, ordered by group, likewise give the root. A row's proof is the list of the other members of its
runs, from its leaf up to the root.

Trees are built in aligned blocks of ``FANOUT ** DEPTH`` nodes. A block is one row of a table: its digests lie in one
contiguous matrix whose rows are 64-byte hex nodes; a level up is that matrix reshaped to runs of ``FANOUT``
nodes and each run hashed; every sibling is found by arithmetic on a node's number. Blocks' nodes are the
leaves of the blocks above them, so the rounds grow with the logarithm of the rows and no task holds more
than a block. Proofs come back down: what stands above a block is a few numbers and digests, joined to it.

Defined results: null columns are written ``-``; a null group is a group and comes first, groups are ordered
by their UTF-8 bytes; a null key comes first, rows of one key are ordered by their leaves, equal rows each
have a leaf; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, parts_for, ship, table

FANOUT, DEPTH = 8, 4


class Shape(NamedTuple):
    """Nodes of a run, and levels of a block."""

    fanout: int = FANOUT
    depth: int = DEPTH

    @property
    def block(self) -> int:
        return self.fanout**self.depth


#: Rows of a range that one task sorts, when leaves are numbered.
RANGE_ROWS = 100_000
#: What stands above a node, level by level: its slot in its run and the run's other members.
_ABOVE = "array<struct<slot:int,siblings:binary>>"
_ABOVE_ARROW = pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.binary())]))


def field(value: Column) -> Column:
    """A column as the leaf takes it: its UTF-8 length, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """SHA-256 of a row's columns, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def numbered(leaves: DataFrame, group: str, key: str) -> DataFrame:
    """leaves (group, key, leaf, ...) with ``pos``, their number in the group by key, and ``nodes``, the
    group's size. Ranges of (group, key, all other columns) are sorted apart and shifted by the rows of the
    group before them; equal rows are counted first and dealt apart, so no key, however frequent, meets in one task."""
    cols = [group, key, *[c for c in leaves.columns if c not in (group, key)]]
    counted = leaves.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    each = counted.select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy"))
    order = [F.col(c).asc_nulls_first() for c in [*cols, "_copy"]]
    dealt = each.repartitionByRange(parts_for(leaves.count(), RANGE_ROWS), *order).sortWithinPartitions(*order)
    # The number holds the partition above bit 33 and the row's place in it below.
    placed = materialize(dealt.select(*cols, F.monotonically_increasing_id().alias("_id")), "merkle-leaves")
    ranges = placed.groupBy(group, F.shiftright("_id", 33).alias("_part")).agg(F.min("_id").alias("_from"), F.count(F.lit(1)).alias("_rows"))
    before, whole = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(group)
    starts = ranges.select(F.col(group).alias("_group"), "_part", "_from", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("nodes"))
    same = placed[group].eqNullSafe(starts["_group"]) & (F.shiftright(placed["_id"], 33) == starts["_part"])
    return placed.join(starts, same).select(*cols, (F.col("_id") - F.col("_from") + F.col("_before")).alias("pos"), "nodes")


# A block's digests.


def up(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The level above a matrix of 64-byte nodes; the last run may be shorter."""
    full = len(nodes) // fanout * fanout
    runs = [*np.ascontiguousarray(nodes[:full]).reshape(-1, fanout * 64), *([nodes[full:].reshape(-1)] if full < len(nodes) else [])]
    return rows_of(hashlib.sha256(r).hexdigest() for r in runs)


def levels(nodes: np.ndarray, alone: bool, shape: Shape) -> list[np.ndarray]:
    """All levels of a block, from its nodes to its root. A block that is ``alone`` in its tree stops at
    one node; others go up by the block's levels, as their neighbours do."""
    out = [nodes]
    while len(out[-1]) > 1 if alone else len(out) <= shape.depth:
        out.append(up(out[-1], shape.fanout))
    return out


def rows_of(digests: Iterable[str]) -> np.ndarray:
    return np.frombuffer("".join(digests).encode(), dtype=np.uint8).reshape(-1, 64)


def paths(held: list[np.ndarray], which: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the nodes ``which``: their runs (nodes, levels, fanout, 64), and (levels, nodes) each one's slot in
    its run and the run's size. A node's number gives its run on every level."""
    runs, slots, sizes = np.zeros((len(which), len(held) - 1, fanout, 64), np.uint8), np.zeros((len(held) - 1, len(which)), int), np.zeros((len(held) - 1, len(which)), int)
    for k, level in enumerate(held[:-1]):
        at = which // fanout**k
        start = at // fanout * fanout
        slots[k], sizes[k] = at - start, np.minimum(fanout, len(level) - start)
        runs[:, k] = level[np.minimum(start[:, None] + np.arange(fanout), len(level) - 1)]
    return runs, slots, sizes


def matrix(digests: bytes) -> np.ndarray:
    """32-byte digests as a contiguous matrix of hex nodes."""
    return np.frombuffer(digests.hex().encode(), dtype=np.uint8).reshape(-1, 64)


def blocked(nodes: DataFrame, shape: Shape) -> DataFrame:
    """(tree, block, nodes, <others>, digests, root) of nodes (tree, pos, nodes, digest, <others>): one row a
    block, its nodes' digests and other columns in order."""
    others = [c for c in nodes.columns if c not in ("tree", "pos", "nodes", "digest")]
    listed = nodes.groupBy("tree", F.expr(f"pos div {shape.block}").alias("block"), "nodes").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", *others))).alias("_d"))
    listed = listed.select("tree", "block", "nodes", *[F.col(f"_d.{c}").alias(c) for c in others], F.col("_d.digest").alias("digests"))
    kinds = {f.name: f.dataType.simpleString() for f in listed.schema}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                data = b"".join(row.column("digests")[0].as_py())
                root = bytes.fromhex(levels(matrix(data), row.column("nodes")[0].as_py() <= shape.block, shape)[-1][0].tobytes().decode())
                yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([data], pa.binary()), pa.array([root], pa.binary())], [*row.schema.names, "root"])

    return listed.mapInArrow(solve, ", ".join(f"`{c}` {'binary' if c == 'digests' else kinds[c]}" for c in listed.columns) + ", root binary")


def grow(nodes: DataFrame, name: str, shape: Shape) -> list[DataFrame]:
    """Tables of blocks, from the leaves' up to the one whose blocks are whole trees."""
    out = []
    while True:
        out.append(materialize(blocked(nodes, shape), name))
        if out[-1].filter("block > 0").isEmpty():
            return out
        nodes = out[-1].select("tree", F.col("block").alias("pos"), F.expr(f"(nodes + {shape.block} - 1) div {shape.block}").alias("nodes"), F.col("root").alias("digest"))


def joined(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """blocks with the row of ``above`` (tree, block, ...) for each."""
    other = above.withColumnsRenamed({"tree": "_tree", "block": "_block"})
    return blocks.join(other, blocks["tree"].eqNullSafe(other["_tree"]) & (blocks["block"] == other["_block"])).drop("_tree", "_block")


def nodes_with_proofs(blocks: DataFrame, shape: Shape) -> DataFrame:
    """(tree, pos, above, <others>) of every node of blocks (tree, block, nodes, digests, above, <others>)."""
    others = [c for c in blocks.columns if c not in ("tree", "block", "nodes", "digests", "root", "above")]
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                held = levels(matrix(row.column("digests")[0].as_py()), row.column("nodes")[0].as_py() <= shape.block, shape)
                above, first = row.column("above")[0].as_py(), row.column("block")[0].as_py() * shape.block
                for a in range(0, len(held[0]), 512):
                    which = np.arange(a, min(a + 512, len(held[0])))
                    runs, slots, sizes = paths(held, which, shape.fanout)
                    own = [[{"slot": int(slots[k][j]), "siblings": np.delete(runs[j, k, : sizes[k][j]], slots[k][j], axis=0).tobytes()} for k in range(len(slots))] + above for j in range(len(which))]
                    pick = pa.array([0] * len(which))
                    yield pa.RecordBatch.from_arrays([row.column("tree").take(pick), pa.array(first + which, pa.int64()), pa.array(own, _ABOVE_ARROW), *(row.column(c).take(pick) for c in others)], ["tree", "pos", "above", *others])

    return blocks.mapInArrow(solve, ", ".join([f"tree {kinds['tree']}", "pos long", f"above {_ABOVE}", *(f"`{c}` {kinds[c]}" for c in others)]))


def proven(tables: list[DataFrame], top: DataFrame, shape: Shape) -> DataFrame:
    """The lowest blocks with what stands above each; ``top`` (tree, above, ...) stands above the trees' roots."""
    above = top.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tables[1:]):
        above = nodes_with_proofs(joined(blocks, above), shape).withColumnRenamed("pos", "block")
    return joined(tables[0], above)


def verified(blocks: DataFrame, shape: Shape) -> DataFrame:
    """(tree, key, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf of blocks (tree, block,
    nodes, keys, hands, digests, above, subroot, whole)."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    names = ["tree", "key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                held = levels(matrix(row.column("digests")[0].as_py()), row.column("nodes")[0].as_py() <= shape.block, shape)
                given, keys = matrix(b"".join(row.column("at_hand")[0].as_py())), row.column("key").flatten()
                above, subroot, whole = (row.column(c)[0].as_py() for c in ("above", "subroot", "whole"))
                tail = b"".join(x["siblings"] for x in above)
                for a in range(0, len(given), 512):
                    which = np.arange(a, min(a + 512, len(given)))
                    runs, slots, sizes = paths(held, which, shape.fanout)
                    own = (np.arange(shape.fanout) < sizes.T[:, :, None]) & (np.arange(shape.fanout) != slots.T[:, :, None])
                    proof = [hashlib.sha256(runs[j][own[j]].tobytes() + tail).hexdigest() for j in range(len(which))]
                    node = given[which]
                    for k in range(len(slots)):
                        run = runs[:, k].copy()
                        run[np.arange(len(which)), slots[k]] = node
                        node = rows_of(hashlib.sha256(r[:n]).hexdigest() for r, n in zip(run.reshape(len(which), -1), (sizes[k] * 64).tolist()))
                    folded = [r.tobytes() for r in node]
                    for x in above:
                        left, right = x["siblings"][: x["slot"] * 64], x["siblings"][x["slot"] * 64 :]
                        folded = [hashlib.sha256(left + r + right).hexdigest().encode() for r in folded]
                    folded = [f.decode() for f in folded]
                    pick, root = pa.array([0] * len(which)), whole.hex()
                    arrays = [row.column("tree").take(pick), keys.slice(a, len(which)), pa.array([r.tobytes().decode() for r in held[0][which]]), pa.array([subroot.hex()] * len(which)), pa.array([root] * len(which)), pa.array(proof), pa.array(folded), pa.array([f == root for f in folded])]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    key = kinds["key"].removeprefix("array<").removesuffix(">")
    return blocks.mapInArrow(solve, f"tree {kinds['tree']}, key {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(leaves: DataFrame, group: str, key: str, shape: Shape = Shape()) -> DataFrame:
    """(group, key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of leaves (group,
    key, leaf, at_hand), digests of 32 bytes: ``at_hand`` is the leaf of the row as it is found now, folded up
    through the manifest's siblings; the row is verified if that gives the manifest's root."""
    ship(leaves.sparkSession)
    rows = numbered(leaves.select(group, key, "leaf", "at_hand"), group, key)
    trees = grow(rows.select(F.col(group).alias("tree"), "pos", "nodes", F.col("leaf").alias("digest"), F.col(key).alias("key"), "at_hand"), "merkle-blocks", shape)
    # The tree of the groups' roots: its leaves are numbered like rows.
    order = numbered(trees[-1].select(F.lit(0).alias("forest"), F.col("tree").alias("member"), F.col("root").alias("subroot")), "forest", "member")
    forest = grow(order.select(F.col("forest").alias("tree"), "pos", "nodes", F.col("subroot").alias("digest"), "member", "subroot"), "merkle-forest", shape)
    top = forest[-1].select("tree", F.expr(f"CAST(array() AS {_ABOVE})").alias("above"), F.col("root").alias("whole"))
    over = proven(forest, top, shape)
    members = over.select("tree", "block", F.posexplode(F.arrays_zip("member", "subroot")).alias("i", "m")).select("tree", (F.col("block") * shape.block + F.col("i")).alias("pos"), "m.member", "m.subroot")
    tops = nodes_with_proofs(over.drop("member", "subroot"), shape).join(members, ["tree", "pos"]).select(F.col("member").alias("tree"), "above", "subroot", "whole")
    return verified(proven(trees, materialize(tops, "merkle-tops"), shape), shape).withColumnsRenamed({"tree": group, "key": key})


#: Columns of a document that its leaf covers, in order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*LEAF)
    leaf = leaf_of(*[F.col(c) for c in LEAF])
    upper = "".join(map(chr, range(65, 91)))
    lowered = leaf_of(*[F.translate("text", upper, upper.lower()) if c == "text" else F.col(c) for c in LEAF])
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    out = manifest(docs.select("lang", "doc_id", leaf.alias("leaf"), F.when(tampered, lowered).otherwise(leaf).alias("at_hand")), "lang", "doc_id")
    return out.drop("lang")


def _sql() -> str:
    field_ = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field_(text if c == "text" else c) for c in LEAF) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))"
    tree = lambda name, leaves: f"""{name} AS (SELECT 0 AS k, tree, pos, node FROM {leaves} UNION ALL
  SELECT k, tree, pos, sha256(string_agg(node, '' ORDER BY was)) FROM (SELECT k + 1 AS k, tree, pos // 8 AS pos, pos AS was, node, count(*) OVER (PARTITION BY tree) AS n FROM {name}) WHERE n > 1 GROUP BY k, tree, pos)"""  # noqa: E731
    runs = lambda name, leaves, step: f"""SELECT x.id, {step} + l.k AS k, coalesce(string_agg(l.node, '' ORDER BY l.pos) FILTER (l.pos < x.pos // CAST(8 ** l.k AS BIGINT)), '') AS a, coalesce(string_agg(l.node, '' ORDER BY l.pos) FILTER (l.pos > x.pos // CAST(8 ** l.k AS BIGINT)), '') AS b
  FROM {leaves} x JOIN {name} l ON l.tree IS NOT DISTINCT FROM x.tree AND l.pos // 8 = x.pos // CAST(8 ** (l.k + 1) AS BIGINT) AND l.k < (SELECT max(k) FROM {name} m WHERE m.tree IS NOT DISTINCT FROM x.tree) GROUP BY x.id, l.k"""  # noqa: E731
    return f"""WITH RECURSIVE steps AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8)::BIGINT[], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(3988292384::BIGINT, x >> 1) ELSE x >> 1 END) AS c FROM range(256) r(i))),
raw AS (SELECT doc_id, lang AS tree, {leaf("text")} AS node, CASE WHEN xor(4294967295::BIGINT, {crc}) % 3 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS hand FROM documents, steps),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node, hand) - 1 AS pos, row_number() OVER () AS id FROM raw),
{tree("lv", "leaves")},
subs AS (SELECT tree AS lang, node, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS pos, 0 AS tree, row_number() OVER () AS id FROM (SELECT * FROM lv QUALIFY row_number() OVER (PARTITION BY tree ORDER BY k DESC) = 1)),
{tree("tp", "subs")},
low AS ({runs("lv", "leaves", 0)}), high AS ({runs("tp", "subs", 1000)}),
parts AS (SELECT * FROM low UNION ALL SELECT x.id, h.k, a, b FROM leaves x JOIN subs s ON s.lang IS NOT DISTINCT FROM x.tree JOIN high h ON h.id = s.id),
per AS (SELECT id, string_agg(a || b, '' ORDER BY k) AS proof, list(a || '|' || b ORDER BY k) AS steps FROM parts GROUP BY id),
done AS (SELECT x.doc_id, x.node AS leaf, s.node AS subroot, (SELECT node FROM tp ORDER BY k DESC LIMIT 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce([hand] || coalesce(steps, []), lambda acc, y: sha256(string_split(y, '|')[1] || acc || string_split(y, '|')[2])) AS folded_root
  FROM leaves x JOIN subs s ON s.lang IS NOT DISTINCT FROM x.tree LEFT JOIN per ON per.id = x.id)
SELECT *, folded_root = root AS verified FROM done"""


#: The whole manifest in SQL: CRC-32 of doc_ids by a table, trees by recursion, proofs folded as lists.
OP12_SQL = _sql()
