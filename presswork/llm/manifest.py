"""Merkle manifest of a dataset: a root, and for each row the path that proves it belongs to it.

Rows of a group (a language) in order of their ids are the leaves of a binary tree, the groups' roots in order those of another.
A lone last node of a level is hashed alone. Ranges of the order are sorted by Spark, each row gets its place in its group from
the ranges' sizes, and blocks of 2^bits consecutive rows are reduced at once, each in a task. What remains is one node for each
block. If these are few (`top`, the bound of what the driver holds and broadcasts) the driver builds the tree above them and
broadcasts each block's path to the root; if not, blocks of blocks are reduced first in the same way. Rows finish their paths
by the broadcast and fold them without any shuffle.

Blocks have a fixed number of rows, so a hot group is many blocks. Rows of equal group and id are ordered by their digest; rows
that are equal in all fields have equal digests and either order is the same. Null groups come first, null ids first in
a group. Null fields and empty ones have different digests. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, written

#: Leaves of a block, as a power of two.
BITS = 12
#: Most nodes that the driver takes, builds a tree over and broadcasts.
TOP = 1 << 14

PATH = "array<struct<left:boolean,digest:string>>"
_STEP = pa.struct([("left", pa.bool_()), ("digest", pa.string())])


def digest(*values: Column) -> Column:
    """Hex SHA-256 of values, each as its number of bytes, a colon and itself; `-` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path lead to."""
    step = lambda acc, s: F.sha2(F.when(s["digest"].isNull(), acc).when(s["left"], F.concat(s["digest"], acc)).otherwise(F.concat(acc, s["digest"])), 256)
    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """Hex SHA-256 of a path's siblings, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["digest"]), ""), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(n: int) -> int:
    """Levels above n nodes."""
    return max(n - 1, 0).bit_length()


def _tree(nodes: list[str], levels: int) -> list[list[str]]:
    """All levels, the nodes themselves first."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([_hash("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return out


def _paths(tree: list[list[str]]) -> pa.ListArray:
    """The path of each leaf below the top of the tree, one step a level; a step of a lone node has no digest."""
    n, steps = len(tree[0]), len(tree) - 1
    flat, base = [d for level in tree for d in level] + [None], np.cumsum([0, *map(len, tree)])
    at, left = np.full((n, steps), len(flat) - 1), np.zeros((n, steps), bool)
    for j in range(steps):
        node = np.arange(n) >> j
        other = node ^ 1
        left[:, j] = other < node
        at[:, j] = np.where(other < len(tree[j]), base[j] + other, len(flat) - 1)
    items = pa.StructArray.from_arrays([pa.array(left.ravel()), pa.array(flat, pa.string()).take(pa.array(at.ravel()))], fields=list(_STEP))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * steps, pa.int32()), items)


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `place` (from 0, in the order of the columns within its group) and `n` (rows of the group).

    Sorts ranges, numbers each, and shifts by what the ranges before hold of the group; no group is in one task.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranges = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    ranges = ranges.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    shares = ranges.groupBy("_range", group).agg(F.min("_at").alias("_low"), F.count("*").alias("_size"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select("_range", group, (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_low")).alias("_shift"), F.sum("_size").over(Window.partitionBy(group)).alias("n"))
    return ranges.join(shares, ["_range", group]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def reduced(nodes: DataFrame, bits: int) -> DataFrame:
    """nodes (grp, place, n, digest and others) with `path` within their block, `block`, and the block's digest `above`."""
    with_block = nodes.withColumn("block", F.shiftright("place", bits))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in with_block.schema) + f", path {PATH}, above string"

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        tree = _tree(block["digest"].to_pylist(), min(bits, _levels(block["n"][0].as_py())))
        return block.append_column("path", _paths(tree)).append_column("above", pa.array(tree[-1] * block.num_rows, pa.string()))

    return with_block.groupBy("grp", "block").applyInArrow(run, fields)


def _above(low: DataFrame, bits: int) -> DataFrame:
    """The blocks of reduced nodes as nodes."""
    lead = low.filter(F.col("place") == F.shiftleft("block", bits))
    return lead.select("grp", F.col("block").alias("place"), F.ceil(F.col("n") / F.lit(1 << bits)).cast("long").alias("n"), F.col("above").alias("digest"))


def _on_driver(nodes: DataFrame, grouped: bool) -> DataFrame:
    """Paths to the root for a bounded number of nodes: grp, place, up, subroot, root. Broadcast."""
    groups: dict[str, list[str]] = {}
    for grp, _, value in sorted((r["grp"], r["place"], r["digest"]) for r in nodes.select("grp", "place", "digest").collect()):
        groups.setdefault(grp, []).append(value)
    # Spark orders strings by their bytes, Python by code points: for UTF-8 the same
    trees = {g: _tree(values, _levels(len(values))) for g, values in groups.items()}
    subroots = [t[-1][0] for t in trees.values()]
    last = _tree(subroots, _levels(len(subroots)))
    out = []
    for (grp, tree), subroot, up in zip(trees.items(), subroots, _paths(last).to_pylist() if subroots else [], strict=True):
        out += [(grp, i, own + up, subroot if grouped else None, last[-1][0]) for i, own in enumerate(_paths(tree).to_pylist())]
    return F.broadcast(nodes.sparkSession.createDataFrame(out, f"grp string, place long, up {PATH}, subroot string, root string"))


def _to_root(nodes: DataFrame, bits: int, top: int, grouped: bool = True) -> DataFrame:
    """Paths to the root for any number of nodes (grp, place, n, digest): grp, place, up, subroot, root."""
    if nodes.limit(top + 1).count() <= top:
        return _on_driver(nodes, grouped)
    if grouped and not nodes.filter("n > 1").limit(1).count():  # all are subroots: the tree over these
        order = placed(nodes.select(F.lit("").alias("all"), F.col("grp").alias("of"), "digest"), "all", ["of"])
        order = written(order.select(F.col("all").alias("grp"), "place", "n", "digest", "of"))
        up = _to_root(order, bits, top, grouped=False)
        return order.join(up, ["grp", "place"]).select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("place"), "up", F.col("digest").alias("subroot"), "root")
    low = written(reduced(nodes.select("grp", "place", "n", "digest"), bits))
    up = _to_root(_above(low, bits), bits, top, grouped).withColumnRenamed("place", "block")
    return low.select("grp", "place", "block", "path").join(up, ["grp", "block"]).select("grp", "place", F.concat("path", "up").alias("up"), "subroot", "root")


def prove(leaves: DataFrame, group: str, order: str, bits: int = BITS, top: int = TOP) -> DataFrame:
    """leaves (group and order columns, `leaf` digest, others) with subroot, root and path to the root."""
    own = [c for c in leaves.columns if c != "leaf"]
    box = F.concat(F.when(F.col(group).isNull(), "").otherwise("="), F.coalesce(F.col(group).cast("string"), F.lit("")))
    base = written(leaves.select(box.alias("grp"), F.col(order).alias("key"), F.col("leaf").alias("digest"), F.struct(*own).alias("own")))
    low = written(reduced(placed(base, "grp", ["key", "digest"]), bits))  # digests were taken once, though ranges are sampled first
    dropped(base)
    up = _to_root(_above(low, bits), bits, top).withColumnRenamed("place", "block")
    return low.join(up, ["grp", "block"]).select("own.*", F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "up").alias("path"))
