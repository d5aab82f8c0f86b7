"""Merkle manifest of a dataset with nested-interval labels.

Every row is a leaf: the digest of its fields. Within a group (a source) leaves stand in order of
their id and form a tree: `fanout` consecutive nodes have a parent, the last run perhaps fewer,
until one node, the subroot, remains. The groups' subroots, in order of the group, form a tree in
the same way, whose root stands for the dataset.

A node carries the interval [lo, hi) of the leaf ranks below it. Levels are taken in bands: all
nodes of a band of levels that lie below one node of the band's top are a bucket, keyed by group
and lo / fanout^levels, of at most 1.5 * fanout^band nodes, however large the group. Building goes
up band by band, a bucket's top nodes being the leaves of the next band. Proofs go down: a bucket
is joined with the proof of its top node, and in it each node's parent is the one whose interval
contains its own, and its siblings are the nodes in what is left of the parent's interval. So each
row is shuffled once or twice with its digest, not once a level, and no task holds more than
buckets; texts are read once and never shuffled. Ranks come from a range partitioning and the
sizes of its parts; the parts of a group, not its rows, pass through one window.

Fields that are null count as `-`, others as their UTF-8 length, a colon and the value. A null
group is a group of its own, before the others; null ids come first, and rows of one id stand in
the order of their digests, so equal rows are interchangeable. Long texts are hashed whole. An
empty table has no leaves and no root. Columns not named play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgraph.llm.common import Scratch, shuffle_partitions

NODE = "nodes array<struct<level int, lo long, hi long, digest string>>"
PATH = "path array<struct<left string, right string>>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 over the fields, each with its length."""

    def one(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*map(one, fields)), 256)


def proof_digest(path: Column) -> Column:
    """SHA-256 of a proof's sibling digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf has by its proof."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def ranked(rows: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Rows (tree, id, digest, member) with `lo`, the rank in their tree, and `size`, its number of rows."""
    order = ("tree", F.asc_nulls_first("id"), "digest")
    spread = rows.repartitionByRange(shuffle_partitions(scratch.spark), *order).sortWithinPartitions(*order)
    placed = scratch.save(spread.select("tree", "digest", "member", F.monotonically_increasing_id().alias("at")), f"{label}_placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = scratch.save(parts.select("tree", "part", (F.col("first") - before).alias("zero"), F.sum("n").over(tree).alias("size")), f"{label}_parts")
    return placed.join(parts, ["tree", "part"]).select("tree", "size", (F.col("at") - F.col("zero")).alias("lo"), "digest", "member")


def _levels(fanout: int, band: int, base: int):
    """Adds the nodes over a bucket's lowest ones, level by level, as long as the tree has more than one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            level, lo, hi, digest, offsets = [], [], [], [], [0]
            bounds = b.column(3).offsets.to_numpy() - b.column(3).offsets[0].as_py()
            flat = b.column(3).flatten()
            los, his, digests = flat.field(0).to_numpy(), flat.field(1).to_numpy(), flat.field(2).to_pylist()
            for row, size in enumerate(b.column(1).to_pylist()):
                own = slice(bounds[row], bounds[row + 1])
                below = (los[own].tolist(), his[own].tolist(), digests[own])
                at, width = base, fanout**base
                while True:
                    level += [at] * len(below[0])
                    lo += below[0]
                    hi += below[1]
                    digest += below[2]
                    if width >= size or at == base + band:
                        break
                    runs = [slice(i, i + fanout) for i in range(0, len(below[0]), fanout)]
                    below = ([below[0][r.start] for r in runs], [below[1][r][-1] for r in runs], [hashlib.sha256("".join(below[2][r]).encode()).hexdigest() for r in runs])
                    at, width = at + 1, width * fanout
                offsets.append(len(level))
            nodes = pa.StructArray.from_arrays([pa.array(level, pa.int32()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(digest, pa.string())], ["level", "lo", "hi", "digest"])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes), b.column(4)], ["tree", "size", "bucket", "nodes", "members"])

    return run


def build(items: DataFrame, scratch: Scratch, label: str, fanout: int, band: int) -> list[DataFrame]:
    """Buckets (tree, size, bucket, nodes, members) of each band, the lowest first; items are rows (tree, size, lo, digest, member)."""
    bands: list[DataFrame] = []
    kind = dict(items.dtypes)["member"]
    rows = items.withColumn("hi", F.col("lo") + 1)
    while True:
        base = band * len(bands)
        cell = F.expr(f"lo div {fanout ** (base + band)}L")
        node = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest", "member")))
        held = rows.groupBy("tree", "size", cell.alias("bucket")).agg(node.alias("n"))
        held = held.select("tree", "size", "bucket", F.transform("n", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest"))).alias("n"), F.col("n.member").alias("members"))
        done = held.mapInArrow(_levels(fanout, band, base), f"tree string, size long, bucket long, {NODE}, members array<{kind}>")
        bands.append(scratch.save(done, f"{label}{len(bands)}"))
        top = F.element_at("nodes", -1)
        rows = bands[-1].filter(F.col("size") > fanout ** (base + band)).select("tree", "size", top["lo"].alias("lo"), top["hi"].alias("hi"), top["digest"].alias("digest"), F.lit(None).cast(kind).alias("member"))
        if rows.isEmpty():
            return bands


def _attach(base: int):
    """For the lowest nodes of buckets: their siblings up to the bucket's top, then the top's own proof."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(len(b)):
                tree, _, nodes, members, above, top, root = (b.column(i)[row] for i in range(7))
                level, lo, hi = (nodes.values.field(k).to_numpy() for k in range(3))
                digests = nodes.values.field(3).to_pylist()
                cuts = np.flatnonzero(np.diff(level)) + 1
                bounds = [0, *cuts.tolist(), len(level)]
                # the proof of the top node, then of each level below it
                paths = [[(x["left"], x["right"]) for x in above.as_py()]]
                for i, j, k in zip(bounds[-3::-1], bounds[-2::-1], bounds[:0:-1], strict=False):
                    child_lo, child_hi = lo[i:j], hi[i:j]
                    parent = np.searchsorted(lo[j:k], child_lo, side="right") - 1
                    if (hi[j:k][parent] < child_hi).any():
                        raise ValueError("a node lies in no interval of the level above")
                    # what a node leaves of its parent's interval: before its own start, and from its own end
                    first = np.searchsorted(child_lo, lo[j:k][parent]).tolist()
                    last = np.searchsorted(child_lo, hi[j:k][parent]).tolist()
                    own = digests[i:j]
                    paths = [[("".join(own[f:n]), "".join(own[n + 1 : e])), *paths[p]] for n, (f, e, p) in enumerate(zip(first, last, parent.tolist(), strict=True))]
                n = len(paths)
                flat = [x for p in paths for x in p]
                steps = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string())], ["left", "right"])
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tree.as_py()] * n, pa.string()), pa.array(lo[:n]), pa.array(digests[:n], pa.string()), members.values,
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps), pa.array([top.as_py() or digests[-1]] * n, pa.string()), pa.array([root.as_py()] * n, pa.string()),
                    ],
                    ["tree", "lo", "digest", "member", "path", "top", "root"],
                )

    return run


def attach(bands: list[DataFrame], above: DataFrame | None, scratch: Scratch, label: str, fanout: int, band: int) -> DataFrame:
    """Rows (tree, lo, digest, member, path, top, root) of the leaves; above has (tree, path, root) of each tree's top."""
    kind = dict(bands[0].dtypes)["members"].removeprefix("array<").removesuffix(">")
    lower = None
    for b in range(len(bands) - 1, -1, -1):
        rows = bands[b].select("tree", "bucket", "nodes", "members", "size")
        whole = F.col("size") <= fanout ** (band * (b + 1))
        tops = rows.filter(whole)
        if above is None:
            tops = tops.select("*", F.array().cast(PATH.removeprefix("path ")).alias("path"), F.lit(None).cast("string").alias("root"))
        else:
            tops = tops.join(above.select("tree", "path", "root"), "tree")
        columns = ("tree", "bucket", "nodes", "members", "path", "top", "root")
        tops = tops.withColumn("top", F.lit(None).cast("string")).select(*columns)
        if lower is not None:
            tops = tops.unionByName(rows.filter(~whole).join(lower, ["tree", "bucket"]).select(*columns))
        out = tops.mapInArrow(_attach(band * b), f"tree string, lo long, digest string, member {kind}, {PATH}, top string, root string")
        if b:
            cell = F.expr(f"lo div {fanout ** (band * b)}L").alias("bucket")
            lower = scratch.save(out.select("tree", cell, "path", "top", "root"), f"{label}_paths{b}")
    return out


class Manifest:
    """The trees over a table: leaves and nodes, and a proof for each leaf."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), carry: dict[str, Column] | None = None, fanout: int = 3, band: int = 6):
        """`carry` names further values of a row that stay with its leaf, such as another digest to be checked."""
        self.scratch, self.fanout, self.band = Scratch(docs.sparkSession, "merkle"), fanout, band
        carried = [v.alias(k) for k, v in (carry or {}).items()]
        # a group's name as a key that sorts as it does, null before the others
        tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
        rows = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf_digest([F.col(c) for c in fields]).alias("digest"), F.struct(F.col(id_col).alias("id"), *carried).alias("member"))
        self.bands = build(ranked(rows, self.scratch, "leaves"), self.scratch, "docs", fanout, band)
        tops = self.nodes().filter(F.col("is_top")).select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest", F.struct(F.col("tree").alias("tree")).alias("member"))
        self.forest = build(ranked(tops, self.scratch, "groups"), self.scratch, "forest", fanout, band)

    def nodes(self) -> DataFrame:
        """Rows (tree, level, lo, hi, digest, is_top) of all nodes of the groups' trees, leaves included; tree is the group after `=`, or empty for null."""
        out = None
        for b, rows in enumerate(self.bands):
            each = rows.select("tree", "size", F.explode("nodes").alias("n")).select("tree", "n.*", ((F.col("n.lo") == 0) & (F.col("n.hi") == F.col("size"))).alias("is_top"), "size")
            # a bucket's top is the next band's lowest level as well; a lone leaf is its tree's top
            each = each.filter((F.col("level") < self.band * (b + 1)) | (F.col("size") <= self.fanout ** (self.band * (b + 1)))).drop("size")
            out = each if out is None else out.unionByName(each)
        return out

    def proofs(self) -> DataFrame:
        """Rows (member, leaf, subroot, root, path): path has, level by level up to the root, the digests left and right of the node, joined."""
        groups = attach(self.forest, None, self.scratch, "forest", self.fanout, self.band)
        above = self.scratch.save(groups.select(F.col("member.tree").alias("tree"), "path", F.col("top").alias("root")), "above")
        rows = attach(self.bands, above, self.scratch, "docs", self.fanout, self.band)
        return rows.select("member", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", "path")
