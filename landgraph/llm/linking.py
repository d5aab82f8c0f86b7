"""Components of the links between members of hash buckets, without all pairs of a bucket.

Links join members of a weighted Jaccard similarity of `threshold` at least. In the first
round a bucket's smallest member is its pivot and is scored against the others. Scores at or
over the threshold are links; the components of all links so far label the members. From then
on a bucket is worked on only while its members have several labels: some members outside its
commonest label are pivots, each scored against every member of another label, and leave the
bucket. Two members of one label need no score of their own, and two of different labels are
always scored or ruled out before the last pivot has left, so the components are those of all
pairs; a large group of near copies costs about one score for each member.

Exact bounds rule pairs out unscored. The shared weight of two members is at most the lesser
one's weight, and in large buckets at most the weight of those features that a member has in
common with any other member still at work: near copies whose edits are their own are far from
each other by that bound, however much of the original they share. Each member also has a
profile, the weight of its features in each of 256 hash classes, rounded up to a byte, and one for
joins, exact but of `classes` classes: the sum of two profiles' minima bounds the shared weight of a
pair from above. Pivots and members meet under the latter bound, so that what is not alike is no pair at all;
only pairs that pass the fine one meet their texts. Texts lie in buckets of the member, so a pair moves one text, once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgraph.llm.common import Scratch, components

PIVOTS = (4, 256)  # pivots of a bucket in the second round, mostly originals, and in each later one
LARGE = 64  # members of a bucket from which counting shared features pays
CLASSES, STEPS = 256, 12  # of a profile: hash classes, and codes for each doubling of a weight
COARSE = 64  # hash classes of the profile for joins, if nothing else is asked: a divisor of CLASSES
LEVELS = np.append(2.0 ** (np.arange(255) / STEPS) - 1, np.inf)  # the weight that a code stands for

#: Yields (rows, feature hashes, weights) for slices of a column of bodies, sorted by row and hash within each.
Features = Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def jaccard(features: Features) -> Callable[[pa.Array, pa.Array], np.ndarray]:
    """Scores two columns of bodies row by row with the weighted Jaccard similarity."""

    def score(left: pa.Array, right: pa.Array) -> np.ndarray:
        found = [x for column in (left, right) for x in features(column)]
        row, h, w = (np.concatenate([x[i] for x in found]) for i in range(3))
        total = np.bincount(row, w, minlength=len(left))
        order = np.lexsort((h, row))
        row, h, w = row[order], h[order], w[order]
        both = np.flatnonzero((row[1:] == row[:-1]) & (h[1:] == h[:-1]))
        shared = np.bincount(row[both], np.minimum(w[both], w[both + 1]), minlength=len(left))
        return shared / np.maximum(total - shared, 1e-300)

    return score


def profiled(payloads: DataFrame, features: Features, classes: int = COARSE) -> DataFrame:
    """Rows (v, w, profile, coarse, body) of payloads (v, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = np.zeros(len(b) * CLASSES)
            for row, h, weight in features(b.column(1)):
                sums += np.bincount(row * CLASSES + (h >> np.uint64(56)).astype(np.int64), weight, minlength=len(sums))
            codes = np.minimum(np.ceil(np.log2(1 + sums) * STEPS + 1e-6), 255) * (sums > 0)
            codes = codes.astype(np.uint8).reshape(len(b), CLASSES)
            # single precision rounds by less than a part in ten million
            coarse = (sums.reshape(len(b), classes, -1).sum(2) * (1 + 1e-6)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * classes, pa.int32()), pa.array(coarse.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums.reshape(len(b), CLASSES).sum(1)), pa.array([c.tobytes() for c in codes], pa.binary()), lists, b.column(1)], ["v", "w", "profile", "coarse", "body"])

    return payloads.select("v", "body").mapInArrow(run, "v long, w double, profile binary, coarse array<float>, body string")


def _alike(least: float):
    """Pairs (a, b) whose profiles allow a similarity of `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(len(b), CLASSES) for i in (4, 5))
            most = LEVELS[np.minimum(x, y)].sum(1)
            w = b.column(2).to_numpy() + b.column(3).to_numpy()
            keep = pa.array(most >= least * (w - most))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return run


def plausible(pairs: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """The distinct pairs (a, b) that the bound by profiles does not rule out; bodies are rows of profiled()."""
    side = lambda c: bodies.select(F.col("v").alias(c), F.col("w").alias(f"w_{c}"), F.col("profile").alias(f"profile_{c}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a")
    return rows.select("a", "b", "w_a", "w_b", "profile_a", "profile_b").mapInArrow(_alike(least), "a long, b long").distinct()


def score_pairs(pairs: DataFrame, bodies: DataFrame, score: Callable[[pa.Array, pa.Array], np.ndarray]) -> DataFrame:
    """Rows (a, b, score) of pairs (a, b); bodies are rows (v, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 64):
                part = b.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score(part.column(2), part.column(3)), pa.float64())], ["a", "b", "score"])

    rows = pairs.join(bodies.select(F.col("v").alias("b"), F.col("body").alias("body_b")), "b")
    rows = rows.join(bodies.select(F.col("v").alias("a"), F.col("body").alias("body_a")), "a")
    return rows.select("a", "b", "body_a", "body_b").mapInArrow(run, "a long, b long, score double")


def lone_weights(payloads: DataFrame, features: Features) -> DataFrame:
    """Rows (v, lone): the weight of the features that no other body has.

    Features are counted within each slice of bodies first, so what a group has in common is
    one row a slice, not one a body.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, h, weight in features(b.column(1)):
                keys, at, n = np.unique(h, return_index=True, return_counts=True)
                v = b.column(0).take(pa.array(row[at]))
                yield pa.RecordBatch.from_arrays([v, pa.array(keys.view(np.int64)), pa.array(weight[at], pa.float32()), pa.array(n)], ["v", "h", "w", "n"])

    each = payloads.select("v", "body").mapInArrow(run, "v long, h long, w float, n long")
    lone = each.groupBy("h").agg(F.sum("n").alias("n"), F.min("v").alias("v"), F.min("w").alias("w")).filter("n = 1")
    return lone.groupBy("v").agg(F.sum("w").alias("lone"))


def _unresolved(named: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Rows of buckets whose members have several labels, with `main`, the commonest one, and `size`."""
    sizes = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("m"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("size"))
    # a table of its own, so that the join may split the rows of a large bucket
    main = scratch.save(main.filter("labels > 1").select("bucket", F.col("m.label").alias("main"), "size"), f"main_{label}")
    return scratch.save(named.join(main, "bucket"), label)


def link_buckets(members: DataFrame, payloads: DataFrame, threshold: float, scratch: Scratch, features: Features, classes: int = COARSE) -> DataFrame:
    """Components (id, component) of links between members (bucket, v) of the same bucket.

    Payloads are rows (v, body), partitioned by v; links have a weighted Jaccard similarity of
    the bodies' features of at least `threshold`. A member with several bodies links by any.
    """
    least = threshold * (1 - 1e-5)  # weights are sums of floats
    score = jaccard(features)

    def possible(w: Column, c: Column, p_w: Column, p_c: Column) -> Column:
        shared = F.least(c, p_c)
        return F.when(w.isNull() | p_w.isNull(), True).otherwise(shared >= least * (w + p_w - shared))

    bodies = scratch.bucketed(profiled(payloads, features, classes), "v", "bodies")
    heavy = bodies.groupBy("v").agg(F.when(F.count(F.lit(1)) == 1, F.first("w")).alias("w"))
    members = scratch.save(members.select("bucket", "v").join(heavy, "v"), "weighed")
    heads = scratch.save(members.groupBy("bucket").agg(F.min(F.struct("v", "w")).alias("p")), "heads")
    rows = scratch.save(members.join(heads, "bucket").filter("v <> p.v").select("bucket", "v", "w", F.col("p.v").alias("p"), F.col("p.w").alias("p_w")), "round0")
    scratch.drop("weighed")
    scratch.drop("heads")
    w, p_w = F.col("w"), F.col("p_w")
    pairs = rows.filter(possible(w, w, p_w, p_w)).select(F.col("v").alias("a"), F.col("p").alias("b")).distinct()
    rows = rows.select("bucket", "v", "w", F.col("w").alias("c"))  # a bucket's first pivot has met all others
    labels, step, held = None, 0, ["round0"]
    while True:
        step += 1
        near = scratch.save(plausible(pairs, bodies, least), f"pairs{step}")
        links = score_pairs(near, bodies, score).filter(F.col("score") >= threshold).select("a", "b")
        if labels is not None:
            side = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"label_{c}"))
            links = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
            links = links.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).filter("a <> b").distinct()
        links = scratch.save(links, f"links{step}")
        moved = components(links, scratch, f"step{step}")
        if labels is None:
            labels = scratch.save(moved, f"labels{step}")
        else:
            to = moved.select(F.col("id").alias("component"), F.col("component").alias("to"))
            old = labels.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
            labels = scratch.save(old.union(moved.join(old.select("id"), "id", "left_anti")), f"labels{step}")
            scratch.drop(f"labels{step - 1}")
        named = rows.join(labels.withColumnRenamed("id", "v"), "v", "left").select("bucket", "v", "w", "c", F.coalesce("component", "v").alias("label"))
        named = _unresolved(named, scratch, f"named{step}")
        for name in (*held, f"pairs{step}", f"links{step}", f"main_named{step}"):
            scratch.drop(name)
        held = [f"named{step}"]
        if step == 1:
            wanted = named.filter(F.col("size") > LARGE).select("v").distinct()
            lone = scratch.save(lone_weights(bodies.join(wanted, "v"), features), "lone")
            bound = named.join(lone, "v", "left").withColumn("c", F.when(F.col("size") > LARGE, w - F.coalesce("lone", F.lit(0.0))).otherwise(w))
            # a member cannot link where too little of its weight is shared at all
            bound = bound.filter(w.isNull() | (F.col("c") >= least * w)).select("bucket", "v", "w", "c", "label")
            named = _unresolved(bound, scratch, "bound")
            held += ["bound", "main_bound", "lone"]
        if named.isEmpty():
            for name in held:
                scratch.drop(name)
            scratch.drop_bucketed("bodies")
            return labels
        # members with most of their weight in common first: an original before its copies
        shapes = bodies.groupBy("v").agg(F.when(F.count(F.lit(1)) == 1, F.first("coarse")).alias("f"))
        shaped = scratch.save(named.join(shapes, "v"), f"shaped{step}")
        held.append(f"shaped{step}")
        order = Window.partitionBy("bucket").orderBy(F.desc(F.col("c") / w), "v")
        pivots = shaped.filter("label <> main").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PIVOTS[min(step, len(PIVOTS)) - 1])
        pivots = pivots.select("bucket", F.col("v").alias("p"), F.col("w").alias("p_w"), F.col("c").alias("p_c"), F.col("label").alias("p_label"), F.col("f").alias("p_f"))
        pivots = scratch.save(pivots, f"pivots{step}")
        held.append(f"pivots{step}")
        most = F.aggregate(F.zip_with("f", "p_f", lambda a, b: F.least(a, b).cast("double")), F.lit(0.0), lambda a, x: a + x)
        alike = F.coalesce(most * (1 + least) >= least * (w + p_w), F.lit(True))  # most >= least * (w + p_w - most)
        met = shaped.join(pivots, "bucket").filter((F.col("label") != F.col("p_label")) & possible(w, F.col("c"), p_w, F.col("p_c")) & alike)
        pairs = met.select(F.least("v", "p").alias("a"), F.greatest("v", "p").alias("b")).distinct()
        rows = named.join(pivots.select("bucket", F.col("p").alias("v")), ["bucket", "v"], "left_anti").select("bucket", "v", "w", "c")
