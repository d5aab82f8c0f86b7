"""Near-duplicate vectors by NN-descent.

Links join vectors of cosine >= `threshold`, that is, within an angle T. First, tight groups
are folded: a vector within T/2 of a leader that shares a hyperplane signature with it joins
the leader's ball. Members of a ball all link, by the triangle inequality, so a large group of
near copies is counted, not expanded. Among leaders, NN-descent refines a neighbour graph:
each leader sees its neighbours' and reverse neighbours' vectors together (the local join)
and learns pairs with at least one new edge, until few lists change. Lists that hold only
vectors near enough to link are saturated and are enlarged; leaders that have several vectors near
enough to link after the rounds are compared with all leaders, in blocks. A stated set of leaders is
searched by brute force, and while the recall of links falls short, new random orders seed the
graph again; a recall that falls short to the end is an error. Around a vertex that very many
vectors have as neighbour they meet in blocks, dealt anew each round. Pairs of leaders near enough for any link of their balls are
resolved: by the triangle inequality where that decides, else member against member, in
blocks, in double precision.

Vectors that are null, zero, or hold null or non-finite components link with nothing. Shorter
vectors count as padded with zeros. Rows are vectors of their own even where ids repeat; a
null id is never the smallest. Vectors of any length are read whole; an empty table gives an
empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgraph.llm.common import Scratch, components, shuffle_partitions

NEAR = "u long, v long, sim float"
CROWD = 2048  # vectors that meet around one vertex; more are dealt anew each round


def _prepare(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                v = np.array([np.nan if y is None else y for y in x], np.float64) if x else np.zeros(1)
                ok = np.isfinite(v).all() and v.any()
                if ok:
                    v = v / np.abs(v).max()  # no overflow in the norm
                    v = np.pad(v / np.linalg.norm(v), (0, dim - len(v)))
                out.append(v.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "x"])

    return run


def matrix(column: pa.Array, dtype: str = "float64") -> np.ndarray:
    """Binary rows of equal width as a matrix."""
    if not len(column):
        return np.zeros((0, 1), dtype)
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1).astype(dtype, copy=False)


def _signatures(dim: int, bits: int, tables: int, seed: int):
    planes = np.random.default_rng(seed).normal(size=(tables, dim, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for b in batches:
            x = matrix(b.column(1))
            if not len(x):
                continue
            for t in range(tables):
                sign = ((x @ planes[t] > 0) * place).sum(1).astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(x), t, np.int32)), pa.array(sign)], ["v", "t", "sign"])

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sim = np.einsum("nd,nd->n", matrix(b.column(2)), matrix(b.column(3))) if len(b) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim, pa.float64())], ["a", "b", "cos"])


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cos) of pairs (a, b), in double precision."""
    rows = pairs.join(vectors.select(F.col("v").alias("a"), F.col("x").alias("x_a")), "a").join(vectors.select(F.col("v").alias("b"), F.col("x").alias("x_b")), "b")
    return rows.select("a", "b", "x_a", "x_b").mapInArrow(_cosines, "a long, b long, cos double")


def fold_balls(vectors: DataFrame, dim: int, radius: float, n: int, scratch: Scratch, tables: int = 6) -> DataFrame:
    """(v, leader, angle): members of a ball are within `radius` of its leader, which is itself a member at 0."""
    bits = min(62, math.ceil(math.log2(max(n, 2))) + 4)
    signs = vectors.select("v", "x").mapInArrow(_signatures(dim, bits, tables, 17), "v long, t int, sign long")
    signs = scratch.save(signs, "signs")
    heads = signs.groupBy("t", "sign").agg(F.min("v").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    pairs = signs.join(heads, ["t", "sign"]).filter("v <> b").select(F.col("v").alias("a"), "b").distinct()
    near = cosines(pairs, vectors).filter(F.col("cos") >= math.cos(radius))
    parent = scratch.save(near.groupBy("a").agg(F.min(F.struct("b", "cos")).alias("m")).select(F.col("a").alias("v"), F.col("m.b").alias("p"), F.col("m.cos").alias("cos")), "parents")
    # a parent that has a parent of its own is no leader: try the grandparent
    up = parent.select(F.col("v").alias("p"), F.col("p").alias("g"))
    climbed = scratch.save(parent.join(up, "p", "left"), "climbed")
    direct = climbed.filter("g is null").select("v", F.col("p").alias("leader"), "cos")
    third = climbed.filter("g is not null").select(F.col("v").alias("a"), F.col("g").alias("b")).join(parent.select(F.col("v").alias("b")), "b", "left_anti")
    second = cosines(third.select("a", "b"), vectors).filter(F.col("cos") >= math.cos(radius)).select(F.col("a").alias("v"), F.col("b").alias("leader"), "cos")
    members = scratch.save(direct.union(second), "members")
    alone = vectors.select("v").join(members.select("v"), "v", "left_anti").select("v", F.col("v").alias("leader"), F.lit(1.0).alias("cos"))
    balls = members.union(alone).withColumn("angle", F.acos(F.least(F.lit(1.0), F.col("cos")))).drop("cos")
    return scratch.save(balls, "balls")


def _in_order(reach: int):
    """Cosines of each vector with the next `reach` ones in the order of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.zeros(0, np.int64), None
        for b in batches:
            new = matrix(b.column(1), "float32")
            if not len(new):
                continue
            old = len(ids)
            ids = np.concatenate([ids, b.column(0).to_numpy()])
            x = new if x is None else np.vstack([x, new])
            for step in range(1, min(reach, len(ids) - 1) + 1):
                lo = max(0, old - step)
                a, c = np.arange(lo, len(ids) - step), np.arange(lo + step, len(ids))
                sim = np.einsum("nd,nd->n", x[a], x[c])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[a], ids[c]])), pa.array(np.concatenate([ids[c], ids[a]])), pa.array(np.concatenate([sim, sim]), pa.float32())], ["u", "v", "sim"]
                )
            ids, x = ids[-reach:], x[-reach:]

    return run


def seeds(leaders: DataFrame, dim: int, seed: int, tables: int = 4, reach: int = 6) -> DataFrame:
    """A first graph: neighbours in the orders of several long signatures."""
    signs = leaders.select("v", "x").mapInArrow(_signatures(dim, 48, tables, seed), "v long, t int, sign long").join(leaders.select("v", "x"), "v")
    n = shuffle_partitions(leaders.sparkSession)
    rows = signs.repartitionByRange(n, "t", "sign").sortWithinPartitions("t", "sign", "v").select("v", "x")
    return rows.mapInArrow(_in_order(reach), NEAR).filter("u <> v")


def _local_join(best: int):
    """Among the vectors of a group around one vertex, each one's best pairs with at least one new edge."""

    def emit(vertex: list, ids: list, new: list, floor: list, xs: list) -> pa.RecordBatch:
        u, v, s = [], [], []
        for key, i, fresh, low, x in zip(vertex, ids, new, floor, xs, strict=True):
            sim = x @ x.T
            either = fresh[:, None] | fresh[None, :]
            sim[~either] = -2
            sim[i[:, None] == i[None, :]] = -2
            sim[sim <= low[:, None]] = -2
            k = min(best, len(i))
            top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            rows = np.repeat(np.arange(len(i)), k)
            cols = top.ravel()
            good = sim[rows, cols] > -2
            u.append(i[rows[good]])
            v.append(i[cols[good]])
            s.append(sim[rows[good], cols[good]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v)), pa.array(np.concatenate(s), pa.float32())], ["u", "v", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        done: tuple[list, list, list, list, list] = ([], [], [], [], [])
        size = 0

        def close():
            nonlocal size
            if last is not None and parts:
                done[0].append(last)
                for k in range(4):
                    done[k + 1].append(np.concatenate([p[k] for p in parts]))
                size += len(done[1][-1])

        for b in batches:
            keys, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            new, low = b.column(2).to_numpy(zero_copy_only=False).astype(bool), b.column(3).to_numpy()
            x = matrix(b.column(4), "float32")
            cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
            for i, j in zip(cuts, [*cuts[1:], len(keys)][: len(cuts)], strict=True):
                if keys[i] != last:
                    close()
                    last, parts = keys[i], []
                    if size > 20_000:
                        yield emit(*done)
                        done, size = ([], [], [], [], []), 0
                parts.append((ids[i:j], new[i:j], low[i:j], x[i:j]))
        close()
        if done[0]:
            yield emit(*done)

    return run


def descend(leaders: DataFrame, dim: int, cut: float, scratch: Scratch, *, k: int = 8, rounds: int = 8, best: int = 4, sample: int = 256, recall: float = 0.98) -> DataFrame:
    """(u, v, sim): leaders' neighbours; all of them with sim >= cut, as far as found, and the nearest others."""
    graph = _top(seeds(leaders, dim, 23).withColumn("new", F.lit(True)), leaders.select("v", F.lit(k).alias("k")))
    graph = scratch.save(graph, "graph0")
    for step in range(1, rounds + 1):
        # a list is saturated when even its last place holds a vector near enough to link
        floor = graph.groupBy("u").agg(F.max("k").alias("k"), F.min("sim").alias("low"), F.count(F.lit(1)).alias("n"))
        full = (F.col("n") >= F.col("k")) & (F.col("low") >= cut)
        lists = scratch.save(floor.select("u", F.when(full, F.col("k") * 2).otherwise(F.col("k")).alias("k"), F.when(full | (F.col("n") < F.col("k")), F.lit(-1.0)).otherwise(F.col("low")).cast("float").alias("low")), f"lists{step}")
        both = graph.select("u", F.col("v").alias("at"), "new").union(graph.select(F.col("v").alias("u"), F.col("u").alias("at"), "new"))
        both = both.groupBy("at", "u").agg(F.max("new").alias("new"))
        busy = both.filter("new").select("at").distinct()
        around = both.join(busy, "at").join(lists.select("u", "low"), "u").join(leaders.select(F.col("v").alias("u"), "x"), "u")
        # a vertex that very many have as neighbour is no single group: its vectors meet in blocks, others in each round
        crowds = scratch.save(both.groupBy("at").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD), f"crowds{step}")
        block = F.coalesce(F.pmod(F.xxhash64("u", F.lit(step)), F.ceil(F.col("n") / CROWD)), F.lit(0))
        around = around.join(crowds, "at", "left").withColumn("group", F.xxhash64("at", block))
        around = around.repartition(shuffle_partitions(leaders.sparkSession), "group").sortWithinPartitions("group").select("group", "u", "new", "low", "x")
        found = around.mapInArrow(_local_join(best), NEAR).withColumn("new", F.lit(True))
        merged = graph.select("u", "v", "sim").withColumn("new", F.lit(False)).union(found.select("u", "v", "sim", "new"))
        graph = scratch.save(_top(merged, lists.select(F.col("u").alias("v"), "k")), f"graph{step}")
        changed = graph.agg(F.count_if("new").alias("new"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("new") & (F.col("sim") >= cut)).alias("near")).first()
        if step < rounds and (changed.new <= 0.01 * max(1, changed.n) or (step >= 3 and not changed.near)):
            if audit(leaders, graph, cut, sample) >= recall:
                break
            graph = scratch.save(_top(graph.select("u", "v", "sim", "new").union(seeds(leaders, dim, 100 + step).withColumn("new", F.lit(True))), lists.select(F.col("u").alias("v"), "k")), f"again{step}")
    graph = graph.select("u", "v", "sim")
    crowded = scratch.save(_crowded(graph, cut, k // 2), "crowded")
    if not crowded.isEmpty():
        graph = scratch.save(graph.union(against_all(leaders, crowded, cut, scratch)).groupBy("u", "v").agg(F.max("sim").alias("sim")), "whole")
    got = audit(leaders, graph, cut, sample)
    if got < recall:
        raise RuntimeError(f"recall of links {got:.4f} on {sample} leaders after {step} rounds, below {recall}")
    return graph


def _crowded(graph: DataFrame, cut: float, least: int) -> DataFrame:
    """(v): vertices with at least `least` neighbours near enough to link, or with no others.

    A local join offers a vertex its few best pairs only, and in a group of many near vectors these are
    known ones again and again; so a longer list there may have room and still lack links.
    """
    near = F.count_if(F.col("sim") >= cut)
    return graph.groupBy("u").agg(near.alias("near"), F.count(F.lit(1)).alias("n")).filter((F.col("near") >= least) | (F.col("near") == F.col("n"))).select(F.col("u").alias("v"))


def against_all(leaders: DataFrame, some: DataFrame, cut: float, scratch: Scratch, block: int = 4096) -> DataFrame:
    """(u, v, sim): all leaders with sim >= cut of each of some (v), by brute force; a block of them is broadcast at a time."""
    rows = leaders.join(some, "v").select("v", "x")
    spark, done, held = leaders.sparkSession, [], []

    def search(held: list) -> None:
        queries = np.frombuffer(b"".join(bytes(r.x) for r in held), np.float64).reshape(len(held), -1).astype(np.float32)
        shared = spark.sparkContext.broadcast((np.array([r.v for r in held]), queries))
        done.append(scratch.save(leaders.select("v", "x").mapInArrow(_search(shared, cut), NEAR), f"all{len(done)}"))

    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == block:
            search(held)
            held = []
    if held:
        search(held)
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def _top(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """The k nearest of each vertex; an edge found again keeps its older mark."""
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new")).join(sizes.select(F.col("v").alias("u"), "k"), "u")
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return once.withColumn("place", place).filter("place <= k").select("u", "v", "sim", "new", "k")


def _search(shared, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        for b in batches:
            for lo in range(0, len(b), 4096):
                part = b.slice(lo, 4096)
                sim = queries @ matrix(part.column(1), "float32").T
                i, j = np.nonzero(sim >= cut)
                own = part.column(0).to_numpy()
                keep = ids[i] != own[j]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i][keep]), pa.array(own[j][keep]), pa.array(sim[i, j][keep])], ["u", "v", "sim"])

    return run


def audit(leaders: DataFrame, graph: DataFrame, cut: float, sample: int) -> float:
    """Recall of pairs within the linking range, for `sample` leaders against all."""
    rows = leaders.select("v", "x").orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    if not rows:
        return 1.0
    queries = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float64).reshape(len(rows), -1).astype(np.float32)
    ids = np.array([r.v for r in rows])
    shared = leaders.sparkSession.sparkContext.broadcast((ids, queries))
    true = leaders.select("v", "x").mapInArrow(_search(shared, cut), NEAR)
    have = graph.select("u", "v", F.lit(1).alias("have")).union(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(1))).distinct()
    got = true.join(have, ["u", "v"], "left").agg(F.count("have").alias("have"), F.count(F.lit(1)).alias("n")).first()
    return got.have / got.n if got.n else 1.0


def _count_links(cut: float):
    """For blocks of two balls: each member's links across."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, second, ids, links = [], [], [], []
            for p, q, va, xa, vb, xb in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = (np.frombuffer(b"".join(m), np.float64).reshape(len(m), -1) for m in (xa, xb))
                hit = x @ y.T >= cut
                for v, n in ((va, hit.sum(1)), (vb, hit.sum(0))):
                    some = np.flatnonzero(n)
                    first += [p] * len(some)
                    second += [q] * len(some)
                    ids += [v[i] for i in some]
                    links += n[some].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (first, second, ids, links)], ["a", "b", "v", "links"])

    return run


def near_vectors(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, k: int = 8, block: int = 128) -> DataFrame:
    """One row for each vector: (id, n_links, component_id, kept)."""
    scratch = Scratch(embeddings.sparkSession, "vectors")
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("e"))
    dim = rows.agg(F.max(F.size("e"))).first()[0] or 1
    prepared = rows.mapInArrow(_prepare(max(dim, 1)), f"vec_id {dict(rows.dtypes)['vec_id']}, x binary")
    everything = scratch.save(prepared.withColumn("v", F.monotonically_increasing_id()), "vectors")
    vectors = everything.filter("x is not null").select("v", "x")
    n = vectors.count()
    reach = math.acos(threshold)
    balls = fold_balls(vectors, dim, reach / 2 - 1e-7, n, scratch)
    shapes = scratch.save(balls.groupBy("leader").agg(F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")), "shapes")
    leaders = scratch.save(vectors.join(shapes.select(F.col("leader").alias("v")), "v"), "leaders")
    widest = shapes.agg(F.max("r")).first()[0] or 0.0
    cut = math.cos(min(math.pi, reach + 2 * widest)) - 1e-5
    graph = descend(leaders, dim, cut, scratch, k=k)
    pairs = graph.filter(F.col("sim") >= cut).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    exact = cosines(pairs, leaders).withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cos")))))
    exact = exact.join(shapes.select(F.col("leader").alias("a"), F.col("r").alias("r_a"), F.col("n").alias("n_a")), "a").join(shapes.select(F.col("leader").alias("b"), F.col("r").alias("r_b"), F.col("n").alias("n_b")), "b")
    single = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    slack = 1e-7
    kind = F.when(single, F.when(F.col("cos") >= threshold, "all").otherwise("none")).when(F.col("angle") + F.col("r_a") + F.col("r_b") <= reach - slack, "all").when(F.col("angle") - F.col("r_a") - F.col("r_b") > reach + slack, "none").otherwise("some")
    exact = scratch.save(exact.withColumn("kind", kind).filter("kind <> 'none'").select("a", "b", "n_a", "n_b", "kind"), "near")
    sure = exact.filter("kind = 'all'")
    whole = sure.select(F.col("a").alias("leader"), F.col("n_b").alias("n")).union(sure.select(F.col("b").alias("leader"), F.col("n_a").alias("n"))).groupBy("leader").agg(F.sum("n").alias("more"))
    unsure = exact.filter("kind = 'some'").select("a", "b")
    touched = unsure.select(F.col("a").alias("leader")).union(unsure.select("b")).distinct()
    place = F.row_number().over(Window.partitionBy("leader", F.pmod("v", F.lit(64))).orderBy("v"))
    inside = balls.join(touched, "leader").join(vectors, "v").withColumn("block", F.concat_ws("-", F.pmod("v", F.lit(64)), F.floor(place / block)))
    blocks = scratch.save(inside.groupBy("leader", "block").agg(F.collect_list("v").alias("vs"), F.collect_list("x").alias("xs")), "blocks")
    side = lambda c: blocks.select(F.col("leader").alias(c), F.col("block").alias(f"block_{c}"), F.col("vs").alias(f"vs_{c}"), F.col("xs").alias(f"xs_{c}"))
    crossed = unsure.join(side("a"), "a").join(side("b"), "b").select("a", "b", "vs_a", "xs_a", "vs_b", "xs_b").mapInArrow(_count_links(threshold), "a long, b long, v long, links long")
    crossed = scratch.save(crossed.groupBy("a", "b", "v").agg(F.sum("links").alias("links")), "crossed")
    met = crossed.select("a", "b").distinct()
    crossed = crossed.groupBy("v").agg(F.sum("links").alias("links"))
    roots = components(sure.select("a", "b").union(met.select("a", "b")), scratch, "vectors")
    full = balls.join(shapes.select("leader", "n"), "leader").join(whole, "leader", "left").join(crossed, "v", "left").join(roots.withColumnRenamed("id", "leader"), "leader", "left")
    full = full.select("v", (F.col("n") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "leader").alias("root"))
    full = everything.select("v", "vec_id").join(full, "v", "left")
    full = scratch.save(full.withColumn("root", F.coalesce("root", "v")), "full")
    smallest = full.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = full.join(smallest, "root").select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("component_id").cast("long"), F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out
