"""Folds, joins and streams on adversarial small inputs, and the plans that they get."""

import random

from pyspark.sql import functions as F

from landgraph.operators import folds, relational, resolution, search, spatial


def test_fold_equals_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice(["", "2020-01-01", "2020-01-02", "2021-05-05"]), rng.choice(["", "a", "b"])) for k in range(60) for i in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "k int, i int, day string, v string")
    for ties in (False, True):
        want = {}
        for k, i, day, v in sorted(rows):
            best, held = want.get(k, (None, ""))
            if best is None or (day >= best if ties else day > best):
                want[k] = (day if best is None else max(best, day), v or held)
        got = {r.k: r.v for r in folds.fold_latest(df, ["k"], ["i"], "day", ["v"], ties).collect()}
        assert got == {k: v for k, (_, v) in want.items()}


def test_tie_in_best_candidate(spark):
    df = spark.createDataFrame([("a", 2, "f2"), ("a", 2, "f1"), ("b", 1, "f3")], "k string, score int, file string")
    assert {(r.k, r.file) for r in folds.best_per_key(df, ["k"], F.desc("score"), F.asc("file")).collect()} == {("a", "f1"), ("b", "f3")}


def test_registry_keeps_ids(spark):
    registry = spark.createDataFrame([("a", 1), ("z", 7)], "k string, n long")
    keys = spark.createDataFrame([("a", 5), ("c", 3), ("b", 9)], "k string, first int")
    got = {r.k: r.id for r in folds.registered_ids(keys, registry, "k", "first", "G%03d").collect()}
    assert got == {"a": "G001", "z": "G007", "c": "G008", "b": "G009"}


def holds(ring, x, y):
    """Ray casting as functions.values.inside does it."""
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def test_points_of_a_dense_cloud_meet_few_rings(spark):
    """Overlapping rings, equal ones, an L, a ring around all, tiny ones, points on corners and sides; half of the points in one cell."""
    rng = random.Random(11)
    rings = [[[-4.0, -4.0], [4.0, -4.0], [4.0, 4.0], [-4.0, 4.0]], [[0.0, 0.0], [2.0, 0.0], [2.0, 1.0], [1.0, 1.0], [1.0, 2.0], [0.0, 2.0], [0.0, 0.0]]]
    for _ in range(150):
        x, y, w = rng.uniform(-3, 3), rng.uniform(-3, 3), rng.choice([0.01, 0.3, 2.5])
        rings.append([[x, y], [x + w * rng.random(), y - w], [x + w, y + w * rng.random()], [x - w / 3, y + w]])
    rings += rings[5:60]
    order = list(range(len(rings)))
    rng.shuffle(order)
    parcels = [(n + 1, r) for n, r in zip(order, rings, strict=True)]
    points = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(300)] + [(300 + i, rng.uniform(0.4, 0.45), rng.uniform(0.4, 0.45)) for i in range(300)]
    points += [(600 + i, *p) for i, p in enumerate(p for r in rings[:40] for p in r)] + [(1000, 1.0, 0.5), (1001, 0.5, 1.0), (1002, None, 1.0), (1003, float("nan"), 1.0)]
    want = {}
    for i, x, y in points:
        hits = [n for n, r in parcels if x is not None and holds(r, x, y)]
        if hits:
            want[i] = min(hits)
    p = spark.createDataFrame(points, "p int, x double, y double")
    b = spark.createDataFrame([*parcels, (0, None), (-1, [])], "b int, ring array<array<double>>")
    for size, levels in ((0.5, 4), (3.0, 0), (0.11, 2)):
        assert {r.p: r.b for r in spatial.point_in_parcel(p, b, "p", "b", size, levels).collect()} == want
    met = spatial.ring_candidates(p, b, "b", 0.5, 4)
    tests = p.join(met, (F.floor(p.x / 0.03125) == met.cx) & (F.floor(p.y / 0.03125) == met.cy)).filter("ring is not null").count()
    assert tests < 4 * len(points)  # over 10 rings hold a point of the cloud
    plan = spatial.point_in_parcel(p, b, "p", "b", 0.5, 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert spatial.point_in_parcel(p, b.limit(0), "p", "b").count() == 0 == spatial.point_in_parcel(p.limit(0), b, "p", "b").count()


def test_grid_join_equals_brute_force(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(200)]
    boxes = [(i, x, x + rng.random(), y, y + rng.random()) for i in range(80) for x, y in [(rng.uniform(-3, 3), rng.uniform(-3, 3))]]
    got = spatial.grid_join(spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(boxes, "b int, x0 double, x1 double, y0 double, y1 double"), 0.37)
    want = {(p, b) for p, x, y in points for b, x0, x1, y0, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1}
    assert {(r.p, r.b) for r in got.collect()} == want and got.count() == len(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_semi_join_and_top_k_plans(spark):
    a, b = spark.range(1000), spark.range(10)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan(a.join(b, "id", "left_semi"))
    assert "TakeOrderedAndProject" in plan(relational.page(a, F.desc("id"), number=2, size=10))


def test_page_and_tallies_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a string, b string")
    assert relational.page(empty, F.asc("a")).count() == 0
    assert relational.tallies(empty, "a", "b").count() == 0
    assert relational.page_count(empty, 20).first().pages == 0


def test_parties_by_contacts(spark):
    df = spark.createDataFrame([(1, ["x"], []), (2, ["Named Individual(s)"], ["c"]), (3, ["x", "y"], ["c", "d"])], "id int, p array<string>, c array<string>")
    got = {(r.id, r.party, r.contact) for r in resolution.parties_by_contacts(df, "p", "c").collect()}
    assert got == {(1, "x", None), (3, "x", "c"), (3, "x", "d"), (3, "y", "c"), (3, "y", "d")}


def test_phrase_search(spark):
    df = spark.createDataFrame([(1, "a of the b"), (2, "the of a"), (3, "of, THE")], "id int, t string")
    assert {r.id for r in search.match_phrase(search.index(df, "id", F.col("t")), "id", ["of", "the"]).collect()} == {1, 3}
    assert search.index(spark.createDataFrame([(1, "the cats jumped")], "id int, t string"), "id", F.col("t"), stemmed=True).filter("term = 'jump'").count() == 1


def test_ranked_ids_are_dense(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1000).alias("k"))
    got = [r.n for r in relational.ranked_ids(df, [F.col("k")], "%d", "n").orderBy("k").collect()]
    assert got == [str(i) for i in range(1, 501)]


def test_reachable_beyond_any_fixed_number_of_hops(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(130)] + [("x", "y")], "a string, b string")
    got = {(r.start, r.node) for r in search.reachable(edges, spark.createDataFrame([("n000",), ("alone",)], "start string")).collect()}
    assert got == {("n000", f"n{i:03d}") for i in range(131)} | {("alone", "alone")}


def test_upserts_over_skipped_batches(spark, tmp_path):
    from landgraph.streaming import feeds

    path = f"file://{tmp_path}/table"
    assert feeds.read_latest(spark, path, "k int, t int", "k", F.desc("t")).count() == 0
    each = feeds.upsert_latest(path, "k", F.desc("t"), shares=4)
    rows = lambda *r: spark.createDataFrame(r, "k int, t int")
    each(rows((1, 1), (2, 1), (3, 9)), 0)
    each(rows((1, 5)), 2)  # a batch number was left out
    each(rows((2, 0), (4, 4)), 5)
    each(rows((2, 0), (4, 4)), 5)  # and one is repeated
    assert {(r.k, r.t) for r in feeds.read_latest(spark, path, "k int, t int", "k", F.desc("t")).select("k", "t").collect()} == {(1, 5), (2, 1), (3, 9), (4, 4)}


def test_export_positions_restart_in_each_file(spark, tmp_path):
    from landgraph.sources.files import export_records

    for name, n in (("a", 3), ("b", 2)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "export.json").write_text("[" + ",".join(f'{{"x": "{name}{i}"}}' for i in range(n)) + "]")
    got = {(r.folder[-1], r.position, r.x, r.y) for r in export_records(spark, f"file://{tmp_path}", "x string, y string").collect()}
    assert got == {("a", i, f"a{i}", "") for i in range(3)} | {("b", i, f"b{i}", "") for i in range(2)}


def test_upserts_write_by_the_batch(spark, tmp_path):
    """What a batch writes grows with the batch; shares are written anew when their deltas have grown."""
    from landgraph.streaming import feeds

    path = f"file://{tmp_path}/table"
    each = feeds.upsert_latest(path, "k", F.desc("t"), shares=4, compact_at=0.5)
    written = lambda n: sum(1 for f in tmp_path.glob(f"table/base={n}/share=*"))
    rows = lambda keys, t: spark.createDataFrame([(k, t) for k in keys], "k int, t int")
    each(rows(range(400), 0), 0)
    assert written(0) == 4
    want = dict.fromkeys(range(400), 0)
    for n in range(1, 8):
        each(rows(range(n, n + 40), n), n)  # a tenth of the table in each
        want |= dict.fromkeys(range(n, n + 40), n)
        got = feeds.read_latest(spark, path, "k int, t int", "k", F.desc("t"))
        assert {r.k: r.t for r in got.collect()} == want and got.count() == len(want)
    assert written(1) == written(2) == 0 and any(written(n) for n in range(3, 8))
    each(rows([], 8), 8)
    each(rows([1], 9), 9)
    each(rows([1], 9), 9)
    want[1] = 9
    assert {r.k: r.t for r in feeds.read_latest(spark, path, "k int, t int", "k", F.desc("t")).collect()} == want
    assert len(list(tmp_path.glob("table_index/*"))) == 2
