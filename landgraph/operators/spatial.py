"""Spatial joins over grid cells, and the parcel resolution chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgraph.functions.values import cells, inside


def grid_join(points: DataFrame, boxes: DataFrame, size: float, hit: Column | None = None) -> DataFrame:
    """Points (x, y) with every box (x0, x1, y0, y1) that holds them.

    Boxes are listed in each grid cell they touch, so the join has an equality to shuffle on;
    the exact test (and `hit`, if given) follows. Neither side is broadcast: Spark guesses the
    boxes' size from the table they come from, and rings in all their cells are many times that.
    """
    tiles = boxes.withColumn("__cx", F.explode(cells(F.col("x0"), F.col("x1"), size))).withColumn("__cy", F.explode(cells(F.col("y0"), F.col("y1"), size)))
    spots = points.withColumns({"__cx": F.floor(F.col("x") / size), "__cy": F.floor(F.col("y") / size)})
    met = spots.join(tiles.hint("merge"), ["__cx", "__cy"]).filter(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return (met if hit is None else met.filter(hit)).drop("__cx", "__cy")


def _edges(ring: Column) -> Column:
    """The sides of a ring of [x, y], the closing one included."""
    after = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda p, q: F.struct(p[0].alias("ax"), p[1].alias("ay"), q[0].alias("bx"), q[1].alias("by")))


def _touches(e: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Whether a side meets a rectangle: the boxes overlap, and the corners are not all beyond the same side of its line."""
    turn = lambda x, y: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
    corners = [turn(x, y) for x in (x0, x1) for y in (y0, y1)]
    apart = (F.least(*corners) > 0) | (F.greatest(*corners) < 0)
    return (F.least(e["ax"], e["bx"]) <= x1) & (F.greatest(e["ax"], e["bx"]) >= x0) & (F.least(e["ay"], e["by"]) <= y1) & (F.greatest(e["ay"], e["by"]) >= y0) & ~apart


def _judged(near: Column, ring: Column, cx: Column, cy: Column, size: float) -> Column:
    """A cell with the sides that meet it (a hair wider, so that rounding decides nothing) and whether it is wholly inside."""
    hair = size * 1e-6
    x0, x1, y0, y1 = cx * size - hair, (cx + 1) * size + hair, cy * size - hair, (cy + 1) * size + hair
    met = F.filter(near, lambda e: _touches(e, x0, x1, y0, y1))
    return F.struct(cx.alias("cx"), cy.alias("cy"), met.alias("near"), inside(ring, (cy + 0.5) * size, (cx + 0.5) * size).alias("middle"))


def cell_cover(parcels: DataFrame, parcel_id: str, size: float, levels: int) -> DataFrame:
    """Rows (parcel, level, cx, cy, whole) of the cells that a ring of [x, y] meets, from `size` down to size / 2^levels.

    A cell that no side meets is wholly inside, and stays as it is, or outside, and goes; one
    that a side meets is split in four, down to the last level. A cell's parts are tested only
    against the sides that met it. Cells are numbered from 0 on both axes, a level's
    parts being 2c and 2c + 1. Null and empty rings have no cells.
    """
    keep = lambda cells: F.filter(cells, lambda c: (F.size(c["near"]) > 0) | c["middle"])
    side = lambda i, f: f(F.transform("ring", lambda p: p[i]))
    xs = cells(side(0, F.array_min), side(0, F.array_max), size)
    ys = cells(side(1, F.array_min), side(1, F.array_max), size)
    rows = parcels.select(parcel_id, "ring", _edges(F.col("ring")).alias("near"), xs.alias("xs"), ys.alias("ys"))
    rows = rows.select(parcel_id, "ring", "near", F.explode("xs").alias("cx"), "ys")
    top = keep(F.transform("ys", lambda cy: _judged(F.col("near"), F.col("ring"), F.col("cx"), cy, size)))
    rows = rows.select(parcel_id, "ring", F.lit(0).alias("level"), F.explode(top).alias("c"))
    for level in range(1, levels + 1):
        quarters = F.array(*(F.struct((F.col("c.cx") * 2 + i).alias("cx"), (F.col("c.cy") * 2 + j).alias("cy")) for i in (0, 1) for j in (0, 1)))
        width = size / 2**level
        parts = keep(F.transform(quarters, lambda q: _judged(F.col("c.near"), F.col("ring"), q["cx"], q["cy"], width)))  # noqa: B023
        split = F.size("c.near") > 0
        rows = rows.select(parcel_id, "ring", F.when(split, F.lit(level)).otherwise(F.col("level")).alias("level"), F.explode(F.when(split, parts).otherwise(F.array("c"))).alias("c"))
    return rows.select(parcel_id, "ring", "level", "c.cx", "c.cy", (F.size("c.near") == 0).alias("whole"))


def ring_candidates(points: DataFrame, parcels: DataFrame, parcel_id: str, size: float, levels: int) -> DataFrame:
    """Rows (cx, cy, parcel, ring) of the last level's cells that hold points: what may be the smallest parcel there.

    ring is null for the smallest parcel that covers the cell wholly, which needs no test; the
    others are those that have a side in the cell and a smaller id than it. Parcels of equal
    rings are one, that of the smallest id.
    """
    deep = size / 2**levels
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parcels = parcels.groupBy("ring").agg(F.min(parcel_id).alias(parcel_id)).repartition(parts, parcel_id)  # few bytes, many tests
    cover = cell_cover(parcels, parcel_id, size, levels)
    held = points.select(F.floor(F.col("x") / deep).alias("cx"), F.floor(F.col("y") / deep).alias("cy")).distinct()
    above = [F.struct(F.lit(n).alias("level"), F.shiftright("cx", levels - n).alias("ux"), F.shiftright("cy", levels - n).alias("uy")) for n in range(levels + 1)]
    held = held.select("cx", "cy", F.explode(F.array(*above)).alias("u")).select("cx", "cy", "u.*")
    tiles = cover.withColumnsRenamed({"cx": "ux", "cy": "uy"})
    sure = tiles.filter("whole").groupBy("level", "ux", "uy").agg(F.min(parcel_id).alias("sure"))
    sure = held.join(sure, ["level", "ux", "uy"]).groupBy("cx", "cy").agg(F.min("sure").alias("sure"))
    tried = cover.filter("not whole").select("cx", "cy", parcel_id, "ring")
    tried = tried.join(sure, ["cx", "cy"], "left").filter(F.col("sure").isNull() | (F.col(parcel_id) < F.col("sure"))).drop("sure")
    ring = parcels.schema["ring"].dataType
    return tried.unionByName(sure.select("cx", "cy", F.col("sure").alias(parcel_id), F.lit(None).cast(ring).alias("ring")))


def point_in_parcel(points: DataFrame, parcels: DataFrame, point_id: str, parcel_id: str, size: float = 0.01, levels: int = 4) -> DataFrame:
    """Each point's parcel (smallest id of those whose ring of [lng, lat] holds it).

    Cells of `size` are split `levels` times along the parcels' sides, so a point meets one parcel
    that holds its cell wholly and the few with a side in its small cell, however many overlap.
    Points without coordinates or outside all parcels have no row; a repeated point id has the
    smallest parcel of its points. Coordinates that are not numbers count as none.
    """
    deep = size / 2**levels
    points = points.filter("not isnan(x) and not isnan(y)")
    spots = points.select(point_id, "x", "y", F.floor(F.col("x") / deep).alias("cx"), F.floor(F.col("y") / deep).alias("cy"))
    met = spots.join(ring_candidates(points, parcels, parcel_id, size, levels), ["cx", "cy"])
    met = met.filter(F.col("ring").isNull() | inside(F.col("ring"), F.col("y"), F.col("x")))
    return met.groupBy(point_id).agg(F.min(parcel_id).alias(parcel_id))


def nearest_within(points: DataFrame, places: DataFrame, point_id: str, place_id: str, widths: tuple[float, ...]) -> DataFrame:
    """The nearest place in the smallest square of the given half-widths that holds any: tiers as columns, one join."""
    most = widths[-1]
    boxes = places.select(place_id, F.col("x").alias("px"), F.col("y").alias("py"), (F.col("x") - most).alias("x0"), (F.col("x") + most).alias("x1"), (F.col("y") - most).alias("y0"), (F.col("y") + most).alias("y1"))
    met = grid_join(points, boxes, most)
    gap = F.greatest(F.abs(F.col("x") - F.col("px")), F.abs(F.col("y") - F.col("py")))
    tier = F.coalesce(*(F.when(gap <= w, i) for i, w in enumerate(widths)))
    away = F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)
    met = met.withColumns({"tier": tier, "away": away}).filter("tier is not null")
    return met.groupBy(point_id).agg(F.min_by(place_id, F.struct("tier", "away", place_id)).alias(place_id), F.min("tier").alias("tier"))


def resolution(has_number: Column, has_point: Column, number_hit: Column, spatial_hit: Column, metres: Column, cached: Column, limit: float = 500.0) -> Column:
    """STRUCT(method, resolved, reason) of a record's parcel; hits are parcel numbers or null."""
    far = F.concat(F.lit("arn_too_far_"), F.floor(metres).cast("string"), F.lit("m"))
    out = lambda m, r, why=F.lit(None).cast("string"): F.struct(F.lit(m).alias("method") if isinstance(m, str) else m.alias("method"), r.alias("resolved"), why.alias("reason"))
    none = F.lit(None).cast("string")
    return (
        F.when(has_number & has_point & number_hit.isNotNull() & spatial_hit.isNotNull() & (number_hit == spatial_hit), out("arn_verified", number_hit))
        .when(has_number & has_point & number_hit.isNotNull() & spatial_hit.isNotNull(), out("spatial_override", spatial_hit, F.concat(F.lit("arn_was_"), number_hit)))
        .when(has_number & has_point & number_hit.isNotNull() & (metres > limit), out("unresolved", none, far))
        .when(has_number & has_point & number_hit.isNotNull(), out(F.when(cached, "arn_cache").otherwise("arn_api"), number_hit))
        .when(has_number & has_point & spatial_hit.isNotNull(), out("spatial_geocode", spatial_hit))
        .when(has_number & has_point, out("unresolved", none, F.lit("both_failed")))
        .when(has_number & number_hit.isNotNull(), out("arn_unverified", number_hit))
        .when(has_number, out("unresolved", none, F.lit("arn_api_miss")))
        .when(has_point & spatial_hit.isNotNull(), out("spatial_geocode", spatial_hit))
        .when(has_point, out("unresolved", none, F.lit("spatial_miss")))
        .otherwise(out("unresolved", none, F.lit("no_identifiers")))
    )
