"""A record's parcel by tiers: its number, its point, and at last its PIN.

Each tier joins only the rows that need it and that the tiers before left: the number look-up asks
the cache first and the service for the rest; the point look-up searches parcels that contain the
point, then, for points still without one, narrow and wide envelopes; the bridge takes what is
unresolved and has a PIN but no number. What the tiers found is judged in one expression. Distances
are between the record's point and the centroid of the joined parcel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgraph.functions import values as V
from landgraph.operators.spatial import grid_join, resolution

WIDTHS = (0.0002, 0.0018)  # half-widths in degrees of the first and the last envelope around a point


def present(number: Column) -> Column:
    """Whether a number is there and not all zeros."""
    return F.coalesce(F.trim(number).rlike("[^0]"), F.lit(False))


def point_lookup(points: DataFrame, parcels: DataFrame, point_id: str, widths: tuple[float, float] = WIDTHS) -> DataFrame:
    """Rows (point, number, tier) of points (x, y) that have a parcel of parcels (number, ring of [x, y]).

    Tier 0: a parcel contains the point (the smallest number of several). The other points widen
    their envelope as long as parcels are in it: where none meets the narrow one the search ends
    without a parcel; else tier 1 is the parcel of the wide one with the nearest centroid. The
    narrow and the wide search have grids of their own cell size, so a narrow one reads small cells.
    """
    side = lambda i, f: f(F.transform("ring", lambda p: p[i]))
    boxes = parcels.filter("ring is not null").select("number", "ring", side(0, F.array_min).alias("x0"), side(0, F.array_max).alias("x1"), side(1, F.array_min).alias("y0"), side(1, F.array_max).alias("y1"))
    around = lambda w: boxes.withColumns({"x0": F.col("x0") - w, "x1": F.col("x1") + w, "y0": F.col("y0") - w, "y1": F.col("y1") + w})
    narrow, wide = widths
    cell = lambda w: max(4 * w, 0.002)
    held = grid_join(points, boxes, cell(narrow), V.inside(F.col("ring"), F.col("y"), F.col("x")))
    held = held.groupBy(point_id).agg(F.min("number").alias("number"))
    left = points.join(held.hint("merge"), point_id, "left_anti")
    close = grid_join(left, around(narrow), cell(narrow)).select(point_id).distinct()
    left = left.join(close.hint("merge"), point_id, "left_semi")
    middle = V.centroid(F.col("ring"))
    away = F.pow(middle["lng"] - F.col("x"), 2) + F.pow(middle["lat"] - F.col("y"), 2)
    near = grid_join(left, around(wide), cell(wide)).withColumn("away", away).groupBy(point_id).agg(F.min_by("number", F.struct("away", "number")).alias("number"))
    return held.withColumn("tier", F.lit(0)).unionByName(near.withColumn("tier", F.lit(1)))


def resolve_records(records: DataFrame, cache: DataFrame, service: DataFrame, bridge: DataFrame, *, limit: float = 500.0) -> DataFrame:
    """Rows (id, method, resolved, reason) of records (id, number, lat, lng, pin).

    cache has parcels (number, lat, lng) that are stored already, lat and lng being null where the
    centroid is unknown; service has (number, ring), a null ring being no answer; bridge has rows
    (pin, number, seq), of which the first valid number of a pin counts. All of them grow with
    the records, so every join shuffles and none is broadcast, whatever size Spark guesses.
    """
    has_number, has_point = F.coalesce(F.col("number") != "", F.lit(False)), F.coalesce(F.col("lat") != 0, F.lit(False))
    rows = records.select("id", "number", "lat", "lng", "pin", has_number.alias("has_number"), has_point.alias("has_point"))

    asked = rows.filter("has_number").select("number").distinct()
    stored = asked.join(cache.select("number", "lat", "lng").hint("merge"), "number").withColumn("cached", F.lit(True))
    middle = V.centroid(F.col("ring"))
    fresh = asked.join(cache.select("number").hint("merge"), "number", "left_anti").join(service.filter("ring is not null").hint("merge"), "number")
    fresh = fresh.select("number", middle["lat"].alias("lat"), middle["lng"].alias("lng"), F.lit(False).alias("cached"))
    by_number = stored.unionByName(fresh).select("number", F.col("number").alias("number_hit"), F.col("lat").alias("hit_lat"), F.col("lng").alias("hit_lng"), "cached")

    points = rows.filter(F.col("has_point") & (F.col("lng") != 0)).select("id", F.col("lng").alias("x"), F.col("lat").alias("y"))
    # a parcel whose number is all zeros hides no other one: it is found, and it counts as no answer
    by_point = point_lookup(points, service, "id").filter(present(F.col("number"))).select("id", F.col("number").alias("point_hit"))

    met = rows.join(by_number.hint("merge"), "number", "left").join(by_point.hint("merge"), "id", "left")
    metres = V.haversine(F.col("lat"), F.col("lng"), F.col("hit_lat"), F.col("hit_lng"))
    judged = met.withColumn("r", resolution(F.col("has_number"), F.col("has_point"), F.col("number_hit"), F.col("point_hit"), metres, F.col("cached"), limit))
    judged = judged.select("id", "number", "pin", "r.*")

    orphan = F.col("resolved").isNull() & ~present(F.col("number")) & F.coalesce(F.trim("pin") != "", F.lit(False))
    known = bridge.filter(present(F.col("number")) & (F.trim("pin") != "")).groupBy(F.trim("pin").alias("pin")).agg(F.min_by("number", "seq").alias("bridged"))
    bridged = judged.filter(orphan).select("id", "method", "resolved", "reason", F.trim("pin").alias("pin")).join(known.hint("merge"), "pin", "left")
    found = F.col("bridged").isNotNull()
    bridged = bridged.select("id", F.when(found, "pin_gw").otherwise(F.col("method")).alias("method"), F.coalesce("bridged", "resolved").alias("resolved"), F.when(~found, F.col("reason")).alias("reason"))
    return judged.filter(~orphan).select("id", "method", "resolved", "reason").unionByName(bridged)
