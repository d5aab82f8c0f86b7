"""Map elements to points of interest: coordinates, tags with their fallbacks, and the building around a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgraph.functions.values import footprint_sqft


def tag(tags: Column, *names: str) -> Column:
    """The first of the tags that is not empty, or ''."""
    return F.coalesce(*(F.nullif(F.try_element_at(tags, F.lit(n)), F.lit("")) for n in names), F.lit(""))


def points_of_interest(elements: DataFrame, buildings: DataFrame) -> DataFrame:
    """Branded elements (type, id, lat, lon, geometry, tags) with coordinates, and the buildings (osm_id, polygon, tags) of nodes.

    A way lies at the mean of its outline's points; an address missing on the element is its building's.
    """
    mean = lambda k: F.aggregate("geometry", F.lit(0.0), lambda s, p: s + p[k]) / F.nullif(F.size("geometry"), F.lit(0))
    outline = F.transform("geometry", lambda p: F.array(p["lon"], p["lat"]))
    way = F.col("type") == "way"
    rows = elements.withColumns(
        {
            "osm_id": F.concat_ws("/", "type", F.col("id").cast("string")),
            "lat": F.when(F.col("type") == "node", F.col("lat")).otherwise(mean("lat")),
            "lng": F.when(F.col("type") == "node", F.col("lon")).otherwise(mean("lon")),
        }
    ).filter((tag(F.col("tags"), "brand") != "") & F.col("lat").isNotNull() & F.col("lng").isNotNull())
    known = buildings.select("osm_id", F.col("polygon").alias("__polygon"), F.col("tags").alias("__tags"))
    rows = rows.join(known, "osm_id", "left")
    node = F.col("type") == "node"
    both = lambda n: F.coalesce(F.nullif(tag(F.col("tags"), n), F.lit("")), F.when(node, tag(F.col("__tags"), n)), F.lit(""))
    ring = F.when(way & (F.size("geometry") > 0), outline).when(node, F.col("__polygon"))
    t = F.col("tags")
    return rows.select(
        "osm_id", F.coalesce(F.nullif(tag(t, "name"), F.lit("")), tag(t, "brand")).alias("name"), tag(t, "brand").alias("brand"), tag(t, "cuisine").alias("cuisine"), tag(t, "operator").alias("operator"),
        tag(t, "drive_through", "drive_in").alias("drive_through"), tag(t, "phone", "contact:phone").alias("phone"), tag(t, "website", "contact:website").alias("website"), "lat", "lng",
        F.struct(both("addr:housenumber").alias("housenumber"), both("addr:street").alias("street"), both("addr:city").alias("city"), both("addr:postcode").alias("postal_code")).alias("address"),
        ring.alias("polygon"), F.when(F.size(ring) >= 3, footprint_sqft(ring)).alias("approx_sqft"),
    )
