"""Dates, money, identifiers and measures as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SQFT_PER_ACRE, SQM_PER_ACRE, ACRES_PER_HECTARE = 43_560.0, 4_046.8564224, 2.4710538146717
METRES_PER_DEGREE, SQFT_PER_SQM, EARTH_RADIUS = 111_320.0, 10.764, 6_371_000.0


def iso_date(x: Column, *formats: str) -> Column:
    """ISO text of the first format that parses; other text passes through."""
    return F.coalesce(*(F.date_format(F.try_to_date(x, f), "yyyy-MM-dd") for f in formats), x)


def is_iso(x: Column) -> Column:
    return x.rlike(r"^\d{4}-\d{2}-\d{2}$")


def same_date(a: Column, a_format: str, b: Column, b_format: str) -> Column:
    """Equality of two dates; text that does not parse counts as equal."""
    return F.coalesce(F.try_to_date(a, a_format) == F.try_to_date(b, b_format), F.lit(True))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def whole_money(x: Column) -> Column:
    """Whole dollars from digits alone, null without any."""
    return F.nullif(digits(x), F.lit("")).try_cast("bigint")


def pin(x: Column, width: int = 9, left: bool = False) -> Column:
    """Digits padded with zeros to `width`, never cut."""
    d = digits(x)
    padded = F.lpad(d, width, "0") if left else F.rpad(d, width, "0")
    return F.when(d == "", "").when(F.length(d) >= width, d).otherwise(padded)


def roll_number(x: Column) -> Column:
    """A 20-digit roll number, or '' where the text cannot be one: letters first, a dot, under 13 or over 20 digits, all zero."""
    d = digits(x)
    bad = x.rlike(r"^\s*[A-Za-z]") | F.contains(x, F.lit(".")) | ~F.length(d).between(13, 20) | d.rlike("^0+$")
    return F.when(x.isNull() | bad, "").otherwise(F.rpad(d, 20, "0"))


def pins(x: Column) -> Column:
    """Every parcel number of a text with several, as an array."""
    return F.filter(F.transform(F.split(x, r"\s*(?:,|;|\band\b)\s*"), lambda p: pin(p)), lambda p: p != "")


def site_acres(x: Column) -> Column:
    """Acres, rounded to 2, of '1.5 acres', '2 ha', '4000 sq ft', '900 m2'; null otherwise."""
    n = F.nullif(F.regexp_replace(F.regexp_extract(x, r"([\d,]+(?:\.\d+)?)", 1), ",", ""), F.lit("")).try_cast("double")
    low = F.lower(x)
    unit = F.when(low.rlike("acre"), 1.0).when(low.rlike(r"\bha\b|hectare"), ACRES_PER_HECTARE).when(low.rlike("ft|feet|f$"), 1 / SQFT_PER_ACRE).when(low.rlike("m2|m²|sq m|m$"), 1 / SQM_PER_ACRE)
    return F.round(n * unit, 2)


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two points."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def centroid(ring: Column) -> Column:
    """(lat, lng) mean of a ring's [lng, lat] vertices, the closing one included."""
    mean = lambda i: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[i]) / F.size(ring)
    return F.struct(mean(1).alias("lat"), mean(0).alias("lng"))


def footprint_sqft(ring: Column) -> Column:
    """Shoelace area of a ring of [lng, lat], whole square feet, null for none.

    The products are summed exactly, over vertices to twelve decimals of a degree: in doubles they lose the digits
    that make up a small ring far from the origin, and with them whole feet of it. Null too where a coordinate is no
    number or has more than four places before the point.
    """
    lat0 = F.radians(centroid(ring)["lat"])
    exact = lambda v: v.try_cast("decimal(16,12)")
    cross = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1)), lambda p, q: exact(p[0]) * exact(q[1]) - exact(q[0]) * exact(p[1]))
    twice = F.aggregate(cross, F.lit(0).cast("decimal(36,24)"), lambda s, x: (s + x).cast("decimal(36,24)"))
    area = F.abs(twice).cast("double") / 2 * (METRES_PER_DEGREE * METRES_PER_DEGREE) * F.cos(lat0) * SQFT_PER_SQM
    return F.nullif(F.floor(area).cast("bigint"), F.lit(0))


def inside(ring: Column, lat: Column, lng: Column) -> Column:
    """Ray casting against the outer ring of [lng, lat]."""
    after = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, after, lambda p, q: F.when((p[1] > lat) != (q[1] > lat), lng < (q[0] - p[0]) * (lat - p[1]) / F.nullif(q[1] - p[1], F.lit(0.0)) + p[0]).otherwise(False))
    return F.size(F.filter(crosses, lambda c: c)) % 2 == 1


def cells(low: Column, high: Column, size: float) -> Column:
    """Grid cells that an interval touches."""
    return F.sequence(F.floor(low / size), F.floor(high / size))
