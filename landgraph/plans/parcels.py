"""The resolution chain and the point query, over lots laid out by customer and points of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgraph.operators import parcels as P
from landgraph.plans.naming import book
from landgraph.session import table

QUERIES, SQL, query = book()


def _corner(key, spread):
    """South-west corner of a customer's lot, and the lot's width."""
    return (key % 40) / 100 - 80, F.floor(key / 40) / 100 + 43, (spread + 10) / 10_000


def _lots(spark, d):
    c = table(spark, d, "customer")
    x, y, w = _corner(F.col("c_custkey"), F.col("c_nationkey"))
    ring = F.array(F.array(x, y), F.array(x + w, y), F.array(x, y + w))
    return c.select(F.lpad(F.col("c_custkey").cast("string"), 20, "0").alias("number"), F.when(F.col("c_acctbal") >= 0, ring).alias("ring"))


def _points(spark, d):
    """A point beside each order's lot, the farther the more its price differs from the middle."""
    o = table(spark, d, "orders")
    x, y, _ = _corner(F.col("o_custkey"), F.lit(0))
    u = F.col("o_totalprice") / 250_000 - 1
    return o.select("*", (x + u * u * u / 250 + 0.0003).alias("x"), (y + 0.0003).alias("y"))


_LOTS = """lot AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 20, '0') AS number, c_acctbal, c_mktsegment,
  CAST(c_custkey % 40 AS DOUBLE) / 100 - 80 AS x0, CAST(c_custkey // 40 AS DOUBLE) / 100 + 43 AS y0, CAST(c_nationkey + 10 AS DOUBLE) / 10000 AS w FROM customer),
shape AS (SELECT *, (x0 + (x0 + w) + x0) / 3 AS cx, (y0 + y0 + (y0 + w)) / 3 AS cy FROM lot WHERE c_acctbal >= 0),
pt AS (SELECT *, CAST(o_custkey % 40 AS DOUBLE) / 100 - 80 + u * u * u / 250 + CAST(0.0003 AS DOUBLE) AS x, CAST(o_custkey // 40 AS DOUBLE) / 100 + 43 + CAST(0.0003 AS DOUBLE) AS y
  FROM (SELECT *, o_totalprice / 250000 - 1 AS u FROM orders)),
met AS (SELECT o_orderkey, number, x, y, cx, cy, y >= y0 AND y < y0 + w AND x >= x0 AND x < x0 + w - (y - y0) AS inside,
    x BETWEEN x0 - CAST(0.0002 AS DOUBLE) AND x0 + w + CAST(0.0002 AS DOUBLE) AND y BETWEEN y0 - CAST(0.0002 AS DOUBLE) AND y0 + w + CAST(0.0002 AS DOUBLE) AS close
  FROM pt JOIN shape ON x BETWEEN x0 - CAST(0.0018 AS DOUBLE) AND x0 + w + CAST(0.0018 AS DOUBLE) AND y BETWEEN y0 - CAST(0.0018 AS DOUBLE) AND y0 + w + CAST(0.0018 AS DOUBLE)),
hit AS (SELECT o_orderkey, CASE WHEN bool_or(inside) THEN min(number) FILTER (WHERE inside) ELSE arg_min(number, ((cx - x) * (cx - x) + (cy - y) * (cy - y), number)) END AS number,
    CASE WHEN bool_or(inside) THEN 0 ELSE 1 END AS tier FROM met GROUP BY 1 HAVING bool_or(inside) OR bool_or(close))"""


@query(f"WITH {_LOTS} SELECT pt.o_orderkey, number, tier FROM pt LEFT JOIN hit ON pt.o_orderkey = hit.o_orderkey")
def c9_point_query(spark, d):
    """The parcel that holds a point, else the nearest one of a wider envelope, else none."""
    points = _points(spark, d).select("o_orderkey", "x", "y")
    return points.select("o_orderkey").join(P.point_lookup(points, _lots(spark, d), "o_orderkey"), "o_orderkey", "left")


@query(f"""WITH {_LOTS},
rec AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN lpad(CAST(o_custkey + 1 AS VARCHAR), 20, '0') ELSE lpad(CAST(o_custkey AS VARCHAR), 20, '0') END AS n,
    o_orderstatus <> 'P' AS placed, CAST(o_custkey AS VARCHAR) AS pin, x, y FROM pt),
num AS (SELECT number, CASE WHEN c_acctbal <= 9000 THEN (y0 + y0 + (y0 + w)) / 3 END AS cy, CASE WHEN c_acctbal <= 9000 THEN (x0 + (x0 + w) + x0) / 3 END AS cx, true AS cached FROM lot WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT number, cy, cx, false FROM shape WHERE c_mktsegment <> 'BUILDING'),
g AS (SELECT rec.*, num.number AS nh, cached, pow(sin(radians(cy - y) / 2), 2) + cos(radians(y)) * cos(radians(cy)) * pow(sin(radians(cx - x) / 2), 2) AS h FROM rec LEFT JOIN num ON n = num.number AND n <> ''),
c AS (SELECT g.*, n <> '' AS hn, CASE WHEN placed THEN 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) END AS metres, CASE WHEN placed AND regexp_matches(number, '[^0]') THEN number END AS sh FROM g LEFT JOIN hit USING (o_orderkey)),
r AS (SELECT o_orderkey, n, pin,
  CASE WHEN hn AND placed AND nh = sh THEN 'arn_verified' WHEN hn AND placed AND nh IS NOT NULL AND sh IS NOT NULL THEN 'spatial_override' WHEN hn AND placed AND nh IS NOT NULL AND metres > 500 THEN 'unresolved'
    WHEN hn AND placed AND nh IS NOT NULL THEN CASE WHEN cached THEN 'arn_cache' ELSE 'arn_api' END WHEN placed AND sh IS NOT NULL THEN 'spatial_geocode' WHEN hn AND nh IS NOT NULL AND NOT placed THEN 'arn_unverified' ELSE 'unresolved' END AS method,
  CASE WHEN placed AND sh IS NOT NULL THEN sh WHEN hn AND nh IS NOT NULL AND (NOT placed OR metres IS NULL OR metres <= 500) THEN nh END AS resolved,
  CASE WHEN hn AND placed AND sh IS NOT NULL AND nh <> sh THEN 'arn_was_' || nh WHEN placed AND sh IS NOT NULL THEN NULL WHEN hn AND placed AND nh IS NOT NULL THEN CASE WHEN metres > 500 THEN 'arn_too_far_' || CAST(floor(metres) AS BIGINT) || 'm' END
    WHEN hn AND placed THEN 'both_failed' WHEN hn AND nh IS NULL THEN 'arn_api_miss' WHEN hn THEN NULL WHEN placed THEN 'spatial_miss' ELSE 'no_identifiers' END AS reason FROM c),
b AS (SELECT CAST(s_suppkey AS VARCHAR) AS pin, lpad(CAST(s_suppkey AS VARCHAR), 20, '0') AS bridged FROM supplier WHERE s_acctbal >= 0 AND s_suppkey > 0)
SELECT o_orderkey, CASE WHEN o THEN 'pin_gw' ELSE method END AS method, CASE WHEN o THEN bridged ELSE resolved END AS resolved, CASE WHEN o THEN NULL ELSE reason END AS reason
FROM (SELECT r.*, bridged, resolved IS NULL AND NOT regexp_matches(n, '[^0]') AND bridged IS NOT NULL AS o FROM r LEFT JOIN b USING (pin))""")
def i5_resolution_by_tiers(spark, d):
    """Numbers, points and PINs of orders against the lots, the cache of some of them, and suppliers as the bridge."""
    key = F.col("o_custkey")
    number = lambda k: F.lpad(k.cast("string"), 20, "0")
    claimed = F.when(F.col("o_orderpriority") == "5-LOW", "").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", number(key + 1)).otherwise(number(key))
    placed = F.col("o_orderstatus") != "P"
    records = _points(spark, d).select(F.col("o_orderkey").alias("id"), claimed.alias("number"), F.when(placed, F.col("y")).alias("lat"), F.when(placed, F.col("x")).alias("lng"), key.cast("string").alias("pin"))
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    x, y, w = _corner(F.col("c_custkey"), F.col("c_nationkey"))
    known = F.col("c_acctbal") <= 9000
    cache = c.select(number(F.col("c_custkey")).alias("number"), F.when(known, (y + y + (y + w)) / 3).alias("lat"), F.when(known, (x + (x + w) + x) / 3).alias("lng"))
    s = table(spark, d, "supplier")
    bridge = s.select(F.col("s_suppkey").cast("string").alias("pin"), F.when(F.col("s_acctbal") >= 0, number(F.col("s_suppkey"))).otherwise("").alias("number"), F.col("s_suppkey").alias("seq"))
    return P.resolve_records(records, cache, _lots(spark, d), bridge).withColumnRenamed("id", "o_orderkey")
