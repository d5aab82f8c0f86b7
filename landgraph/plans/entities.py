"""Folds, entity resolution, spatial, identifier and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgraph.functions import text as T
from landgraph.functions import values as V
from landgraph.operators import folds, relational, resolution, rules, spatial
from landgraph.plans.naming import book
from landgraph.session import table

QUERIES, SQL, query = book()


def _mentions(spark, d):
    """Orders as mentions: a name per part, in a total order, with a date that may be empty."""
    o = table(spark, d, "orders")
    day = F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    phone = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderkey").cast("string"))
    return o.select("o_custkey", "o_orderkey", day.alias("day"), phone.alias("phone"), F.col("o_orderstatus").alias("title"))


_MENTIONS = """m AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS phone, o_orderstatus AS title FROM orders)"""
_FOLD = """WITH {mentions}, p AS (SELECT *, max(day) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM m),
s AS (SELECT *, best IS NULL OR {beats} AS setter FROM p)
SELECT o_custkey, count(*) AS n, coalesce(min(day) FILTER (WHERE day <> ''), '') AS first_date, max(day) AS last_date,
  coalesce(arg_max(phone, o_orderkey) FILTER (WHERE setter AND phone <> ''), '') AS phone, coalesce(arg_max(title, o_orderkey) FILTER (WHERE setter AND title <> ''), '') AS title FROM s GROUP BY 1"""


@query(_FOLD.format(mentions=_MENTIONS, beats="(day <> '' AND day > best)"))
def e1_d12_contact_fold(spark, d):
    return folds.fold_latest(_mentions(spark, d), ["o_custkey"], ["o_orderkey"], "day", ["phone", "title"], ties_win=False)


@query(_FOLD.format(mentions=_MENTIONS, beats="day >= best"))
def e2_d13_property_fold(spark, d):
    return folds.fold_latest(_mentions(spark, d), ["o_custkey"], ["o_orderkey"], "day", ["phone", "title"], ties_win=True)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 10 * CAST(l_returnflag = 'N' AS INT) + 5 * CAST(l_discount > 0.05 AS INT) + 3 * CAST(l_tax > 0.04 AS INT) + CAST(l_quantity > 25 AS INT) AS score FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, l_partkey, l_suppkey) = 1""")
def e3_h70_best_candidate(spark, d):
    flag = lambda c, n: F.when(c, n).otherwise(0)
    score = flag(F.col("l_returnflag") == "N", 10) + flag(F.col("l_discount") > 0.05, 5) + flag(F.col("l_tax") > 0.04, 3) + flag(F.col("l_quantity") > 25, 1)
    rows = table(spark, d, "lineitem").withColumn("score", score)
    return folds.best_per_key(rows, ["l_orderkey"], F.desc("score"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")).select("l_orderkey", "l_linenumber", "l_partkey", "score")


@query("""WITH e AS (SELECT event_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS pin, ts FROM events)
SELECT event_id, pin FROM e WHERE pin IS NULL UNION ALL SELECT event_id, pin FROM (SELECT * FROM e WHERE pin IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pin ORDER BY ts DESC, event_id) = 1)""")
def e4_latest_per_key(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("pin"), "ts")
    return folds.latest_per_key(e, "pin", F.desc("ts"), F.asc("event_id")).select("event_id", "pin")


@query("SELECT doc_id, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY lower(text)) THEN min(doc_id) OVER (PARTITION BY lower(text)) END AS dedup_of FROM documents")
def e5_e9_duplicate_pointer(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("same"))
    return folds.duplicate_pointer(rows, "same", "doc_id").select("doc_id", "dedup_of")


@query("""WITH p AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(text)) AS first FROM documents) SELECT p.doc_id, d.n_chars FROM p JOIN documents d ON p.first = d.doc_id""")
def e10_propagated_result(spark, d):
    docs = table(spark, d, "documents")
    rows = folds.duplicate_pointer(docs.select("doc_id", F.sha2(F.lower("text"), 256).alias("same")), "same", "doc_id")
    rows = rows.withColumn("first", F.coalesce("dedup_of", "doc_id"))
    return rows.select("doc_id", "first").join(docs.select(F.col("doc_id").alias("first"), "n_chars"), "first").select("doc_id", "n_chars")


@query("SELECT s_suppkey, printf('SUP_%05d', row_number() OVER (ORDER BY s_name, s_suppkey)) AS id FROM supplier")
def e6_dense_ids(spark, d):
    return relational.ranked_ids(table(spark, d, "supplier"), [F.col("s_name"), F.col("s_suppkey")], "SUP_%05d", "id").select("s_suppkey", "id")


@query("""WITH r AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS n FROM (SELECT DISTINCT p_brand FROM part WHERE p_partkey < 10)),
k AS (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY 1), f AS (SELECT p_brand, (SELECT max(n) FROM r) + row_number() OVER (ORDER BY first, p_brand) AS n FROM k WHERE p_brand NOT IN (SELECT p_brand FROM r))
SELECT p_brand, n, printf('GRP_%05d', n) AS id FROM (SELECT * FROM r UNION ALL SELECT * FROM f)""")
def e7_e8_i6_id_registry(spark, d):
    p = table(spark, d, "part")
    registry = relational.ranked_ids(p.filter("p_partkey < 10").select("p_brand").distinct(), [F.col("p_brand")], "%d", "n").withColumn("n", F.col("n").cast("long"))
    keys = p.groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    return folds.registered_ids(keys, registry, "p_brand", "first", "GRP_%05d")


@query("""WITH s AS (SELECT *, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM s)
SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n FROM i GROUP BY user_id, island""")
def e11_e12_islands(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("before", F.lag("event_type").over(w))
    rows = folds.islands(e, ["user_id"], ["ts", "event_id"], F.col("before").isNull() | (F.col("before") != F.col("event_type")))
    return rows.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1")
def e13_d16_latest_filtered(spark, d):
    return table(spark, d, "orders").filter("o_orderpriority <> '5-LOW'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("""WITH g AS (SELECT p_name AS name, trim(regexp_replace(upper(p_name), ' COMPANY$', '')) AS group_key, p_partkey AS seq, p_brand, p_size FROM part)
SELECT group_key, arg_min(name, seq) AS display_name, count(*) AS n_mentions, count(DISTINCT p_brand) FILTER (WHERE p_size > 25) AS n_items, min(name) AS variant, count(DISTINCT name) AS n_variants FROM g WHERE group_key <> '' GROUP BY 1""")
def d11_group_fold(spark, d):
    return resolution.resolve_groups(table(spark, d, "part"), "p_name", ["p_partkey"], "p_brand", F.col("p_size") > 25)


@query("""WITH c AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) SELECT n_nationkey, coalesce(n, 0) AS n FROM nation LEFT JOIN c ON n_nationkey = s_nationkey""")
def d14_d28_zero_filled(spark, d):
    c = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "nation").select("n_nationkey").join(c, "n_nationkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("""WITH f AS (SELECT lang, unnest(['number', 'shout', 'bar', 'license']) AS tag, unnest([regexp_matches(text, '[0-9]'), contains(text, '!!'), contains(text, ' | '), contains(lower(text), 'license')]) AS hit FROM documents)
SELECT lang, tag, count(*) AS n FROM f WHERE hit GROUP BY ALL""")
def d19_h22_j8_contingency(spark, d):
    found = T.tags(F.col("text"), {"number": "[0-9]", "shout": "!!", "bar": r" \| ", "license": "(?i)license"})
    return table(spark, d, "documents").select("lang", F.explode(found).alias("tag")).groupBy("lang", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_partkey, arg_max(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS number FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def d20_pin_to_number(spark, d):
    rows = table(spark, d, "lineitem").filter("l_returnflag <> 'N'")
    return rows.groupBy("l_partkey").agg(F.max_by("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("number"))


@query("""WITH a AS (SELECT o_orderpriority AS rule, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS now, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS before FROM orders GROUP BY 1)
SELECT rule, now, before, abs(now - before) * 100.0 / before > 1.0 AS drifted FROM a""")
def d24_j7_drift(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("rule")).agg(F.count_if(F.col("o_orderkey") % 2 == 0).alias("now"), F.count_if(F.col("o_orderkey") % 2 == 1).alias("before"))
    return a.withColumn("drifted", rules.drift(F.col("now"), F.col("before"), 1.0))


@query("""WITH b AS (SELECT o_custkey AS k, max(o_orderpriority) AS owner, max(o_orderkey) AS ref FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
m AS (SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS owner FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(b.k, m.k) AS k, coalesce(nullif(m.owner, ''), b.owner) AS owner, CASE WHEN b.k IS NULL THEN -1 ELSE ref END AS ref, b.k IS NULL AS created FROM b FULL JOIN m ON b.k = m.k""")
def c21_i8_enrich(spark, d):
    b = table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("owner"), F.max("o_orderkey").alias("ref"))
    m = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("owner"))
    return resolution.enrich(b, m, "k", ["owner"], "created", {"ref": F.lit(-1)})


@query("""WITH a AS (SELECT o_custkey, strftime(max(o_orderdate) FILTER (WHERE o_orderstatus = 'F'), '%Y-%m-%d') AS d1, strftime(max(o_orderdate) FILTER (WHERE o_orderstatus = 'P'), '%Y-%m-%d') AS d2 FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN coalesce(d2, '') > coalesce(d1, '') THEN d2 ELSE d1 END AS day, CASE WHEN coalesce(d2, '') > coalesce(d1, '') THEN 'GW' ELSE 'RT' END AS source FROM a""")
def i8_newer_sale(spark, d):
    last = lambda s: F.date_format(F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderdate"))), "yyyy-MM-dd")
    a = table(spark, d, "orders").groupBy("o_custkey").agg(last("F").alias("d1"), last("P").alias("d2"))
    s = resolution.newer_sale(F.col("d1"), F.lit(0), F.lit("RT"), F.col("d2"), F.lit(0), "GW")
    return a.select("o_custkey", s["date"].alias("day"), s["source"].alias("source"))


@query("""WITH k AS (SELECT l_partkey, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS bridged FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT p_partkey, bridged FROM part LEFT JOIN k ON p_partkey = l_partkey WHERE p_size < 10""")
def c19_c20_pin_bridge(spark, d):
    known = table(spark, d, "lineitem").filter("l_quantity > 45").withColumnsRenamed({"l_partkey": "p_partkey"})
    known = known.withColumn("number", F.col("l_suppkey").cast("string"))
    out = resolution.bridge(table(spark, d, "part").filter("p_size < 10").select("p_partkey"), known, "p_partkey", "number", ["l_orderkey", "l_linenumber", "l_suppkey"])
    return out.withColumn("bridged", F.col("bridged").cast("long"))


@query("""WITH p AS (SELECT event_id, value AS x, CAST(user_id AS DOUBLE) / 10 AS y FROM events), b AS (SELECT p_partkey, p_size - 1.5 AS x0, p_size + 1.5 AS x1, p_partkey % 16 AS y0, p_partkey % 16 + 1 AS y1 FROM part)
SELECT event_id, p_partkey FROM p JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def c8_b3_grid_join(spark, d):
    p = table(spark, d, "events").select("event_id", F.col("value").alias("x"), (F.col("user_id").cast("double") / 10).alias("y"))
    b = table(spark, d, "part").select("p_partkey", (F.col("p_size") - 1.5).alias("x0"), (F.col("p_size") + 1.5).alias("x1"), (F.col("p_partkey") % 16).cast("double").alias("y0"), (F.col("p_partkey") % 16 + 1).cast("double").alias("y1"))
    return spatial.grid_join(p, b, 2.0).select("event_id", "p_partkey")


@query("""WITH p AS (SELECT event_id, value AS x, CAST(user_id AS DOUBLE) / 10 AS y FROM events),
t AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS ax, CAST(p_partkey % 16 AS DOUBLE) AS ay FROM part),
h AS (SELECT event_id, p_partkey, x, y, ax, ay FROM p JOIN t ON x BETWEEN ax AND ax + 4 AND y BETWEEN ay AND ay + 2),
c AS (SELECT event_id, p_partkey, (y < ay + 2 AND y >= ay AND x < ax + 4 - (y - ay) * 2.0) AND x >= ax AS hit FROM h)
SELECT event_id, min(p_partkey) AS p_partkey FROM c WHERE hit AND true GROUP BY 1""")
def c8_h60_point_in_polygon(spark, d):
    p = table(spark, d, "events").select("event_id", F.col("value").alias("x"), (F.col("user_id").cast("double") / 10).alias("y"))
    ax, ay = F.col("p_size").cast("double"), (F.col("p_partkey") % 16).cast("double")
    ring = F.array(F.array(ax, ay), F.array(ax + 4, ay), F.array(ax, ay + 2))
    parcels = table(spark, d, "part").select("p_partkey", ring.alias("ring"))
    return spatial.point_in_parcel(p, parcels, "event_id", "p_partkey", 2.0, levels=2)


@query("""WITH p AS (SELECT event_id, value AS x, CAST(user_id AS DOUBLE) / 10 AS y FROM events), q AS (SELECT s_suppkey, s_suppkey * CAST(0.9 AS DOUBLE) AS px, s_nationkey * CAST(0.6 AS DOUBLE) AS py FROM supplier),
m AS (SELECT event_id, s_suppkey, CASE WHEN greatest(abs(x - px), abs(y - py)) <= 0.5 THEN 0 WHEN greatest(abs(x - px), abs(y - py)) <= 1.5 THEN 1 WHEN greatest(abs(x - px), abs(y - py)) <= 4.5 THEN 2 END AS tier, (x - px) * (x - px) + (y - py) * (y - py) AS away FROM p JOIN q ON abs(x - px) <= 4.6 AND abs(y - py) <= 4.6)
SELECT event_id, arg_min(s_suppkey, (tier, away, s_suppkey)) AS s_suppkey, min(tier) AS tier FROM m WHERE tier IS NOT NULL GROUP BY 1""")
def c9_c10_nearest_within(spark, d):
    p = table(spark, d, "events").select("event_id", F.col("value").alias("x"), (F.col("user_id").cast("double") / 10).alias("y"))
    q = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * F.lit(0.9)).alias("x"), (F.col("s_nationkey") * F.lit(0.6)).alias("y"))
    return spatial.nearest_within(p, q, "event_id", "s_suppkey", (0.5, 1.5, 4.5))


@query("""SELECT s_suppkey, CAST(round(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 3) AS DOUBLE) AS metres FROM (SELECT s_suppkey,
  pow(sin(radians(s_suppkey * 0.01) / 2), 2) + cos(radians(43.0)) * cos(radians(43.0 + s_suppkey * 0.01)) * pow(sin(radians(s_nationkey * 0.02) / 2), 2) AS h FROM supplier)""")
def h58_haversine(spark, d):
    m = V.haversine(F.lit(43.0), F.lit(-79.0), F.lit(43.0) + F.col("s_suppkey") * F.lit(0.01), F.lit(-79.0) + F.col("s_nationkey") * F.lit(0.02))
    return table(spark, d, "supplier").select("s_suppkey", F.round(m, 3).alias("metres"))


@query("""SELECT s_suppkey, round((43.0 + 43.0 + 43.01 + 43.01 + 43.0) / 5, 6) AS lat, CAST(nullif(floor(0.01 * (0.01 + s_suppkey * 0.001) * 111320.0 * 111320.0 * cos(radians((43.0 + 43.0 + 43.01 + 43.01 + 43.0) / 5)) * 10.764 / 1000), 0) AS BIGINT) AS ksqft FROM supplier""")
def h59_h61_centroid_and_area(spark, d):
    w = F.lit(0.01) + F.col("s_suppkey") * F.lit(0.001)
    x = F.lit(0.0)
    ring = F.array(F.array(x, F.lit(43.0)), F.array(x + w, F.lit(43.0)), F.array(x + w, F.lit(43.01)), F.array(x, F.lit(43.01)), F.array(x, F.lit(43.0)))
    rows = table(spark, d, "supplier").withColumn("ring", ring)
    return rows.select("s_suppkey", F.round(V.centroid(F.col("ring"))["lat"], 6).alias("lat"), F.floor(V.footprint_sqft(F.col("ring")) / 1000).cast("bigint").alias("ksqft"))


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 3 > 0 AS hn, o_orderkey % 5 > 0 AS hp, CASE WHEN o_orderkey % 4 > 0 THEN 'A' || o_custkey END AS nh, CASE WHEN o_orderkey % 7 > 0 THEN 'A' || (o_custkey + CAST(o_orderkey % 2 AS BIGINT)) END AS sh, CAST(o_orderkey % 1000 AS DOUBLE) AS m, o_orderkey % 2 = 0 AS c FROM orders)
SELECT o_orderkey, CASE WHEN hn AND hp AND nh = sh THEN 'arn_verified' WHEN hn AND hp AND nh IS NOT NULL AND sh IS NOT NULL THEN 'spatial_override' WHEN hn AND hp AND nh IS NOT NULL AND m > 500 THEN 'unresolved'
 WHEN hn AND hp AND nh IS NOT NULL THEN CASE WHEN c THEN 'arn_cache' ELSE 'arn_api' END WHEN hn AND hp AND sh IS NOT NULL THEN 'spatial_geocode' WHEN hn AND hp THEN 'unresolved' WHEN hn AND nh IS NOT NULL THEN 'arn_unverified' WHEN hn THEN 'unresolved' WHEN hp AND sh IS NOT NULL THEN 'spatial_geocode' ELSE 'unresolved' END AS method FROM r""")
def i5_resolution_chain(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    nh = F.when(k % 4 > 0, F.concat(F.lit("A"), c.cast("string")))
    sh = F.when(k % 7 > 0, F.concat(F.lit("A"), (c + k % 2).cast("string")))
    return table(spark, d, "orders").select("o_orderkey", spatial.resolution(k % 3 > 0, k % 5 > 0, nh, sh, (k % 1000).cast("double"), k % 2 == 0)["method"].alias("method"))


@query("""SELECT c_custkey, upper(trim(regexp_replace(replace(c_name, '#', '  '), '\\s+', ' ', 'g'))) AS fp, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS brand, split_part(replace(c_name, '#', ' '), ' ', 1) AS first, split_part(replace(c_name, '#', ' '), ' ', 2) AS rest FROM customer""")
def h13_h15_h16_names(spark, d):
    spaced = F.replace("c_name", F.lit("#"), F.lit("  "))
    return table(spark, d, "customer").select("c_custkey", T.fingerprint(spaced).alias("fp"), T.brand_key(F.col("c_name")).alias("brand"), T.first_name(spaced).alias("first"), T.other_names(spaced).alias("rest"))


@query("""SELECT DISTINCT p_name, trim(regexp_replace(regexp_replace(upper(p_name) || CASE WHEN p_size > 25 THEN ' INC LTD' ELSE ' LTD INC' END, ' INC$', ''), ' LTD$', '')) AS key FROM part""")
def h14_i3_group_name(spark, d):
    raw = F.concat("p_name", F.when(F.col("p_size") > 25, " INC LTD").otherwise(" LTD INC"))
    return table(spark, d, "part").select("p_name", T.group_name(raw).alias("key")).distinct()


@query("""SELECT p_partkey, rpad(CAST(p_partkey AS VARCHAR), CAST(greatest(9, len(CAST(p_partkey AS VARCHAR))) AS INT), '0') AS pin_right, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS pin_left,
  CASE WHEN len(digits) BETWEEN 13 AND 20 AND NOT regexp_matches(digits, '^0+$') THEN rpad(digits, 20, '0') ELSE '' END AS roll FROM (SELECT p_partkey, repeat(CAST(p_partkey AS VARCHAR), 4) || CAST(p_size AS VARCHAR) AS digits FROM part)""")
def h47_h48_identifiers(spark, d):
    key = F.col("p_partkey").cast("string")
    raw = F.concat(F.repeat(F.concat(key, F.lit("-")), 4), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", V.pin(key).alias("pin_right"), V.pin(key, left=True).alias("pin_left"), V.roll_number(raw).alias("roll"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%d') AS b, true AS same, true AS iso FROM orders""")
def h51_h54_dates(spark, d):
    o = table(spark, d, "orders")
    a, b = F.date_format("o_orderdate", "d MMM yyyy"), F.date_format("o_orderdate", "MM/dd/yyyy")
    return o.select("o_orderkey", V.iso_date(a, "d MMM yyyy").alias("a"), V.iso_date(b, "d MMM yyyy", "MM/dd/yyyy").alias("b"), V.same_date(a, "d MMM yyyy", b, "MM/dd/yyyy").alias("same"), V.is_iso(V.iso_date(a, "d MMM yyyy")).alias("iso"))


@query("""SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, CASE WHEN floor(o_totalprice) >= 1000 THEN '$' || CAST(floor(floor(o_totalprice) / 1000) AS BIGINT) || 'K' ELSE '$' || CAST(floor(o_totalprice) AS BIGINT) END AS compact FROM orders""")
def h55_h57_h20_money(spark, d):
    shown = T.currency(F.floor("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", V.whole_money(shown).alias("whole"), T.compact_money(F.floor("o_totalprice").cast("double")).alias("compact"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN round(l_quantity, 2) WHEN 1 THEN round(l_quantity * 2.4710538146717, 2) WHEN 2 THEN round(l_quantity * 1000 / 43560.0, 2) ELSE NULL END AS acres FROM lineitem""")
def h56_site_area(spark, d):
    q = F.col("l_quantity").cast("int")
    raw = F.when(q % 4 == 0, F.concat(q.cast("string"), F.lit(" acres"))).when(q % 4 == 1, F.concat(q.cast("string"), F.lit(" ha"))).when(q % 4 == 2, F.concat(F.format_number(q * 1000, 0), F.lit(" sq ft"))).otherwise(F.lit("irregular"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", V.site_acres(raw).alias("acres"))


@query("""SELECT * FROM (SELECT doc_id AS id, 'short_text' AS rule, 'error' AS severity, 'text' AS field, CAST(n_chars AS VARCHAR) AS value FROM documents WHERE n_chars < 100
UNION ALL SELECT doc_id, 'shouting', 'warning', 'text', '!!' FROM documents WHERE contains(text, '!!') UNION ALL SELECT doc_id, 'phone_in_text', 'error', 'text', regexp_extract(text, '[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}') FROM documents WHERE regexp_matches(text, '[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}'))""")
def j1_j3_quality_rules(spark, d):
    x, phone = F.col("text"), "[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}"
    found = [("short_text", "error", "text", F.col("n_chars") < 100, F.col("n_chars")), ("shouting", "warning", "text", F.contains(x, F.lit("!!")), F.lit("!!")), ("phone_in_text", "error", "text", x.rlike(phone), F.regexp_extract(x, phone, 0))]
    return rules.issues(table(spark, d, "documents").withColumnRenamed("doc_id", "id"), "id", found)


@query("""WITH i AS (SELECT 'short' AS rule FROM documents WHERE n_chars < 100 UNION ALL SELECT 'shouting' FROM documents WHERE contains(text, '!!')), c AS (SELECT unnest(['short', 'shouting', 'unused']) AS rule)
SELECT c.rule, count(i.rule) AS n FROM c LEFT JOIN i ON c.rule = i.rule GROUP BY 1""")
def j2_d26_rule_catalogue(spark, d):
    cat = spark.createDataFrame([("short",), ("shouting",), ("unused",)], "rule string")
    found = rules.issues(table(spark, d, "documents"), "doc_id", [("short", "e", "text", F.col("n_chars") < 100, F.lit("")), ("shouting", "w", "text", F.contains("text", F.lit("!!")), F.lit(""))])
    return rules.rule_counts(cat, found)


@query("""WITH old AS (SELECT o_orderkey AS id, 'r' || o_orderkey % 3 AS rule, CASE WHEN o_orderkey % 4 = 0 THEN 'closed' ELSE 'open' END AS status FROM orders WHERE o_orderstatus <> 'P'), new AS (SELECT o_orderkey AS id, 'r' || o_orderkey % 3 AS rule FROM orders WHERE o_orderstatus <> 'O')
SELECT id, rule, status FROM old WHERE NOT (status = 'open' AND rule = 'r1') UNION ALL SELECT id, rule, 'open' FROM new WHERE rule = 'r1'""")
def j4_rescan(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("r"), (F.col("o_orderkey") % 3).cast("string")).alias("rule"), "o_orderstatus")
    old = o.filter("o_orderstatus <> 'P'").drop("o_orderstatus").withColumn("status", F.when(F.col("id") % 4 == 0, "closed").otherwise("open"))
    return rules.rescan(old, o.filter("o_orderstatus <> 'O'").drop("o_orderstatus"), F.col("rule") == "r1")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN NOT contains(l_returnflag || l_linestatus, 'F') THEN 'line' WHEN NOT contains(o_orderstatus, 'F') THEN 'order' ELSE 'source' END AS cause FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def j5_root_cause(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    cause = rules.root_cause(F.lit("F"), [("order", F.col("o_orderstatus")), ("line", F.concat("l_returnflag", "l_linestatus"))])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", cause.alias("cause"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'bad_id' WHEN value < 1 THEN 'outside' END AS reason FROM events""")
def a16_validated_import(spark, d):
    from landgraph.sources.files import reject_reason

    pid = F.when(F.col("event_type") != "error", F.concat(F.lit("node/"), F.col("event_id").cast("string")))
    lat = F.when(F.col("value") < 1, 10.0).otherwise(45.0)
    return table(spark, d, "events").select("event_id", reject_reason(pid, F.col("event_type"), lat, F.lit(-80.0)).alias("reason"))
