"""Browse, join, count, sort and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from landgraph.operators import relational as R
from landgraph.plans.naming import book
from landgraph.session import table

QUERIES, SQL, query = book()


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 100000 AND 300000
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 20""")
def b1_browse_page(spark, d):
    price = F.col("o_totalprice")
    rows = R.where_all(table(spark, d, "orders"), F.col("o_orderstatus") == "F", None, price >= 100000, price <= 300000)
    key = R.sort_key({"price": price, "id": F.col("o_orderkey")}, "price", "desc", "id")
    return R.page(rows, key, F.asc("o_orderkey"), number=2, size=20).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND user_id < 50 AND value >= 5 AND value <= 40")
def b2_event_filters(spark, d):
    return R.where_all(table(spark, d, "events"), F.col("event_type") == "purchase", F.col("user_id") < 50, F.col("value") >= 5, F.col("value") <= 40).select("event_id", "user_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount BETWEEN 0.02 AND 0.04 AND l_quantity IS NOT NULL")
def b3_bounding_box(spark, d):
    return table(spark, d, "lineitem").filter(F.col("l_quantity").between(10, 12) & F.col("l_discount").between(0.02, 0.04) & F.col("l_quantity").isNotNull()).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' OR p_type LIKE 'ECO_OMY%'")
def b4_like(spark, d):
    return table(spark, d, "part").filter(F.col("p_name").ilike("%RING%") | F.col("p_type").like("ECO_OMY%")).select("p_partkey", "p_name")


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, ''), 'none') AS segment FROM customer WHERE c_mktsegment IS NOT NULL AND c_mktsegment <> 'MACHINERY'")
def b6_null_and_empty(spark, d):
    rows = table(spark, d, "customer").filter(F.col("c_mktsegment").isNotNull() & (F.col("c_mktsegment") != "MACHINERY"))
    return rows.select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("")), F.lit("none")).alias("segment"))


@query("SELECT s_suppkey, coalesce(n_name, '') AS place, 'supplier' AS source FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 1")
def b7_b8_coalesced_source(spark, d):
    nations = table(spark, d, "nation").filter("n_regionkey = 1")
    rows = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("s_suppkey", F.coalesce("n_name", F.lit("")).alias("place"), F.lit("supplier").alias("source"))


@query("""SELECT o_orderkey, '{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '","party":{"id":' || o_custkey || '}}' AS record FROM orders""")
def b9_reshape(spark, d):
    rec = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("id")).alias("party"))
    return table(spark, d, "orders").select("o_orderkey", F.to_json(rec).alias("record"))


@query("""WITH o AS (SELECT l_orderkey, list(l_quantity) AS q, list(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, len(list_filter(q, lambda x: x > 45)) > 0 AS bulky, list_contains(f, 'R') AS returned FROM o""")
def b12_exists_in_arrays(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"), F.collect_list("l_returnflag").alias("f"))
    return o.select("l_orderkey", F.exists("q", lambda x: x > 45).alias("bulky"), F.exists("f", lambda x: x == "R").alias("returned"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND coalesce(c_acctbal, 0) >= 1000")
def b13_hard_filters(spark, d):
    return table(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.coalesce("c_acctbal", F.lit(0)) >= 1000)).select("c_custkey")


@query("""WITH b AS (SELECT l_orderkey, list(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT l_orderkey, CAST(list_has_any(brands, ['Brand#1', 'Brand#7']) AS INT) AS matched FROM b""")
def b14_soft_filter(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    b = rows.groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("brands"))
    return b.select("l_orderkey", F.arrays_overlap("brands", F.array(F.lit("Brand#1"), F.lit("Brand#7"))).cast("int").alias("matched"))


@query("SELECT DISTINCT p_brand FROM part WHERE p_brand IN ('Brand#3') OR p_type IN ('ECONOMY', 'PROMO')")
def b15_expand_brands(spark, d):
    return table(spark, d, "part").filter(F.col("p_brand").isin("Brand#3") | F.col("p_type").isin("ECONOMY", "PROMO")).select("p_brand").distinct()


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000)")
def c11_semi_join(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F' and o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey")
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def c27_anti_join(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20 LEFT JOIN region ON n_regionkey = r_regionkey")
def c13_c14_left_joins(spark, d):
    n = table(spark, d, "nation").filter("n_nationkey < 20")
    rows = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 450000")
def c15_inner_join(spark, d):
    return table(spark, d, "orders").filter("o_totalprice > 450000").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("""WITH p AS (SELECT *, l_linenumber + (l_orderkey % 2) AS pos FROM lineitem),
a AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem),
j AS (SELECT a.l_orderkey, a.l_linenumber, a.l_extendedprice AS price, p.l_extendedprice AS other FROM a LEFT JOIN p ON a.l_orderkey = p.l_orderkey AND a.l_linenumber = p.pos)
SELECT l_orderkey, l_linenumber, other IS NOT NULL AS found, other IS NULL OR price = other AS verified FROM j""")
def c1_c2_positional_join(spark, d):
    a = table(spark, d, "lineitem")
    p = a.select("l_orderkey", (F.col("l_linenumber") + F.col("l_orderkey") % 2).alias("l_linenumber"), F.col("l_extendedprice").alias("other"))
    j = a.join(p, ["l_orderkey", "l_linenumber"], "left")
    return j.select("l_orderkey", "l_linenumber", F.col("other").isNotNull().alias("found"), (F.col("other").isNull() | (F.col("l_extendedprice") == F.col("other"))).alias("verified"))


@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT o_orderkey AS bkey, o_custkey AS bcust, o_totalprice AS bprice, o_orderdate AS bdate FROM orders WHERE o_orderstatus <> 'F'),
m AS (SELECT a.o_orderkey, bkey, CASE WHEN abs(o_totalprice - bprice) < 20000 AND bdate > o_orderdate THEN 1 WHEN abs(o_totalprice - bprice) < 20000 THEN 2 END AS tier FROM a JOIN b ON o_custkey = bcust),
r AS (SELECT o_orderkey, bkey, tier, row_number() OVER (PARTITION BY o_orderkey ORDER BY tier, bkey) AS rn FROM m WHERE tier IS NOT NULL)
SELECT a.o_orderkey, r.bkey AS matched, r.tier FROM a LEFT JOIN r ON a.o_orderkey = r.o_orderkey AND rn = 1""")
def c3_fallback_match(spark, d):
    o = table(spark, d, "orders")
    a = o.filter("o_orderstatus = 'F'")
    b = o.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("bkey"), "o_custkey", F.col("o_totalprice").alias("bprice"), F.col("o_orderdate").alias("bdate"))
    near = F.abs(F.col("o_totalprice") - F.col("bprice")) < 20000
    tier = F.when(near & (F.col("bdate") > F.col("o_orderdate")), 1).when(near, 2)
    best = a.join(b, "o_custkey").withColumn("tier", tier).filter("tier is not null").groupBy("o_orderkey").agg(F.min(F.struct("tier", "bkey")).alias("m"))
    return a.join(best, "o_orderkey", "left").select("o_orderkey", F.col("m.bkey").alias("matched"), F.col("m.tier").alias("tier"))


@query("""SELECT l.l_orderkey, l_linenumber, p_name, coalesce(s_name, 'none') AS s_name FROM lineitem l JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 WHERE l_quantity > 48""")
def c4_stage_joins(spark, d):
    rows = table(spark, d, "lineitem").filter("l_quantity > 48").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(table(spark, d, "supplier").filter("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "p_name", F.coalesce("s_name", F.lit("none")).alias("s_name"))


@query("""WITH f AS (SELECT l_orderkey, min(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS first_line, max(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey)
SELECT f.l_orderkey, n, l_partkey AS primary_part FROM f LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) x ON f.l_orderkey = x.l_orderkey AND f.first_line = x.l_linenumber""")
def c5_primary_element(spark, d):
    item = F.struct("l_linenumber", "l_partkey")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"), F.min(F.when(F.col("l_returnflag") == "R", item)).alias("p"))
    return rows.select("l_orderkey", "n", F.col("p.l_partkey").alias("primary_part"))


@query("SELECT p_partkey, v.cat FROM part JOIN (VALUES ('ECONOMY', 'low'), ('STANDARD', 'mid'), ('PROMO', 'promo')) v(t, cat) ON upper(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) = v.t")
def c6_brand_dimension(spark, d):
    from landgraph.functions.text import brand_key

    dim = spark.createDataFrame([("ECONOMY", "low"), ("STANDARD", "mid"), ("PROMO", "promo")], "k string, cat string")
    return table(spark, d, "part").withColumn("k", brand_key(F.col("p_type"))).join(F.broadcast(dim), "k").select("p_partkey", "cat")


@query("""SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def c16_nested_collect(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    rows = R.nested(table(spark, d, "customer"), o, "c_custkey", ["o_orderkey", "o_totalprice"], ["o_orderkey"], "orders")
    keys = F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",")
    return rows.select("c_custkey", F.coalesce(F.size("orders"), F.lit(0)).cast("long").alias("n"), F.coalesce(keys, F.lit("")).alias("keys"))


@query("""WITH dim AS (SELECT 'customer' AS type, c_custkey AS id, c_name AS label FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part),
m AS (SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'supplier' ELSE 'part' END AS type, user_id AS id FROM events)
SELECT event_id, m.type, label FROM m LEFT JOIN dim ON m.type = dim.type AND m.id = dim.id""")
def c17_polymorphic_lookup(spark, d):
    pick = lambda t, i, n: table(spark, d, t).select(F.lit(t).alias("type"), F.col(i).alias("id"), F.col(n).alias("label"))
    dim = pick("customer", "c_custkey", "c_name").unionByName(pick("supplier", "s_suppkey", "s_name")).unionByName(pick("part", "p_partkey", "p_name"))
    kind = F.when(F.col("user_id") % 3 == 0, "customer").when(F.col("user_id") % 3 == 1, "supplier").otherwise("part")
    m = table(spark, d, "events").select("event_id", kind.alias("type"), F.col("user_id").alias("id"))
    return m.join(dim, ["type", "id"], "left").select("event_id", "type", "label")


@query("""WITH o AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags, list_sort(list(DISTINCT l_linestatus)) AS st FROM lineitem GROUP BY l_orderkey),
p AS (SELECT l_orderkey, unnest(list_filter(flags, lambda x: x <> 'N')) AS party, CASE WHEN len(st) > 1 THEN st ELSE [NULL] END AS contacts FROM o) SELECT l_orderkey, party, unnest(contacts) AS contact FROM p""")
def c18_cross_within_record(spark, d):
    from landgraph.operators.resolution import parties_by_contacts

    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"), F.array_sort(F.collect_set("l_linestatus")).alias("st"))
    o = o.withColumn("st", F.when(F.size("st") > 1, F.col("st")).otherwise(F.array().cast("array<string>")))
    return parties_by_contacts(o, "flags", "st", unnamed="N").select("l_orderkey", "party", "contact")


@query("""WITH st AS (SELECT 'order' AS stage, o_orderkey AS id, o_orderstatus AS v FROM orders UNION ALL SELECT 'line', l_orderkey, l_returnflag FROM lineitem)
SELECT stage, count(*) AS n, string_agg(v, '' ORDER BY v) AS vs, id FROM st WHERE CAST(id AS VARCHAR) LIKE '12%' GROUP BY stage, id""")
def c26_stage_trace(spark, d):
    st = R.dated(("order", table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"))), ("line", table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("v"))))
    st = st.filter(F.col("id").cast("string").startswith("12"))
    return st.groupBy(F.col("source").alias("stage"), "id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("v")), "").alias("vs"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(DISTINCT o_custkey) AS customers, CAST(strftime(max(o_orderdate), '%Y-%m-%d') AS VARCHAR) AS last_day FROM orders")
def d1_d4_dashboard(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_distinct("o_custkey").alias("customers"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL AND c_mktsegment <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def d2_f2_top_counts(spark, d):
    return R.top_counts(table(spark, d, "customer"), "c_mktsegment", 3)


@query("""SELECT 'o_orderstatus' AS dimension, coalesce(o_orderstatus, 'unknown') AS value, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', coalesce(o_orderpriority, 'unknown'), count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'year', strftime(o_orderdate, '%Y'), count(*) FROM orders GROUP BY 2""")
def d3_tallies(spark, d):
    return R.tallies(table(spark, d, "orders").withColumn("year", F.date_format("o_orderdate", "yyyy")), "o_orderstatus", "o_orderpriority", "year")


@query("SELECT c_mktsegment, CAST(trunc(coalesce(avg(c_acctbal) FILTER (WHERE c_acctbal > 0), 0)) AS BIGINT) AS mean FROM customer GROUP BY 1")
def d5_average_as_int(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.coalesce(F.avg(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).cast("bigint"), F.lit(0)).alias("mean"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL")
def d6_d7_composite_counts(spark, d):
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_totalprice > 250000) AS linked, count(*) - count(*) FILTER (WHERE o_totalprice > 250000) AS unlinked FROM orders GROUP BY 1")
def d8_conditional_counts(spark, d):
    big = F.count_if(F.col("o_totalprice") > 250000)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("total"), big.alias("linked"), (F.count(F.lit(1)) - big).alias("unlinked"))


@query("""WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, string_agg(o_orderstatus || '=' || n, ',' ORDER BY o_orderstatus) AS counts, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1""")
def d9_counts_map(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("o_custkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n")))).alias("m"), F.sum("n").alias("total"))
    text = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return m.select("o_custkey", text.alias("counts"), "total")


@query("""WITH dim AS (SELECT * FROM (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, '4-NOT SPECIFIED'), (4, '5-LOW'), (5, '6-NONE')) v(place, stage)),
s AS (SELECT o_orderpriority AS stage, count(*) AS n, sum(CAST(floor(o_totalprice) AS BIGINT)) AS amount FROM orders GROUP BY 1)
SELECT place, dim.stage, dim.stage NOT IN ('5-LOW') AS active, coalesce(n, 0) AS n, CAST(coalesce(amount, 0) AS BIGINT) AS amount FROM dim LEFT JOIN s ON dim.stage = s.stage""")
def d10_pipeline_stages(spark, d):
    rows = table(spark, d, "orders").withColumn("amount", F.floor("o_totalprice").cast("bigint"))
    return R.pipeline_stages(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"], rows, "o_orderpriority", "amount", ["5-LOW"])


@query("SELECT l_orderkey, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def d17_d18_sorted_sets(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("brands"))


@query("SELECT n_lines, count(*) AS n_orders FROM (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) GROUP BY 1")
def d21_histogram(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines")).groupBy("n_lines").agg(F.count(F.lit(1)).alias("n_orders"))


@query("SELECT count(*) AS n, round(avg(CAST(l_returnflag = 'R' AS INT)), 3) AS returned_rate, count(*) FILTER (WHERE l_discount = 0) AS plain, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def d22_d25_stage_health(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("l_returnflag") == "R").cast("int")), 3).alias("returned_rate"), F.count_if(F.col("l_discount") == 0).alias("plain"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT event_type, n, round(n / max(n) OVER (), 6) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def d27_share_of_largest(spark, d):
    rows = R.share_of_largest(table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
    return rows.withColumn("share", F.round("share", 6))


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM orders WHERE o_orderstatus = 'P'")
def f1_page_count(spark, d):
    return R.page_count(table(spark, d, "orders").filter("o_orderstatus = 'P'"), 20)


@query("SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50")
def f3_composite_sort(spark, d):
    return table(spark, d, "orders").orderBy(F.asc("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderpriority", "o_orderkey")


@query("""SELECT * FROM (SELECT 'orders' AS source, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day FROM orders UNION ALL SELECT 'events', event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events) ORDER BY day DESC, source, id LIMIT 10""")
def f4_merged_top(spark, d):
    fmt = "yyyy-MM-dd HH:mm:ss"
    o = table(spark, d, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", fmt).alias("day"))
    e = table(spark, d, "events").select(F.lit("events").alias("source"), F.col("event_id").alias("id"), F.date_format("ts", fmt).alias("day"))
    return R.merge_top(10, o, e, order=[F.desc("day"), F.asc("source"), F.asc("id")])


@query("SELECT p_partkey, CAST(p_brand IN ('Brand#1', 'Brand#2') AS INT) AS matched FROM part ORDER BY 2 DESC, p_retailprice DESC, p_partkey LIMIT 200")
def f5_priority_sort(spark, d):
    rows = table(spark, d, "part").withColumn("matched", F.col("p_brand").isin("Brand#1", "Brand#2").cast("int"))
    return rows.orderBy(F.desc("matched"), F.desc("p_retailprice"), "p_partkey").limit(200).select("p_partkey", "matched")


@query("""SELECT * FROM (SELECT 'part' AS type, p_partkey AS id, p_name AS label FROM part WHERE p_name ILIKE '%red%' ORDER BY label, id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'customer', c_custkey, c_name FROM customer WHERE c_name LIKE '%77%' ORDER BY c_name, c_custkey LIMIT 5)""")
def f6_l4_omnisearch(spark, d):
    from landgraph.operators.search import per_type

    p = table(spark, d, "part").filter(F.col("p_name").ilike("%red%")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    c = table(spark, d, "customer").filter(F.col("c_name").contains("77")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    return per_type(5, part=p, customer=c)


@query("SELECT 'order' AS source, o_orderkey AS id, o_custkey AS who FROM orders UNION ALL SELECT 'event', event_id, user_id FROM events")
def g1_union_tagged(spark, d):
    return R.dated(("order", table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("who"))), ("event", table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("who"))))


@query("SELECT DISTINCT p_brand, c_mktsegment FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def g2_g3_distinct_over_join(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("p_brand", "c_mktsegment").distinct()


@query("(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 450000")
def g4_c28_set_operations(spark, d):
    o = table(spark, d, "orders")
    keys = lambda c: o.filter(c).select(F.col("o_custkey").alias("k"))
    return keys("o_orderstatus = 'F'").intersect(keys("o_orderstatus = 'P'")).subtract(keys("o_totalprice > 450000"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def g6_insert_or_ignore(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def f_top_k_per_key(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("o_custkey", "o_orderkey")
