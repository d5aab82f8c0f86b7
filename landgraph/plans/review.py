"""Quality rules over nested records, deep differences, and where wrong values came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgraph.operators import lineage, quality, validation
from landgraph.plans.naming import book
from landgraph.session import table

QUERIES, SQL, query = book()


def _names(*values):
    return F.array(*(F.struct(v.alias("name")) for v in values))


def _records(spark, d):
    """A record a customer: names, lines and dates that break a rule, and some that nearly do."""
    c = table(spark, d, "customer")
    key, nation, name = F.col("c_custkey").cast("string"), F.col("c_nationkey"), F.col("c_name")
    phone = F.concat(F.lit("416-555-01"), F.lpad(nation.cast("string"), 2, "0"))
    low, seg = F.col("c_acctbal") < 0, F.col("c_mktsegment")
    lines = F.array(F.lit("Acme Holdings"), F.lit("12 Capital Dr"), F.lit("Holdings Street"), F.lit("5 Acme Inc"), F.lit("LP"), F.concat(name, F.lit(" ltd")))
    address = F.struct(F.when(seg == "MACHINERY", F.array().cast("array<string>")).otherwise(lines).alias("lines"), F.array(F.lit("Main St"), F.concat(key, F.lit("a Corp"))).alias("original_lines"))
    parties = _names(name, F.when(low, F.concat(name, F.lit(" "), phone)).otherwise("1234567 Ontario Inc 416-555-0100"), F.concat(key, F.lit(" Main Street"), F.when(seg == "BUILDING", " Inc").otherwise("")))
    contacts = _names(F.lit("Mary Smith"), F.concat(phone, F.lit(" x")), F.concat(nation.cast("string"), F.lit(" King Road")), F.concat(nation.cast("string"), F.lit("th King Road")), F.concat(F.lit("Call "), F.regexp_replace(phone, "^416-", "(416) ")))
    seller = F.struct(address.alias("address"), parties.alias("parties"), contacts.alias("contacts"))
    buyer = F.when(nation < 20, F.struct(F.struct(F.lit(None).cast("array<string>").alias("lines"), F.lit(None).cast("array<string>").alias("original_lines")).alias("address"), _names(F.concat(F.lit("Buyer "), phone)).alias("parties"), F.lit(None).cast("array<struct<name:string>>").alias("contacts")))
    day = F.when(nation < 5, "").when(nation < 10, "2020/01/02").otherwise("2020-01-02")
    sale = F.struct(F.when(~low, F.floor("c_acctbal")).alias("sale_price"), day.alias("sale_date"))
    return c.select("c_custkey", seller.alias("seller"), buyer.alias("buyer"), sale.alias("transaction"))


@query("""WITH c AS (SELECT *, '416-555-01' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS phone, c_mktsegment = 'MACHINERY' AS bare FROM customer)
SELECT c_custkey, 'company_in_address' AS rule, 'error' AS severity, 'seller.address.lines[0]' AS field_path, 'Acme Holdings' AS value FROM c WHERE NOT bare
UNION ALL SELECT c_custkey, 'company_in_address', 'error', 'seller.address.lines[5]', c_name || ' ltd' FROM c WHERE NOT bare
UNION ALL SELECT c_custkey, 'company_in_address', 'error', 'seller.address.lines[1]', c_custkey || 'a Corp' FROM c WHERE bare
UNION ALL SELECT c_custkey, 'phone_in_name', 'error', 'seller.parties[1].name', c_name || ' ' || phone FROM c WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'phone_in_name', 'error', 'seller.contacts[4].name', 'Call (416) ' || phone[5:] FROM c
UNION ALL SELECT c_custkey, 'phone_in_name', 'error', 'buyer.parties[0].name', 'Buyer ' || phone FROM c WHERE c_nationkey < 20
UNION ALL SELECT c_custkey, 'street_as_contact', 'error', 'seller.contacts[2].name', c_nationkey || ' King Road' FROM c
UNION ALL SELECT c_custkey, 'address_in_party', 'warning', 'seller.parties[2].name', c_custkey || ' Main Street' FROM c WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT c_custkey, 'null_required', 'error', 'transaction', 'no price or date' FROM c WHERE (c_acctbal < 0 OR floor(c_acctbal) = 0) AND c_nationkey < 5
UNION ALL SELECT c_custkey, 'format_mismatch', 'warning', 'transaction.sale_date', '2020/01/02' FROM c WHERE c_nationkey BETWEEN 5 AND 9""")
def j1_record_rules(spark, d):
    return quality.record_issues(_records(spark, d), "c_custkey")


@query("""WITH s AS (SELECT *, s_nationkey % 3 AS a FROM supplier)
SELECT s_suppkey, rule, severity FROM (SELECT s_suppkey, unnest([
  CASE WHEN s_acctbal < 0 THEN ['gw_no_pin', 'error'] END, CASE WHEN a = 0 THEN ['gw_no_arn', 'warning'] END, CASE WHEN s_nationkey < 4 THEN ['gw_no_address', 'error'] END,
  CASE WHEN s_acctbal > 9000 THEN ['gw_inactive_registry', 'info'] END, CASE WHEN a = 2 THEN ['gw_multiple_arns', 'info'] END, CASE WHEN s_nationkey = 7 THEN ['gw_address_parse_failed', 'warning'] END,
  CASE WHEN s_nationkey BETWEEN 2 AND 8 THEN ['gw_no_postal', 'warning'] END, CASE WHEN s_acctbal < 1000 OR s_nationkey < 12 THEN ['gw_parcel_unresolved', 'error'] END]) AS r FROM s),
LATERAL (SELECT r[1] AS rule, r[2] AS severity) WHERE r IS NOT NULL""")
def j3_parcel_rules(spark, d):
    s, nation = table(spark, d, "supplier"), F.col("s_nationkey")
    assessments = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), nation % 3)
    address = F.when(nation >= 2, F.struct(F.when(nation >= 4, "Main").otherwise(" ").alias("street"), F.when(nation > 8, "K1A 0B1").otherwise("").alias("postal_code")))
    found = F.when(nation == 7, F.array(F.lit("other"), F.lit("address_parse_failed"))).when(nation == 8, F.array(F.lit("address_parse")))
    rows = s.select("s_suppkey", F.when(F.col("s_acctbal") < 0, "  ").otherwise("1").alias("pin"), F.when(nation % 3 == 0, F.lit(None)).otherwise(assessments).alias("assessments"), address.alias("address"), F.when(F.col("s_acctbal") > 9000, False).when(nation > 3, True).alias("is_active"), found.alias("issues"))
    missed, none = F.struct(F.lit("arn_api_miss").alias("method")), F.struct(F.lit("").alias("method"))
    hit = F.struct(F.when(nation < 20, "arn_verified").alias("method"))
    links = s.filter("s_acctbal >= 1000").select("s_suppkey", F.when(nation < 6, F.array(missed, none)).when(nation < 12, F.array().cast("array<struct<method:string>>")).otherwise(F.array(missed, hit)).alias("resolutions"))
    return quality.parcel_issues(rows, links, "s_suppkey").select("s_suppkey", "rule", "severity")


def _stage(*fields):
    return F.to_json(F.struct(*fields))


@query("""WITH o AS (SELECT *, o_orderstatus = 'P' AS p, o_orderstatus = 'F' AS f, CAST(o_custkey AS VARCHAR) AS c FROM orders)
SELECT o_orderkey, 'party.names[1]' AS path, 'changed' AS change, '"B"' AS old, '"' || o_orderpriority || '"' AS new FROM o
UNION ALL SELECT o_orderkey, 'party.names[2]', 'added', NULL, '{"first":"C","last":[' || c || ',[]]}' FROM o WHERE p
UNION ALL SELECT o_orderkey, 'party.address', 'removed', '{"lines":["x",{"no":' || c || '}],"city":"Y"}' FROM o WHERE false
UNION ALL SELECT o_orderkey, 'party.address', 'removed', '{"city":"Y","lines":["x",{"no":' || c || '}]}', NULL FROM o WHERE f
UNION ALL SELECT o_orderkey, 'party.address.lines[1].no', 'changed', c, CAST(o_custkey + 1 AS VARCHAR) FROM o WHERE NOT f AND NOT p
UNION ALL SELECT o_orderkey, 'kind', 'changed', '{"a":1}', '[1]' FROM o WHERE p""".replace("UNION ALL SELECT o_orderkey, 'party.address', 'removed', '{\"lines\":[\"x\",{\"no\":' || c || '}],\"city\":\"Y\"}' FROM o WHERE false\n", ""))
def m2_deep_diff(spark, d):
    """Two stages of a record as JSON: a subtree of one side is one row at its highest missing ancestor."""
    o, key, status = table(spark, d, "orders"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    lines = lambda no: F.concat(F.lit('{"lines":["x",{"no":'), no, F.lit('}],"city":"Y"}'))
    old = F.concat(F.lit('{"id":1,"kind":{"a":1},"party":{"names":["A","B"],"address":'), lines(key), F.lit("}}"))
    more = F.when(status == "P", F.concat(F.lit(',{"last":['), key, F.lit(',[]],"first":"C"}'))).otherwise("")
    kept = F.when(status == "F", "").otherwise(F.concat(F.lit(',"address":'), lines(F.when(status == "P", key).otherwise((F.col("o_custkey") + 1).cast("string")))))
    new = F.concat(F.lit('{"kind":'), F.when(status == "P", "[1]").otherwise('{"a":1}'), F.lit(',"id":1.0,"party":{"names":["A","'), F.col("o_orderpriority"), F.lit('"'), more, F.lit("]"), kept, F.lit("}}"))
    return lineage.deep_diff(o.select("o_orderkey", old.alias("r")), o.select("o_orderkey", new.alias("r")), "o_orderkey", "r")


LINEAGE = (
    ("seller.parties", 1, "classified", "seller.parties"), ("seller.parties", 2, "assembled", "detail.transferor.party_lines"),
    ("seller.address", 1, "addresses", "seller.address"), ("seller.address", 2, "classified", "seller.address"), ("seller.address", 3, "assembled", "detail.transferor.contact_lines"),
    ("seller.address.lines", 1, "addresses", "seller.address.original_lines"), ("seller.address.lines", 2, "classified", "seller.address.lines"), ("seller.address.lines", 3, "assembled", "detail.transferor.contact_lines"),
)


@query("""WITH c AS (SELECT *, c_name || ' Ltd' AS v FROM customer)
SELECT c_custkey, 'seller.address.lines[0]' AS field_path, v AS value,
  CASE WHEN c_acctbal < 0 THEN 'clean' WHEN c_mktsegment = 'BUILDING' THEN 'addresses' WHEN c_nationkey < 5 THEN 'classified' ELSE 'assembled' END AS introduced_at,
  CASE WHEN c_acctbal < 0 THEN 'seller.address.lines[0]' WHEN c_mktsegment = 'BUILDING' THEN 'seller.address.original_lines' WHEN c_nationkey < 5 THEN 'seller.address.lines' ELSE 'detail.transferor.contact_lines' END AS origin_field,
  CASE WHEN c_acctbal >= 0 AND c_mktsegment <> 'BUILDING' AND c_nationkey < 5 THEN 'detail.transferor.contact_lines' END AS source_field FROM c
UNION ALL SELECT c_custkey, 'seller.address.city', v, CASE WHEN c_acctbal < 0 THEN 'clean' WHEN c_mktsegment = 'BUILDING' THEN 'addresses' WHEN c_nationkey < 5 THEN 'classified' ELSE 'assembled' END,
  CASE WHEN c_acctbal < 0 THEN 'seller.address.city' WHEN c_mktsegment = 'BUILDING' THEN 'seller.address' WHEN c_nationkey < 5 THEN 'seller.address' ELSE 'detail.transferor.contact_lines' END,
  CASE WHEN c_acctbal >= 0 AND c_mktsegment <> 'BUILDING' AND c_nationkey < 5 THEN 'detail.transferor.contact_lines' END FROM c
UNION ALL SELECT c_custkey, 'buyer.parties[0].name', v, 'unknown', 'buyer.parties[0].name', NULL FROM c""")
def j5_traced_origin(spark, d):
    """A company's name in an address, walked back over the stages of its record."""
    c, value = table(spark, d, "customer"), F.concat("c_name", F.lit(" Ltd"))
    paths = F.array(*map(F.lit, ("seller.address.lines[0]", "seller.address.city", "buyer.parties[0].name")))
    issues = c.select(F.col("c_custkey").alias("id"), F.explode(paths).alias("field_path"), value.alias("value"))
    here = lambda there, key: F.array(F.when(there, value).otherwise("Main St")).alias(key)
    seller = lambda key, there: F.struct(F.struct(here(there, key)).alias("address")).alias("seller")
    late, mid = F.col("c_acctbal") < 0, F.col("c_mktsegment") == "BUILDING"
    addresses = c.select(F.col("c_custkey").alias("id"), F.lit("addresses").alias("stage"), _stage(seller("original_lines", ~late)).alias("record"))
    classified = c.select("c_custkey", F.lit("classified"), _stage(seller("lines", ~late & ~mid)))
    apart = F.col("c_nationkey") < 5
    detail = F.struct(F.struct(here(~apart, "contact_lines"), here(apart, "party_lines")).alias("transferor")).alias("detail")
    assembled = c.select("c_custkey", F.lit("assembled"), _stage(detail))
    steps = spark.createDataFrame(LINEAGE, "field string, step int, stage string, stage_field string")
    return lineage.trace_origin(issues, steps, addresses.union(classified).union(assembled)).withColumnRenamed("id", "c_custkey")


@query("""WITH r AS (SELECT CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN '' ELSE o_custkey || strftime(o_orderdate, ' %Y-%m') END AS source_id, CASE WHEN o_orderstatus = 'F' THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS resolved FROM orders),
t AS (SELECT (SELECT count(*) FROM r) AS n, (SELECT count(*) FROM r WHERE source_id = '') AS missing, (SELECT count(*) - count(DISTINCT source_id) FROM r WHERE source_id <> '') AS repeated, (SELECT count(*) FROM r WHERE resolved <> '') AS resolved,
  (SELECT count(*) FROM r WHERE resolved IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)) AS cached, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_quantity > 40) AS built, (SELECT count(*) FROM supplier) AS gw, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS parcels)
SELECT "check", level, n, "of", CASE WHEN "of" > 0 THEN n * CAST(100 AS DOUBLE) / "of" END AS percent, flagged FROM (
SELECT 'no_records' AS "check", 'issue' AS level, n, NULL AS "of", n = 0 AS flagged FROM t
UNION ALL SELECT 'missing_source_id', 'issue', missing, n, missing > 0 FROM t UNION ALL SELECT 'repeated_source_id', 'issue', repeated, n, repeated > 0 FROM t
UNION ALL SELECT 'resolved', 'info', resolved, n, false FROM t UNION ALL SELECT 'resolved_in_cache', 'info', cached, resolved, false FROM t UNION ALL SELECT 'resolved_not_in_cache', 'warning', resolved - cached, resolved, resolved > cached FROM t
UNION ALL SELECT 'drift', 'warning', abs(n - built), built, abs(n - built) * 100.0 / built > 10 FROM t
UNION ALL SELECT 'count_gw', 'warning', gw, NULL, gw = 0 FROM t UNION ALL SELECT 'count_osm', 'warning', (SELECT count(*) FROM part WHERE p_size > 1000), NULL, (SELECT count(*) FROM part WHERE p_size > 1000) = 0 FROM t
UNION ALL SELECT 'count_parcels', 'info', parcels, NULL, false FROM t
UNION ALL SELECT 'passed', 'issue', CAST(n = 0 AS BIGINT) + CAST(missing > 0 AS BIGINT) + CAST(repeated > 0 AS BIGINT), NULL, n = 0 OR missing > 0 OR repeated > 0 FROM t)""")
def d24_j7_validation_summary(spark, d):
    cached = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("number"))
    late = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    source = F.when(late, "").otherwise(F.concat(F.col("o_custkey").cast("string"), F.date_format("o_orderdate", " yyyy-MM")))
    resolved = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_custkey").cast("string"))
    records = table(spark, d, "orders").select(source.alias("source_id"), resolved.alias("resolved"))
    built = table(spark, d, "lineitem").filter("l_quantity > 40").select("l_orderkey").distinct()
    others = {"gw": table(spark, d, "supplier"), "osm": table(spark, d, "part").filter("p_size > 1000"), "parcels": cached}
    return validation.validation_summary(records, cached, built, others, needed=("gw", "osm"))
