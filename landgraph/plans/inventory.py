"""Sources, sinks and the smaller relational operators, each with its own rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from landgraph.functions import text as T
from landgraph.operators import folds, relational, resolution, search
from landgraph.plans.naming import book
from landgraph.session import table
from landgraph.sources import files

QUERIES, SQL, query = book()


def _folder(spark) -> str:
    return f"{files.shared_folder(spark)}/stage-{uuid.uuid4().hex[:12]}"


@query("SELECT 'region=' || n_regionkey AS region, 'kind=all' AS kind, 'page=p' || n_nationkey AS page, '<b>' || n_name || '</b>' AS value FROM nation")
def a1_raw_documents(spark, d):
    """Whole files in region, type and page folders."""
    root = _folder(spark)
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.lit("all").alias("kind"), F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("page"), F.concat(F.lit("<b>"), "n_name", F.lit("</b>")).alias("value"))
    rows.write.partitionBy("region", "kind", "page").text(root)
    found = files.raw_documents(spark, root, "*.txt")
    return found.select("region", "kind", "page", F.regexp_replace("value", r"\n$", "").alias("value"))


@query("""WITH r AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS position FROM nation)
SELECT n_regionkey AS region, position, n_name AS address, '' AS note, position = 1 AS second FROM r""")
def a2_a3_export_arrays(spark, d):
    """JSON arrays, one a file: elements by position, absent text empty."""
    root = _folder(spark)
    item = F.struct("n_nationkey", F.col("n_name").alias("address"))
    arrays = table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["address"].alias("address")))).alias("value"))
    arrays.write.partitionBy("n_regionkey").text(root)
    rows = files.export_records(spark, root, "address string, note string")
    whole = rows.groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "address"))), lambda x: x["address"]).alias("all"))
    rows = rows.join(whole, "folder")
    second = files.at_position(F.col("all"), F.lit(1)).eqNullSafe(F.col("address"))
    return rows.select(F.regexp_extract("folder", r"n_regionkey=(\d+)", 1).cast("int").alias("region"), F.col("position").cast("long").alias("position"), "address", "note", second.alias("second"))


@query("SELECT c_custkey, c_name, c_acctbal, (SELECT count(*) FROM customer) AS n FROM customer")
def a8_a9_a11_stage_records(spark, d):
    """JSON records of a stage, written whole or not at all, read with a schema, and counted; files named _* are no records."""
    root = _folder(spark)
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    rows.write.mode("overwrite").json(root)
    rows.limit(3).coalesce(1).write.mode("overwrite").json(f"{root}/_aside")
    back = files.stage_records(spark, root, "c_custkey long, c_name string, c_acctbal double")
    n = back.select("c_custkey").agg(F.count(F.lit(1)).alias("n"))
    return back.filter("_corrupt_record is null").select("c_custkey", "c_name", "c_acctbal").join(F.broadcast(n))


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_partkey IS NOT NULL AS cached FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size < 20")
def a10_parcel_cache(spark, d):
    parcels = table(spark, d, "part").filter("p_size < 20").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return files.cached_parcels(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parcels, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "p_name", "cached")


@query("""SELECT p_partkey, b.brand, b.category FROM part JOIN (VALUES ('ECONOMY', 'Eco-nomy', 'low'), ('SAVER', 'Eco-nomy', 'low'), ('PROMO', 'Promo', 'promo')) b(k, brand, category) ON upper(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) = b.k""")
def a17_i9_brand_aliases(spark, d):
    """A CSV of brands with aliases, keyed by normalised name."""
    root = _folder(spark)
    spark.createDataFrame([("Eco-nomy", "low", "Saver"), ("Promo", "promo", None)], "`Brand Name` string, Category string, Aliases string").coalesce(1).write.option("header", True).csv(root)
    dim = files.brand_table(spark, root)
    return table(spark, d, "part").withColumn("brand_key", T.brand_key(F.col("p_type"))).join(F.broadcast(dim), "brand_key").select("p_partkey", "brand", "category")


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS customers FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 UNION ALL SELECT 'P', count(*), CAST(sum(o_custkey + 1) AS BIGINT) FROM orders WHERE o_orderstatus = 'P'")
def a18_g7_bulk_load_and_scope(spark, d):
    """A table loaded at once; then one scope of it is deleted and inserted anew."""
    root, o = _folder(spark), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    files.write_stage(o, root, "o_orderstatus")
    fresh = o.filter("o_orderstatus = 'P'").withColumn("o_custkey", F.col("o_custkey") + 1)
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("o_orderstatus").parquet(root)
    return spark.read.parquet(root).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("customers"))


@query("SELECT n_regionkey AS region, 1 AS files, true AS has_size FROM nation GROUP BY 1")
def a19_stage_listing(spark, d):
    root = _folder(spark)
    table(spark, d, "nation").select("n_name", "n_regionkey").repartition(1, "n_regionkey").write.partitionBy("n_regionkey").text(root)
    rows = files.listing(spark, root, "*.txt").withColumn("region", F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int"))
    return rows.groupBy("region").agg(F.count(F.lit(1)).cast("int").alias("files"), F.min(F.col("length") > 0).alias("has_size"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 30")
def b5_sort_guard(spark, d):
    """An unknown sort column falls back to the default, an unknown order to descending."""
    c = table(spark, d, "customer")
    key = relational.sort_key({"balance": F.col("c_acctbal"), "name": F.col("c_name")}, "1; drop table", "sideways", "balance")
    return relational.page(c, key, F.asc("c_custkey"), size=30).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def b11_pending(spark, d):
    """Records without a result, and failed ones that are to be tried again."""
    status = F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("string")).when(F.col("o_orderstatus") == "P", "failed").otherwise("done")
    retry = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, d, "orders").filter(relational.pending(status, retry)).select("o_orderkey")


@query(r"""WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents)
SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM t WHERE term = 'the') AND lang = 'en'""")
def c12_search_semi_join(spark, d):
    docs = table(spark, d, "documents")
    hits = search.match_all(search.index(docs, "doc_id", F.col("text")), "doc_id", ["the"])
    return docs.filter("lang = 'en'").join(hits, "doc_id", "left_semi").select("doc_id", "n_chars")


@query("""WITH p AS (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem WHERE l_quantity > 48 GROUP BY 1), q AS (SELECT l_partkey, max(l_suppkey) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT p_partkey, coalesce(p.s, q.s) AS linked, CASE WHEN p.s IS NOT NULL THEN 'resolved' WHEN q.s IS NOT NULL THEN 'own' ELSE 'none' END AS how FROM part LEFT JOIN p ON p_partkey = p.l_partkey LEFT JOIN q ON p_partkey = q.l_partkey""")
def c22_i4_fallback_link(spark, d):
    """The resolved number, else the record's own."""
    li = table(spark, d, "lineitem")
    resolved = li.filter("l_quantity > 48").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("resolved"))
    own = li.filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_suppkey").alias("own"))
    rows = table(spark, d, "part").join(resolved, "p_partkey", "left").join(own, "p_partkey", "left")
    return rows.select("p_partkey", F.coalesce("resolved", "own").alias("linked"), F.when(F.col("resolved").isNotNull(), "resolved").when(F.col("own").isNotNull(), "own").otherwise("none").alias("how"))


@query("""WITH t AS (SELECT l_suppkey, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS tenants FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT s_suppkey, coalesce(tenants, '') AS tenants FROM supplier LEFT JOIN t ON s_suppkey = l_suppkey WHERE s_suppkey IN (1, 3, 5, 7, 11)""")
def c23_c24_tenants(spark, d):
    """Tenants as sorted arrays on the properties of a list of ids."""
    t = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sort_array(F.collect_set("p_brand")).alias("t"))
    rows = table(spark, d, "supplier").filter(F.col("s_suppkey").isin(1, 3, 5, 7, 11)).join(t, "s_suppkey", "left")
    return rows.select("s_suppkey", F.coalesce(F.array_join("t", ","), F.lit("")).alias("tenants"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN c_name END AS property, CASE WHEN o_orderstatus = 'F' THEN n_name END AS grp FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def c25_deal_links(spark, d):
    """A deal's property and group, each only where the deal names one; a deal that names none is in no join, where nulls meet in one task."""
    status, key = F.col("o_orderstatus"), F.col("o_custkey")
    o = table(spark, d, "orders").select("o_orderkey", F.when(status != "O", key).alias("c_custkey"), F.when(status == "F", key).alias("g"))
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    g = c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("g"), F.col("n_name").alias("grp"))
    linked = relational.left_join_named(relational.left_join_named(o, c, "c_custkey"), g, "g")
    return linked.select("o_orderkey", F.col("c_name").alias("property"), "grp")


@query("""SELECT o_custkey, count(*) AS transactions, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY 1""")
def d15_recount(spark, d):
    """Counts and latest sales of the properties that a change has touched."""
    touched = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").join(touched, "o_custkey", "left_semi")
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("transactions"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("SELECT o_orderpriority, 10 * count(*) AS estimate FROM orders WHERE o_orderkey % 10 = 0 GROUP BY 1")
def d23_systematic_sample(spark, d):
    """A histogram from every tenth record, scaled; sampling is what it does."""
    return folds.sampled_counts(table(spark, d, "orders"), F.col("o_orderkey"), "o_orderpriority", 10, "estimate")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1%' ORDER BY c_custkey LIMIT 25")
def f7_f8_limited_search(spark, d):
    """A limit with an order of its own, so that it names the same rows each time."""
    return table(spark, d, "customer").filter(F.col("c_name").contains("1")).orderBy("c_custkey").limit(25).select("c_custkey", "c_name")


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_brand <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def f9_top_brands(spark, d):
    return relational.top_counts(table(spark, d, "part"), "p_brand", 10)


@query("SELECT s_suppkey, s_nationkey IN (0, 1, 2, 3, 5, 8) AS listed FROM supplier")
def g5_dictionary_union(spark, d):
    words = F.array_union(F.array(*(F.lit(x) for x in (0, 1, 2, 3))), F.array(*(F.lit(x) for x in (2, 3, 5, 8))))
    return table(spark, d, "supplier").select("s_suppkey", F.array_contains(words, F.col("s_nationkey").cast("int")).alias("listed"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) LIKE '%7%' OR contains(event_type, 'ur') AS held FROM events""")
def h66_value_containment(spark, d):
    """Whether any value of a nested record contains a text."""
    record = F.concat(F.lit('{"a7": ['), F.col("props"), F.lit(', {"type": {"name": "'), F.col("event_type"), F.lit('"}}]}'))
    found = search.holds_value(record, F.lit("7")) | search.holds_value(record, F.lit("ur"))
    return table(spark, d, "events").select("event_id", found.alias("held"))


@query("""WITH e AS (SELECT user_id % 50 AS who, upper(trim(event_type)) AS contact_key, event_id, strftime(ts, '%Y-%m-%d') AS day FROM events)
SELECT contact_key, count(*) AS n, min(day) AS first_date, max(day) AS last_date FROM e GROUP BY 1""")
def i2_contacts_by_fingerprint(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("name"), "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id")
    return resolution.resolve_contacts(e, "name", ["event_id"], "day", ["user_id"]).select("contact_key", "n", "first_date", "last_date")


@query("""SELECT o_custkey, o_orderkey, 10 * CAST(o_orderstatus = 'F' AS INT) + 5 * CAST(o_totalprice > 200000 AS INT) + 3 * CAST(o_orderpriority = '1-URGENT' AS INT) AS score FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) = 1""")
def i1_deduplicated_records(spark, d):
    """Of records of one source id the best scored stays; ties go to the first file name."""
    flag = lambda c, n: F.when(c, n).otherwise(0)
    score = flag(F.col("o_orderstatus") == "F", 10) + flag(F.col("o_totalprice") > 200000, 5) + flag(F.col("o_orderpriority") == "1-URGENT", 3)
    return folds.best_per_key(table(spark, d, "orders").withColumn("score", score), ["o_custkey"], F.desc("score"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", "score")


@query("""WITH p AS (SELECT DISTINCT s_nationkey, substr(s_name, 1, 17) AS stem, s_suppkey FROM supplier)
SELECT a, b FROM (SELECT s_suppkey AS a, lead(s_suppkey) OVER (PARTITION BY stem, s_nationkey ORDER BY s_suppkey) AS b FROM p) WHERE b IS NOT NULL""")
def i10_related_groups(spark, d):
    """Candidates for a person to look at: groups that share a block key (here name stem and nation); nothing is merged."""
    p = table(spark, d, "supplier").select("s_suppkey", F.substring("s_name", 1, 17).alias("stem"), "s_nationkey")
    return resolution.related(p, ["stem", "s_nationkey"], "s_suppkey")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def l5_substring_search(spark, d):
    return table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("license"))).select("doc_id")


@query(r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ts FROM documents),
p AS (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS place FROM t), a AS (SELECT * FROM p WHERE term = 'the'), b AS (SELECT * FROM p WHERE term = 'of')
SELECT DISTINCT a.doc_id FROM a JOIN b ON a.doc_id = b.doc_id AND abs(a.place - b.place) BETWEEN 1 AND 4""")
def l3_near(spark, d):
    """NEAR: two words with at most three others between them."""
    return search.near_words(search.index(table(spark, d, "documents"), "doc_id", F.col("text")), "doc_id", "the", "of", 3)


@query(r"SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'cold') AND lower(p_type) = 'economy'")
def l3_column_filters(spark, d):
    return search.match_columns(table(spark, d, "part"), "p_partkey", {"p_name": ["cold"], "p_type": ["economy"]})


@query(r"""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents)
SELECT term, count(*) AS n FROM t WHERE term IN ('the', 'der', 'les') GROUP BY 1""")
def l2_rebuilt_index(spark, d):
    """The index as a stored table, by the term's hash: written anew as a whole, then read for a few terms."""
    root = _folder(spark)
    search.stored_index(table(spark, d, "documents"), "doc_id", F.col("text"), root)
    rows = search.read_index(spark, root, ["the", "der", "les"])
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '' WHEN o_orderkey % 2 = 0 THEN '$.status' ELSE '$.status,$.party.id' END AS paths FROM orders""")
def m4_fixture_comparison(spark, d):
    """Paths at which a record differs from its approved form; names with a leading _ do not count."""
    k, ok = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    record = lambda status, who, note: F.to_json(F.struct(status.alias("status"), F.struct(who.alias("id")).alias("party"), note.alias("_note")))
    ours = record(F.col("o_orderstatus"), F.col("o_custkey"), F.lit("a"))
    approved = record(F.when(ok, F.col("o_orderstatus")).otherwise("X"), F.when(ok | (k % 2 == 0), F.col("o_custkey")).otherwise(F.lit(-1)), F.lit("b"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(search.mismatches(ours, approved, ["$.status", "$.party.id", "$._note"]), ",").alias("paths"))


@query("""SELECT s_suppkey, 'source,order' AS stages FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey, 'source' FROM supplier WHERE s_acctbal <= 0""")
def m1_value_trace(spark, d):
    """The stages, from the first on, in which a record's value stands."""
    s = table(spark, d, "supplier")
    stages = relational.dated(("source", s.select("s_suppkey", "s_acctbal")), ("order", s.filter("s_acctbal > 0").select("s_suppkey", "s_acctbal")))
    rank = F.when(F.col("source") == "source", 0).otherwise(1)
    rows = stages.groupBy("s_suppkey").agg(F.array_sort(F.collect_list(F.struct(rank.alias("i"), "source"))).alias("x"))
    return rows.select("s_suppkey", F.array_join(F.transform("x", lambda r: r["source"]), ",").alias("stages"))


@query("""WITH a AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type <> 'error' GROUP BY 1), b AS (SELECT user_id, min(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT a.user_id, a.event_id, b.user_id IS NULL AS orphan FROM a LEFT JOIN b ON a.user_id = b.user_id""")
def k2_k4_incremental_upsert(spark, d):
    """Files as they land, each once, upserted in micro-batches; then rows without a partner are marked as orphans."""
    from landgraph.streaming import feeds

    rows = table(spark, d, "events").filter("event_type <> 'error'").select("event_id", "ts", "user_id")
    root = _folder(spark)
    rows.repartitionByRange(4, "event_id").write.parquet(f"{root}/in")
    each = feeds.upsert_latest(f"{root}/out", "user_id", F.desc("ts"), F.desc("event_id"))
    for _ in range(2):  # the second run finds nothing new: the checkpoint knows the names
        feeds.run_once(feeds.file_stream(spark, f"{root}/in", rows.schema, per_trigger=1), f"{root}/checkpoint", each)
    known = table(spark, d, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.min("value").alias("v"))
    return feeds.read_latest(spark, f"{root}/out", rows.schema, "user_id", F.desc("ts"), F.desc("event_id")).join(known, "user_id", "left").select("user_id", "event_id", F.col("v").isNull().alias("orphan"))
