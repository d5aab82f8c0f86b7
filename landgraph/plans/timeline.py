"""Diff, lineage, incremental and event-time queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from landgraph.operators import search as S
from landgraph.plans.naming import book
from landgraph.session import table
from landgraph.sources.files import new_files
from landgraph.streaming import feeds

QUERIES, SQL, query = book()


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS prio FROM orders WHERE o_orderkey % 7 > 0),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_orderpriority AS prio FROM orders WHERE o_orderkey % 11 > 0),
fa AS (SELECT k, 'status' AS path, status AS v FROM a UNION ALL SELECT k, 'prio', prio FROM a), fb AS (SELECT k, 'status' AS path, status AS v FROM b UNION ALL SELECT k, 'prio', prio FROM b)
SELECT coalesce(fa.k, fb.k) AS k, coalesce(fa.path, fb.path) AS path, CASE WHEN fa.v IS NULL THEN 'added' WHEN fb.v IS NULL THEN 'removed' ELSE 'changed' END AS change, fa.v AS old, fb.v AS new
FROM fa FULL JOIN fb ON fa.k = fb.k AND fa.path = fb.path WHERE fa.v IS DISTINCT FROM fb.v""")
def m2_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio"))
    new = o.filter("k % 11 > 0").withColumn("status", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("status")))
    return S.diff(S.flat(o.filter("k % 7 > 0"), "k", ["status", "prio"]), S.flat(new, "k", ["status", "prio"]), "k").select("k", "path", "change", "old", "new")


_EDGES = """e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


@query(f"""WITH RECURSIVE {_EDGES}, g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT 'r0' AS start, 'r0' AS node UNION SELECT r.start, g.b FROM r JOIN g ON r.node = g.a) SELECT start, node FROM r""")
def m3_reachability(spark, d):
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, d, "nation").select(text("n", "n_nationkey").alias("a"), text("r", "n_regionkey").alias("b")).union(table(spark, d, "supplier").select(text("s", "s_suppkey"), text("n", "s_nationkey")))
    return S.reachable(edges, spark.createDataFrame([("r0",)], "start string"))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderkey AS VARCHAR) LIKE '1%' AND CAST(o_orderkey AS VARCHAR) LIKE '%5' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def a15_b16_k5_pending(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey"), "o_orderkey", F.col("o_orderkey").cast("string").alias("name"))
    wanted = o.filter(F.col("name").startswith("1") & F.col("name").endswith("5"))
    done = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return new_files(wanted, wanted.join(done, "o_custkey", "left_semi"), "name", "1", "5").select("o_custkey", "o_orderkey")


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def k1_k3_stream_upsert(spark, d):
    """A file stream, run to its end, into a table of each user's latest event."""
    from landgraph.sources.files import shared_folder

    rows = table(spark, d, "events")
    root = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex[:12]}"
    rows.select("event_id", "ts", "user_id").repartitionByRange(3, "event_id").write.parquet(f"{root}/in")
    stream = feeds.file_stream(spark, f"{root}/in", rows.select("event_id", "ts", "user_id").schema, per_trigger=1)
    feeds.run_once(stream, f"{root}/checkpoint", feeds.upsert_latest(f"{root}/out", "user_id", F.desc("ts"), F.desc("event_id")))
    return feeds.read_latest(spark, f"{root}/out", rows.select("event_id", "ts", "user_id").schema, "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def m11_hourly_windows(spark, d):
    """Extension: tumbling event-time windows."""
    rows = feeds.hourly(table(spark, d, "events"), "ts")
    return rows.select(F.date_format("starts", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM s) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS starts, count(*) AS n FROM g GROUP BY user_id, i""")
def m11_sessions(spark, d):
    """Extension: session windows."""
    return feeds.sessions(table(spark, d, "events"), "ts", "user_id").select("user_id", F.date_format("starts", "yyyy-MM-dd HH:mm:ss").alias("starts"), "n")
