"""The parsers' single steps, each with rows of its own, and records traced over their stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgraph.functions import address as A
from landgraph.functions import record as R
from landgraph.functions import sections as S
from landgraph.functions import values as V
from landgraph.operators import lineage
from landgraph.plans.naming import book
from landgraph.plans.records import _pages
from landgraph.session import spread, table

QUERIES, SQL, query = book()


def _dealt(key, *lines):
    """One of several lines for each row, by its key; a line is a text with {k} for the key and {s} for a second column."""
    out = F.lit(None).cast("string")
    for i, line in enumerate(lines):
        out = F.when(key % len(lines) == i, F.replace(F.replace(F.lit(line), F.lit("{k}"), key.cast("string")), F.lit("{s}"), F.col("p_size").cast("string"))).otherwise(out)
    return out


def _answers(key: str, *rows: tuple) -> str:
    """The same in SQL: a VALUES list of what each line becomes, its row chosen by the key."""
    text = lambda v: "NULL" if v is None else "replace(replace('" + v.replace("'", "''") + f"', '{{k}}', CAST({key} AS VARCHAR)), '{{s}}', CAST(p_size AS VARCHAR))"
    columns = range(len(rows[0]))
    return ", ".join(f"CASE {key} % {len(rows)} " + " ".join(f"WHEN {i} THEN {text(r[c])}" for i, r in enumerate(rows)) + f" END AS c{c}" for c in columns)


NUMBERS = (
    ("{s} Main St", "{s}", "Main St"),
    ("{s} - {k} King St", "{s}-{k}", "King St"),
    ("{s}-45th Ave", "{s}", "45th Ave"),
    ("{s} 1/2 King St", "{s} 1/2", "King St"),
    ("{s} ½ Elm St", "{s} 1/2", "Elm St"),
    ("{s}A+B Bay St", "{s}A+B", "Bay St"),
    ("{s}A Main St", "{s}A", "Main St"),
    ("{s}, {k} & 9 Main St", "{s},{k},9", "Main St"),
    ("{s}/{k} Main St", "{s}/{k}", "Main St"),
    ("Three Main St", "3", "Main St"),
    ("Main St", "", "Main St"),
)


@query(f"SELECT p_partkey, c0 AS number, c1 AS rest FROM (SELECT p_partkey, {_answers('p_partkey', *(r[1:] for r in NUMBERS))} FROM part)")
def h37_street_numbers(spark, d):
    rows = spread(spark, d, "part").select("p_partkey", A.street_number(_dealt(F.col("p_partkey"), *(r[0] for r in NUMBERS))).alias("n"))
    return rows.select("p_partkey", "n.number", "n.rest")


UNITS = (
    ("#{s} - {k} Main St", "{k} Main St", "#", "{s}"),
    ("suite {s} {k} King St", "{k} King St", "Suite", "{s}"),
    ("{k} King St, ste {s}B", "{k} King St", "Suite", "{s}B"),
    ("{k} King Drive unit {s}", "{k} King Drive", "Unit", "{s}"),
    ("B{s}-{k} Bay St", "{k} Bay St", "Unit", "B{s}"),
    ("{k} King St, 3rd Floor", "{k} King St", "Floor", "3rd Floor"),
    ("{k} King St, second floor", "{k} King St", "Floor", "Second Floor"),
    ("{k} King St, #{s}", "{k} King St", "#", "{s}"),
    ("{k} King St, R.R. #{s}", "{k} King St", "RR", "{s}"),
    ("{k} King St", "{k} King St", "", ""),
)


@query(f"SELECT p_partkey, c0 AS rest, c1 AS kind, c2 AS number FROM (SELECT p_partkey, {_answers('p_partkey', *(r[1:] for r in UNITS))} FROM part)")
def h36_units(spark, d):
    rows = spread(spark, d, "part").select("p_partkey", A.unit(_dealt(F.col("p_partkey"), *(r[0] for r in UNITS))).alias("u"))
    return rows.select("p_partkey", "u.rest", "u.kind", "u.number")


SPECIAL = (
    ("P.O. Box {k}", "po_box", "PO Box", "{k}"),
    ("r r #{s}", "rural_route", "RR", "{s}"),
    ("General  Delivery stn {k}", "general_delivery", "General Delivery", ""),
    ("Pt Lot {k}", "legal_description", "", ""),
    ("{s}, {k} & 44", "lot_continuation", "", ""),
    ("{k} Main St", None, None, None),
    ("Planet {k}", None, None, None),
)


@query(f"SELECT p_partkey, c0 AS kind, c1 AS word, c2 AS number FROM (SELECT p_partkey, {_answers('p_partkey', *(r[1:] for r in SPECIAL))} FROM part)")
def h35_special_lines(spark, d):
    rows = spread(spark, d, "part").select("p_partkey", A.special(_dealt(F.col("p_partkey"), *(r[0] for r in SPECIAL))).alias("x"))
    return rows.select("p_partkey", F.col("x.type").alias("kind"), F.col("x.kind").alias("word"), "x.number")


FORMS = (
    ("Bldg located at {k} King St", "{k} King St"),
    ("{k} Hwy. #{s}", "{k} Hwy. {s}"),
    ("{k} St. George St", "{k} __SAINT__ George St"),
    ("{k} Queen's Quay", "{k} Queens Quay"),
    ("{k} Main St", "{k} Main St"),
)


@query(f"SELECT p_partkey, c0 AS line FROM (SELECT p_partkey, {_answers('p_partkey', *(r[1:] for r in FORMS))} FROM part)")
def h41_normal_lines(spark, d):
    """Preambles and highway hashes go, saints are kept from being suffixes, possessives are closed up."""
    line = _dealt(F.col("p_partkey"), *(r[0] for r in FORMS))
    return table(spark, d, "part").select("p_partkey", A.without_possessives(A.with_saints_kept(A.without_highway_hash(A.without_preamble(line)))).alias("line"))


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 AS same FROM orders""")
def h53_same_dates(spark, d):
    """A sale's day written in two ways; a text that is no date contradicts nothing."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    other = F.when(k % 7 == 0, "sometime").otherwise(F.date_format(F.date_add(day, (k % 3).cast("int")), "d MMM yyyy"))
    return table(spark, d, "orders").select("o_orderkey", V.same_date(F.date_format(day, "MM/dd/yyyy"), "MM/dd/yyyy", other, "d MMM yyyy").alias("same"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS pin, o_orderstatus = 'P' AS several, CAST(o_custkey + 0.5 AS DOUBLE) AS acres,
 'Plan ' || o_orderkey || '|Lot 3 of Plan' AS legal, 'North side of King' AS location, o_orderstatus = 'F' AS surface FROM orders""")
def h29_site_lines(spark, d):
    k, c, status = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    pin = F.when(status == "P", F.concat(F.lit("PIN: "), c, F.lit("+"))).when(status == "F", F.concat(F.lit("PIN: "), c))
    surface = F.when(status == "F", "Surface rights only")
    lines = F.array(pin, F.concat(c, F.lit(".5 acres")), F.lit("  "), F.concat(F.lit("Plan "), k), surface, F.lit("North side of King"), F.lit("Lot 3 of Plan"))
    rows = spread(spark, d, "orders").select("o_orderkey", R.site(lines).alias("s"))
    return rows.select(
        "o_orderkey", "s.pin", F.col("s.pin_multiple").alias("several"), F.col("s.acreage").alias("acres"),
        F.replace("s.legal_description", F.lit("\n"), F.lit("|")).alias("legal"), "s.location", F.col("s.surface_rights_only").alias("surface"),
    )


@query("""SELECT c_custkey, 0 AS place, 'Firm ' || c_custkey AS brokerage, 'Ann One|Bob Two|Cy Three' AS agents, '416-555-' || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS phone FROM customer
UNION ALL SELECT c_custkey, 1, '', 'Solo Agent ' || c_custkey, '' FROM customer WHERE c_acctbal > 0""")
def h31_brokers(spark, d):
    """A firm and its agents in one line, or an agent without a firm; blank lines are none."""
    k = F.col("c_custkey").cast("string")
    firm = F.concat(F.lit("Firm "), k, F.lit(": Ann One & Bob Two, Cy Three 416-555-"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0"))
    solo = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("Solo Agent "), k)).otherwise(" ")
    rows = spread(spark, d, "customer").select("c_custkey", F.posexplode(R.brokers(F.array(firm, F.lit(""), solo))).alias("place", "b"))
    return rows.select("c_custkey", "place", "b.brokerage", F.array_join("b.agents", "|").alias("agents"), "b.phone")


@query("""SELECT s_suppkey, unnest(generate_series(CAST(floor((s_nationkey + 0.25) * 2) AS BIGINT), CAST(floor((s_nationkey + 0.25 + s_suppkey % 3 * 0.5) * 2) AS BIGINT))) AS cell FROM supplier""")
def h62_cells(spark, d):
    """The grid cells of half a unit that an interval touches."""
    low = F.col("s_nationkey") + F.lit(0.25)
    return table(spark, d, "supplier").select("s_suppkey", F.explode(V.cells(low, low + F.col("s_suppkey") % 3 * 0.5, 0.5)).alias("cell"))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus = 'F' AS f, o_orderstatus = 'P' AS p, CAST(o_custkey AS VARCHAR) AS c, o_orderpriority AS pr FROM orders)
SELECT o_orderkey, 'party.names[1]' AS path, 'changed' AS change, '"B"' AS old, '"' || pr || '"' AS new FROM o
UNION ALL SELECT o_orderkey, 'party.lots[1]', 'removed', '{"no":' || c || '}', NULL FROM o WHERE f
UNION ALL SELECT o_orderkey, 'party.lots[2]', 'added', NULL, '[1,[2]]' FROM o WHERE p""")
def m4_approved_records(spark, d):
    """Each record against its approved form, by the deep walker; names with a leading _ do not count at any depth."""
    o, c, status = table(spark, d, "orders"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    record = lambda who, lots, note: F.concat(F.lit('{"_built":"'), note, F.lit('","party":{"names":["A","'), who, F.lit('"],"_by":"'), note, F.lit('","lots":['), lots, F.lit("]}}"))
    lot = F.concat(F.lit('{"no":'), c, F.lit("}"))
    ours = F.when(status == "F", "0").when(status == "P", F.concat(F.lit("0,"), lot, F.lit(",[1,[2]]"))).otherwise(F.concat(F.lit("0,"), lot))
    approved = o.select("o_orderkey", record(F.lit("B"), F.concat(F.lit("0,"), lot), F.lit("then")).alias("r"))
    return lineage.deep_diff(approved, o.select("o_orderkey", record(F.col("o_orderpriority"), ours, F.lit("now")).alias("r")), "o_orderkey", "r", skip="_")


#: field, stage, path
TRACED = (
    ("rt_id", "structural", "$.footer.rt_id"), ("rt_id", "classified", "$.rt_id"), ("rt_id", "clean", "$.id"),
    ("price", "structural", "$.header.price_text"), ("price", "classified", "$.header.sale_price"), ("price", "clean", "$.price"),
    ("street", "structural", "$.transferor.contact_lines[1]"), ("street", "classified", "$.seller.address.lines[0]"), ("street", "clean", "$.seller.display"),
    ("care_of", "structural", "$.transferee.contact_lines[0]"), ("care_of", "classified", "$.buyer.care_of.text"), ("care_of", "clean", "$.care_of"),
)


@query("""WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n, o_orderstatus = 'F' AS f FROM orders)
SELECT o_orderkey, 'rt_id' AS field, 'RT' || o_orderkey AS first_value, 'RT' || o_orderkey AS last_value, NULL AS changed_at, NULL AS lost_at, 3 AS held FROM o
UNION ALL SELECT o_orderkey, 'price', '$' || format('{:,}', n), CAST(n AS VARCHAR), 'classified', NULL, 3 FROM o
UNION ALL SELECT o_orderkey, 'street', o_orderkey || ' Main St', o_orderkey || ' Main Street', 'clean', NULL, 3 FROM o
UNION ALL SELECT o_orderkey, 'care_of', 'c/o Smith & Jones', 'Smith & Jones, Barristers', 'classified', 'clean', 2 FROM o WHERE NOT f""")
def m1_stage_trace(spark, d):
    """Fields of each sale over its structural, classified and clean record: where they change and where they are lost.

    Records are built of the sections and fields that a path traced, or the clean record, reads: the others' values are in no row.
    """
    read = lambda stage: {path.split(".")[1].split("[")[0] for _, s, path in TRACED if s == stage}
    fields = frozenset(read("classified") | {"rt_id", "header", "seller"})
    sections = frozenset(read("structural").union(*(R.RECORD[f][0] for f in fields)))
    p = F.col("p")
    page = _pages(spark, d).select("o_orderkey", S.page(F.col("html"), sections).alias("p")).select("o_orderkey", "p", R.classified(p, fields).alias("c"))
    clean = F.struct(F.col("c.rt_id").alias("id"), F.col("c.header.sale_price").alias("price"), A.contact_address(F.col("c.seller.address.lines")).alias("seller"))
    records = page.select("o_orderkey", F.to_json("p").alias("structural"), F.to_json("c").alias("classified"), F.to_json(clean).alias("clean"))
    return lineage.record_trace(records, "o_orderkey", TRACED, ("structural", "classified", "clean")).drop("trace")
