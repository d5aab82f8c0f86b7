"""HTML read by its structure: elements of registry pages, rows of results pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgraph.functions import html as H
from landgraph.functions.dom import element_texts
from landgraph.plans.naming import book
from landgraph.session import table

QUERIES, SQL, query = book()


@query("""SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN 'Own' || s_nationkey || '&Co.' END AS owner, CASE WHEN s_acctbal >= 0 THEN 'Lot' || s_suppkey || 'Plan7' END AS legal, CASE WHEN s_acctbal >= 0 THEN '' END AS missing FROM supplier""")
def a6_h10_registry_elements(spark, d):
    """Nested and void elements, both kinds of quotes, open tags; a page without the registry's panel has no record."""
    s = table(spark, d, "supplier")
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    panel = F.when(F.col("s_acctbal") >= 0, "<section ID='pr-expansion-panel-registry' hidden>").otherwise("<section id=pr>")
    html = F.concat(
        F.lit("<html><script>var x = '<p id=\"reg-on\">no</p>';</script>"), panel, F.lit('<div id="reg-on" class=\'a\'><b>Own</b> <i title="a>b">'), nation, F.lit("</i>&amp;<img src=x>Co.<!-- <b>not</b> --></div><p id='reg-legal'> Lot <span>"), key,
        F.lit('</span><br/>Plan<u> 7 </p><div id="reg-on">second</div></section></html>'),
    )
    found = element_texts(s.select("s_suppkey", html.alias("html")), "s_suppkey", "html", ["reg-on", "reg-legal", "reg-none"], required="pr-expansion-panel-registry")
    return found.select("s_suppkey", F.col("texts")["reg-on"].alias("owner"), F.col("texts")["reg-legal"].alias("legal"), F.col("texts")["reg-none"].alias("missing"))


@query("""WITH o AS (SELECT *, strftime(o_orderdate, '%-d %b %Y') AS day, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders)
SELECT o_orderkey, 0 AS position, o_orderkey || ' MAIN ST|UNIT ' || o_custkey AS address, 'Town : Region' AS city, day AS date, o_orderpriority AS note, 'Shop & flat' AS description, 'Seller ' || o_custkey || '|Second' AS sellers, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'Buyer' END AS buyers, '$' || price AS price FROM o
UNION ALL SELECT o_orderkey, 2, '', '', '', '', '', 'Only', '', '' FROM o WHERE o_orderstatus = 'P'""")
def a4_results_rows(spark, d):
    """Each page has a full row, one of too few cells, and for some a row with hardly anything."""
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    td = '</td><td class="content">'
    full = F.concat(
        F.lit('<tr><td class="content"><a href="#" class="propAddr" title="x">'), k, F.lit(" MAIN ST<br />UNIT "), c, F.lit("<br></a><br />Town : Region<br/>"), F.date_format("o_orderdate", "d MMM yyyy"), F.lit('<br />\n<font color="#CC0000">'), F.col("o_orderpriority"),
        F.lit(f'</font>{td}<p class="propDesc">Shop &amp; flat</p>Seller '), c, F.lit("<br />Second"), F.when(F.col("o_orderstatus") == "F", "").otherwise('<font color="#cccccc">to </font>Buyer<br />'), F.lit(f"{td}$"), F.floor("o_totalprice").cast("string"), F.lit("</td></tr>"),
    )
    page = F.concat(F.lit("<table>"), full, F.lit(f'<tr><td class="content">a{td}b</td></tr>'), F.when(F.col("o_orderstatus") == "P", f'<tr><td class="content">no link: x{td}Only{td}</td></tr>').otherwise(""), F.lit("</table>"))
    rows = o.select("o_orderkey", F.explode(H.results_rows(page)).alias("r"))
    text = lambda f: F.array_join(f"r.{f}", "|")
    return rows.select(
        "o_orderkey", "r.position", text("address_lines").alias("address"), F.col("r.city_region").alias("city"), F.col("r.date_text").alias("date"), "r.note", "r.description",
        text("seller_lines").alias("sellers"), text("buyer_lines").alias("buyers"), F.col("r.price_text").alias("price"),
    )
