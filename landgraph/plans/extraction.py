"""HTML, address, label and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgraph.functions import address as A
from landgraph.functions import html as H
from landgraph.functions import text as T
from landgraph.operators import search as S
from landgraph.plans.naming import book
from landgraph.session import spread, table

QUERIES, SQL, query = book()


@query(r"""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, CAST(len(regexp_extract_all(html, '<p>')) AS INT) AS paragraphs, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS INT) AS links FROM pages""")
def a5_h9_page_fields(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"), F.size(F.regexp_extract_all(h, F.lit("<p>"), F.lit(0))).alias("paragraphs"), F.size(H.links(h)).alias("links"))


@query(r"""WITH c AS (SELECT page_id, CASE WHEN strpos(html, '<title>') = 0 THEN '' ELSE substr(html, strpos(html, '<title>') + 7) END AS rest FROM pages),
t AS (SELECT page_id, CASE WHEN rest = '' THEN '' ELSE substr(rest, 1, CAST(least(CASE WHEN strpos(rest, '</title>') = 0 THEN length(rest) + 1 ELSE strpos(rest, '</title>') END, CASE WHEN strpos(rest, '<style>') = 0 THEN length(rest) + 1 ELSE strpos(rest, '<style>') END) - 1 AS INT)) END AS raw FROM c)
SELECT page_id, replace(replace(replace(replace(replace(replace(raw, '&nbsp;', ' '), '&#160;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS title FROM t""")
def h1_h4_section_between(spark, d):
    return table(spark, d, "pages").select("page_id", H.decoded(H.between(F.col("html"), "<title>", ("</title>", "<style>"))).alias("title"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS nav FROM pages""")
def h2_strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", H.stripped(F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1)).alias("nav"))


@query(r"""WITH r AS (SELECT o_orderkey, o_orderpriority || '<br />' || o_orderstatus || '<br>' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'x &amp; y' END || '<BR/>' AS h FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN replace(split_part(h, '<br />', 1) || '|' || split_part(split_part(h, '<br />', 2), '<br>', 1), '&amp;', '&') ELSE split_part(h, '<br />', 1) || '|' || split_part(split_part(h, '<br />', 2), '<br>', 1) || '|x & y' END AS lines FROM r""")
def h3_break_lines(spark, d):
    h = F.concat("o_orderpriority", F.lit("<br />"), "o_orderstatus", F.lit("<br>"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("x &amp; y"), F.lit("<BR/>"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(H.lines(h), "|").alias("lines"))


@query(r"""SELECT s_suppkey AS id, 'Supplier ' || s_suppkey AS name, CAST(s_nationkey AS VARCHAR) AS second, 2 AS cells FROM supplier""")
def a4_a7_table_rows(spark, d):
    h = F.concat(F.lit('<table><tr class="r"><td>Supplier&nbsp;'), F.col("s_suppkey").cast("string"), F.lit("</td><td><b>"), F.col("s_nationkey").cast("string"), F.lit("</b></td></tr></table>"))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(H.table_rows(h)).alias("cells"))
    return rows.select("id", F.col("cells")[0].alias("name"), F.col("cells")[1].alias("second"), F.size("cells").alias("cells"))


@query(r"""SELECT s_suppkey AS id, 'N' || s_nationkey AS owner, '' AS missing FROM supplier""")
def a6_h10_element_by_id(spark, d):
    h = F.concat(F.lit('<div><span id="owner" class="x">N'), F.col("s_nationkey").cast("string"), F.lit("</span></div>"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), H.element_text(h, "owner").alias("owner"), H.element_text(h, "none").alias("missing"))


@query(r"""SELECT doc_id, coalesce(regexp_extract(text, '[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}'), '') AS phone, len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM documents""")
def h18_h19_phones(spark, d):
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.regexp_extract(x, "[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}", 0).alias("phone"), F.size(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0))).cast("long").alias("numbers"))


@query(r"""SELECT DISTINCT p_type, trim(regexp_replace(upper('a,b $ ' || p_type || '. x'), '[,$.\s]+', ' ', 'g')) AS comparable, 'a, b' AS spaced FROM part""")
def h12_h17_comparable(spark, d):
    raw = F.concat(F.lit("a,b $ "), "p_type", F.lit(". x"))
    return table(spark, d, "part").select("p_type", T.comparable(raw).alias("comparable"), T.comma_spaced(F.lit("a,b")).alias("spaced")).distinct()


@query(r"""WITH r AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, CAST(p_size + 10 AS VARCHAR) AS b FROM part) SELECT p_partkey, unnest([a || '-' || b, a, b]) AS number FROM r""")
def h43_expand_range(spark, d):
    n = F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 10).cast("string"))
    return table(spark, d, "part").select("p_partkey", F.explode(A.expand_range(n)).alias("number"))


@query(r"""WITH r AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS n, lower(split_part(p_name, ' ', 2)) AS w FROM part) SELECT p_partkey, unnest([n || ' ' || w || ' street', n || ' ' || w]) AS key FROM r""")
def h42_search_keys(spark, d):
    line = F.concat(F.col("p_size").cast("string"), F.lit(" "), F.substring_index("p_name", " ", -1), F.lit(" St"))
    return spread(spark, d, "part").select("p_partkey", F.explode(A.search_keys(A.decompose(line))).alias("key"))


@query(r"""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents)
SELECT doc_id FROM t WHERE term IN ('the', 'and') OR starts_with(term, 'tion') GROUP BY doc_id HAVING bool_or(term = 'the') AND bool_or(term = 'and') AND bool_or(starts_with(term, 'tion'))""")
def l1_l3_search_all(spark, d):
    return S.match_all(S.index(table(spark, d, "documents"), "doc_id", F.col("text")), "doc_id", ["the", "and"], ["tion"])


@query(r"""SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])of[^\p{L}\p{N}]+the($|[^\p{L}\p{N}])')""")
def l3_phrase_search(spark, d):
    return S.match_phrase(S.index(table(spark, d, "documents"), "doc_id", F.col("text")), "doc_id", ["of", "the"])


@query(r"""WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents)
SELECT DISTINCT doc_id FROM t WHERE term IN ('der', 'les') AND doc_id NOT IN (SELECT doc_id FROM t WHERE term IN ('la', 'und'))""")
def l3_search_or_not(spark, d):
    return S.match_any(S.index(table(spark, d, "documents"), "doc_id", F.col("text")), "doc_id", ["der", "les"], ["la", "und"])


@query(r"""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents)
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY term HAVING count(DISTINCT doc_id) >= 20""")
def l1_inverted_index(spark, d):
    idx = S.index(table(spark, d, "documents"), "doc_id", F.col("text"))
    per_doc = idx.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs")).filter("n_docs >= 20")


@query(r"""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.none') IS NULL AS absent FROM events""")
def h64_h65_json_paths(spark, d):
    p = S.json_paths(F.col("props"), ["$.k", "$.none"])
    return table(spark, d, "events").select("event_id", p[0]["value"].cast("bigint").alias("k"), p[1]["value"].isNull().alias("absent"))


@query(r"""SELECT s_suppkey, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || s_nationkey || ',' || s_suppkey || ']},"properties":{"name":"' || s_name || '"}}' AS feature FROM supplier""")
def h67_geojson(spark, d):
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("s_nationkey").cast("long"), F.col("s_suppkey")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(F.col("s_name").alias("name")).alias("properties"))
    return table(spark, d, "supplier").select("s_suppkey", F.to_json(feature).alias("feature"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '/([0-9]+)', 1) AS number, strpos(url, '?') > 0 AS has_query FROM pages""")
def h69_name_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(u, "^https?://([^/]+)", 1).alias("host"), F.regexp_extract(u, "/([0-9]+)", 1).alias("number"), (F.instr(u, "?") > 0).alias("has_query"))
