"""Detail pages, contact lines, addresses, assessments and points of interest: the parsers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgraph.functions import address as A
from landgraph.functions import assessment as Q
from landgraph.functions import places as P
from landgraph.functions import record as R
from landgraph.functions import sections as S
from landgraph.functions import text as T
from landgraph.functions.classify import line_label
from landgraph.plans import cases as C
from landgraph.plans.naming import book
from landgraph.session import spread, table

QUERIES, SQL, query = book()


def detail_page(key, cust, status, price, day, priority):
    """An order as a sale's detail page."""
    k, c = key.cast("string"), cust.cast("string")
    grey = lambda label: F.lit(f'<font color="#848484">{label}</font>')
    money = F.format_number(F.floor(price), 0)
    phone = F.concat(F.lit("416-555-"), F.lpad(cust.cast("string"), 4, "0"))
    buyer = F.when(status == "F", F.lit("<br />Named Individual(s)<p />")).otherwise(
        F.concat(F.lit("<br />BUYER "), c, F.lit(" LTD&nbsp;&nbsp;&nbsp;"), phone, F.lit("<p />c/o Smith &amp; Jones<br />Barristers<br />Suite "), c, F.lit("<br />Buffalo, NY 14201<p />"))
    )
    return F.concat(
        F.lit('<html><body><strong id="address">'), k, F.lit(" SAMPLE RD<br />UNIT "), c, F.lit("</strong><br />\nTown "), c, F.lit(" : Region<br />\n"), F.date_format(day, "d MMM yyyy"), F.lit("&nbsp;&nbsp;$"), money, F.lit('&nbsp;&nbsp;<font color="#CC0000">'), priority, F.lit("</font>"),
        grey("Transferor(s)"), F.lit("<br />Seller "), c, F.lit(" in right of<br />Ontario&nbsp; &nbsp; &nbsp;"), phone, F.lit("<br /><em>Trade "), k, F.lit("</em><p />Attn: Mary Smith<br />"), k, F.lit(" Main St<br />Toronto, Ontario<br />K1A 0B1<p />"),
        grey("Transferee(s)"), buyer, grey("Description"), F.lit("<br />First "), k, F.lit("<p />Second more info: <a href=\"#\" onclick=\"window.open('/assets/files/"), k, F.lit(".pdf')\">pdf</a>"),
        grey("Site"), F.lit("<br />PIN: "), k, F.lit("+<p />1.5 acres<p />Plan "), k, F.lit("<p />North side of King"), grey("Assessment Roll Number"), F.lit("<br />19 04 "), k,
        grey("Consideration"), F.lit("<br />cash: $"), money, F.lit(" debt: $"), c, F.lit("<br />chattels: $5<p />chargee: Bank "), c, F.lit("<br />Second Name<br />principal: $"), k, F.lit(" rate: prime<br />registered: 07/17/2014 due: on demand<p />Named Individual(s)<br />principal: $7"),
        grey("Broker/Agent"), F.lit("<br />Firm "), c, F.lit(": Ann One &amp; Bob Two "), phone, F.lit('<a href="?page=details&x=1">next</a>'), F.lit('<font color="#848484">'), c, F.lit(" / 500&nbsp;&nbsp;RT"), k, F.lit("</font></body></html>"),
    )


def _pages(spark, d):
    """Detail pages of orders dealt over all cores."""
    return spread(spark, d, "orders").select("o_orderkey", detail_page(*(F.col(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))).alias("html"))


@query("""SELECT o_orderkey, o_custkey || ' / 500' AS position, 'RT' || o_orderkey AS rt_id, o_orderkey || ' SAMPLE RD|UNIT ' || o_custkey AS address, 'Town ' || o_custkey || ' : Region' AS place, strftime(o_orderdate, '%-d %b %Y') AS day,
 '$' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS price, o_orderpriority AS note FROM orders""")
def h5_h6_footer_header(spark, d):
    f, h = S.footer(F.col("html")), S.header(F.col("html"))
    rows = _pages(spark, d).select("o_orderkey", f.alias("f"), h.alias("h"))
    return rows.select("o_orderkey", F.col("f.page_position").alias("position"), "f.rt_id", F.array_join("h.address_lines", "|").alias("address"), F.col("h.city_region").alias("place"), F.col("h.date_text").alias("day"), F.col("h.price_text").alias("price"), "h.note")


@query("""SELECT o_orderkey, 'Seller ' || o_custkey || ' in right of|Ontario     416-555-' || lpad(CAST(o_custkey AS VARCHAR), 4, '0') AS seller, 'Trade ' || o_orderkey AS trade, 'Attn: Mary Smith|' || o_orderkey || ' Main St|Toronto, Ontario|K1A 0B1' AS seller_contact,
 CASE WHEN o_orderstatus = 'F' THEN 'Named Individual(s)' ELSE 'BUYER ' || o_custkey || ' LTD   416-555-' || lpad(CAST(o_custkey AS VARCHAR), 4, '0') END AS buyer, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'c/o Smith & Jones|Barristers|Suite ' || o_custkey || '|Buffalo, NY 14201' END AS buyer_contact FROM orders""")
def h7_party_blocks(spark, d):
    rows = _pages(spark, d).select("o_orderkey", S.party(F.col("html"), S.SELLER).alias("s"), S.party(F.col("html"), S.BUYER).alias("b"))
    text = lambda c: F.array_join(c, "|")
    return rows.select("o_orderkey", text("s.party_lines").alias("seller"), F.col("s.trade_name").alias("trade"), text("s.contact_lines").alias("seller_contact"), text("b.party_lines").alias("buyer"), text("b.contact_lines").alias("buyer_contact"))


@query("""SELECT o_orderkey, 'First ' || o_orderkey || '||Second' AS description, '/assets/files/' || o_orderkey || '.pdf' AS info, 'PIN: ' || o_orderkey || '+||1.5 acres||Plan ' || o_orderkey || '||North side of King' AS site, '19 04 ' || o_orderkey AS roll,
 'cash: $' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || ' debt: $' || o_custkey || '|chattels: $5||chargee: Bank ' || o_custkey || '|Second Name|principal: $' || o_orderkey || ' rate: prime|registered: 07/17/2014 due: on demand||Named Individual(s)|principal: $7' AS consideration,
 'Firm ' || o_custkey || ': Ann One & Bob Two 416-555-' || lpad(CAST(o_custkey AS VARCHAR), 4, '0') AS broker FROM orders""")
def h8_h9_sections(spark, d):
    h = F.col("html")
    text = lambda c: F.array_join(c, "|")
    return _pages(spark, d).select("o_orderkey", text(S.description(h)).alias("description"), S.more_info(h).alias("info"), text(S.site(h)).alias("site"), S.roll_text(h).alias("roll"), text(S.consideration(h)).alias("consideration"), text(S.broker(h)).alias("broker"))


@query("""SELECT o_orderkey, 'RT' || o_orderkey AS rt_id, strftime(o_orderdate, '%Y-%m-%d') AS sale_date, CAST(floor(o_totalprice) AS BIGINT) AS sale_price, 'Town ' || o_custkey AS city, 'Region' AS region, o_orderkey || ' SAMPLE RD/UNIT ' || o_custkey || ' street_address' AS entries,
 'Seller ' || o_custkey || ' in right of Ontario' AS seller, '416-555-' || lpad(CAST(o_custkey AS VARCHAR), 4, '0') AS seller_phone, 'Mary Smith (attn)' AS seller_contact, o_orderkey || ' Main St, Toronto, Ontario, K1A 0B1' AS seller_address,
 CASE WHEN o_orderstatus = 'F' THEN 'Named Individual(s)' ELSE 'BUYER ' || o_custkey || ' LTD' END AS buyer, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'law_firm: Smith & Jones, Barristers' END AS buyer_care_of, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'Buffalo NY 14201' END AS buyer_city,
 CAST(o_orderkey AS VARCHAR) AS pin, 1.5 AS acres, 'Plan ' || o_orderkey AS legal, 'North side of King' AS location, CAST(o_custkey AS BIGINT) AS debt, CAST(5 AS BIGINT) AS chattels,
 'Bank ' || o_custkey || '/Second Name ' || o_orderkey || ' prime 07/17/2014 on demand; Named Individual(s) 7   ' AS charges, 'Firm ' || o_custkey || ': Ann One, Bob Two' AS broker, 'First ' || o_orderkey || '//Second' AS description FROM orders""")
def h23_h26_h32_records(spark, d):
    c = _pages(spark, d).select("o_orderkey", S.page(F.col("html")).alias("p")).select("o_orderkey", R.classified(F.col("p")).alias("c"))
    flat = lambda x: F.replace(x, F.lit("\n"), F.lit("/"))
    entry = lambda e: F.concat_ws(" ", F.array_join(e["lines"], "/"), e["type"])
    charge = lambda x: F.concat_ws(" ", flat(x["chargee"]), x["principal"].cast("string"), x["rate"], x["registered"], x["due"])
    seller, buyer = F.col("c.seller"), F.col("c.buyer")
    return c.select(
        "o_orderkey", "c.rt_id", "c.header.sale_date", "c.header.sale_price", "c.header.city", "c.header.region", F.array_join(F.transform("c.header.address_entries", entry), "; ").alias("entries"),
        F.array_join(seller["parties"], "; ").alias("seller"), seller["phone"].alias("seller_phone"), F.array_join(F.transform(seller["contacts"], lambda x: F.concat(x["name"], F.lit(" ("), x["title"], F.lit(")"))), "; ").alias("seller_contact"),
        F.concat_ws(", ", F.array_join(seller["address"]["lines"], "/"), seller["address"]["city"], seller["address"]["province"], seller["address"]["postal"]).alias("seller_address"),
        F.array_join(buyer["parties"], "; ").alias("buyer"), F.concat(buyer["care_of"]["type"], F.lit(": "), buyer["care_of"]["text"]).alias("buyer_care_of"), F.trim(F.concat_ws(" ", buyer["address"]["city"], buyer["address"]["province"], buyer["address"]["postal"])).alias("buyer_city"),
        "c.site.pin", F.col("c.site.acreage").alias("acres"), F.col("c.site.legal_description").alias("legal"), "c.site.location", "c.consideration.debt", "c.consideration.chattels", F.array_join(F.transform("c.consideration.charges", charge), "; ").alias("charges"),
        F.array_join(F.transform("c.brokers", lambda b: F.concat_ws(": ", b["brokerage"], F.array_join(b["agents"], ", "))), "; ").alias("broker"), flat(F.col("c.description.description")).alias("description"),
    )


@query(f"SELECT c_custkey, label, kind FROM customer JOIN (VALUES {C.values((b, c) for _, b, c in C.LABELS)}) v(n, label, kind) ON c_custkey % {len(C.LABELS)} = n")
def h24_line_labels(spark, d):
    rows = C.dealt(spark, d, "customer", "c_custkey", [x[0] for x in C.LABELS]).select("c_custkey", line_label(F.col("c0")).alias("l"))
    return rows.select("c_custkey", "l.label", "l.kind")


@query(f"SELECT p_partkey, number, name, suffix, direction, unit, kind, display FROM part JOIN (VALUES {C.values(x[1:] for x in C.ADDRESSES)}) v(n, number, name, suffix, direction, unit, kind, display) ON p_partkey % {len(C.ADDRESSES)} = n")
def h34_h46_addresses(spark, d):
    rows = C.dealt(spark, d, "part", "p_partkey", [x[0] for x in C.ADDRESSES]).select("p_partkey", A.decompose(F.col("c0")).alias("a"))
    unit = F.trim(F.concat_ws(" ", "a.suite_type", "a.suite_number"))
    return rows.select("p_partkey", F.col("a.street_number").alias("number"), F.col("a.street_name").alias("name"), F.col("a.street_suffix").alias("suffix"), F.col("a.street_direction").alias("direction"), unit.alias("unit"), A.address_type(F.col("a")).alias("kind"), "a.display")


@query(f"SELECT c_custkey, kind FROM customer JOIN (VALUES {C.values((b,) for _, b in C.HEADER_LINES)}) v(n, kind) ON c_custkey % {len(C.HEADER_LINES)} = n")
def h28_header_lines(spark, d):
    return C.dealt(spark, d, "customer", "c_custkey", [x[0] for x in C.HEADER_LINES]).select("c_custkey", R.header_line_type(F.col("c0")).alias("kind"))


@query(f"SELECT c_custkey, text FROM customer JOIN (VALUES {C.values((x[-1],) for x in C.GEOCODES)}) v(n, text) ON c_custkey % {len(C.GEOCODES)} = n")
def h40_h44_geocode_strings(spark, d):
    rows = C.dealt(spark, d, "customer", "c_custkey", *([x[i] for x in C.GEOCODES] for i in range(5)))
    return rows.select("c_custkey", A.geocode_string(*(F.col(f"c{i}") for i in range(5))).alias("text"))


@query("""SELECT p_partkey, (100 + p_size) || ' Third Line, Suite ' || (p_partkey + 1) AS display, true AS geocodable, unnest([(100 + p_size) || ' third line', (100 + p_size) || ' third', (100 + p_size) || ' 3rd line', (100 + p_size) || ' 3rd']) AS key FROM part""")
def h45_h46_contact_address(spark, d):
    """A unit on a line of its own joins the best line; ordinals have keys both ways."""
    lines = F.array(F.concat(F.lit("Unit "), (F.col("p_partkey") + 1).cast("string")), F.concat((F.col("p_size") + 100).cast("string"), F.lit(" third LINE, Suite "), (F.col("p_partkey") + 1).cast("string")))
    rows = spread(spark, d, "part").select("p_partkey", A.contact_address(lines).alias("a"))
    return rows.select("p_partkey", "a.display", A.is_geocodable(F.col("a")).alias("geocodable"), F.explode(A.search_keys(F.col("a"))).alias("key"))


@query("""WITH r AS (SELECT p_partkey, p_size AS a, p_size + 10 AS b FROM part) SELECT p_partkey, unnest([a || '-' || b || ' Main Street', a || ' Main Street', b || ' Main Street']) AS display FROM r""")
def h43_variations(spark, d):
    line = F.concat(F.col("p_size").cast("string"), F.lit(" - "), (F.col("p_size") + 10).cast("string"), F.lit(" MAIN ST"))
    rows = spread(spark, d, "part").select("p_partkey", F.explode(A.variations(A.decompose(line))).alias("v"))
    return rows.select("p_partkey", "v.display")


@query("""SELECT p_partkey, p_size > 10 AND p_partkey % 3 = 0 AS queued FROM part""")
def b10_geocode_queue(spark, d):
    """Entries with a number, a name with letters and no known garbage go to the geocoder."""
    k = F.col("p_partkey")
    shown = F.when(k % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" Main Street"))).when(k % 3 == 1, "Part of Lot 3").otherwise("12 34-56")
    name = F.when(k % 3 == 2, "34-56").otherwise("Main")
    entry = F.struct(shown.alias("display"), F.col("p_size").cast("string").alias("street_number"), name.alias("street_name"), (F.col("p_size") > 10).alias("geocodable"))
    return table(spark, d, "part").select("p_partkey", A.worth_geocoding(entry).alias("queued"))


@query("""SELECT s_suppkey, s_suppkey || ' Concession Street E' AS street, 'London' AS city, 'N4G 4W4' AS postal, s_suppkey || ' Concession Street E, London, Ontario N4G 4W4, Canada' AS geocode, s_suppkey || ' London Road' AS other, 'N4G4W4' AS other_postal FROM supplier""")
def h49_h50_assessed_addresses(spark, d):
    k = F.col("s_suppkey").cast("string")
    a = Q.assessed_address(F.concat(k, F.lit(" CONCESSION ST E LONDON ON N4G4W4")), F.lit("London"))
    b = Q.summary_address(F.concat(k, F.lit(" LONDON RD, LONDON, N4G4W4")))
    rows = table(spark, d, "supplier").select("s_suppkey", a.alias("a"), b.alias("b"))
    return rows.select("s_suppkey", F.col("a.display_street").alias("street"), F.col("a.display_city").alias("city"), F.col("a.postal_code").alias("postal"), F.col("a.geocode_string").alias("geocode"), F.col("b.display_street").alias("other"), F.col("b.postal_code").alias("other_postal"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%d') AS b, 'sometime' AS c, round(o_custkey + 0.25, 2) AS sqft, round((o_custkey + 0.25) / 43560, 2) AS acres, CAST(o_custkey + 0.5 AS DOUBLE) AS feet FROM orders""")
def h52_h56_assessment_values(spark, d):
    day, c = F.col("o_orderdate"), F.col("o_custkey")
    area = Q.site_area(F.concat(c.cast("string"), F.lit(".25F")))
    return table(spark, d, "orders").select(
        "o_orderkey", Q.sale_day(F.date_format(day, "MMM d, yyyy")).alias("a"), Q.sale_day(F.date_format(day, "MMMM d, yyyy")).alias("b"), Q.sale_day(F.lit("sometime")).alias("c"),
        area["value"].alias("sqft"), area["acres"].alias("acres"), Q.dimension(F.concat(c.cast("string"), F.lit(".5 ft"))).alias("feet"),
    )


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'address_parse_failed,no_pin,no_arn,no_address' WHEN 1 THEN 'no_pin,no_postal' WHEN 2 THEN 'no_arn' ELSE '' END AS tags FROM customer""")
def j9_issue_tags(spark, d):
    k = F.col("c_custkey")
    line = F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("5 ELM ST, LONDON")).otherwise(F.lit("5 ELM ST, LONDON, N4G4W4"))
    tags = Q.issue_tags(Q.summary_address(line), F.when(k % 4 > 1, k.cast("string")).otherwise(""), F.when(k % 2 == 1, 1).otherwise(0))
    return table(spark, d, "customer").select("c_custkey", F.array_join(tags, ",").alias("tags"))


@query("""SELECT 'node/' || p_partkey AS osm_id, p_name AS name, p_brand AS brand, '555' AS phone, 43.0 AS lat, CAST(p_size AS DOUBLE) AS lng, CASE WHEN p_size > 25 THEN '7' ELSE '' END AS housenumber, 'King' AS street, p_size > 25 AS has_building FROM part WHERE p_type <> 'PROMO'
UNION ALL SELECT 'way/' || p_partkey, p_brand, p_brand, '', 44.0, p_size + 0.5, '', '', true FROM part WHERE p_type = 'PROMO'""")
def h68_c7_points_of_interest(spark, d):
    """Nodes take what they lack from their building, ways lie in the middle of their outline."""
    k, x, way = F.col("p_partkey"), F.col("p_size").cast("double"), F.col("p_type") == "PROMO"
    at = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    ring = F.array(at(F.lit(43.5), x), at(F.lit(43.5), x + 1), at(F.lit(44.5), x + 1), at(F.lit(44.5), x))
    tags = F.when(way, F.create_map(F.lit("brand"), F.col("p_brand"))).otherwise(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name"), F.lit("contact:phone"), F.lit("555"), F.lit("addr:street"), F.lit("King")))
    elements = table(spark, d, "part").select(F.when(way, "way").otherwise("node").alias("type"), k.alias("id"), F.when(~way, F.lit(43.0)).alias("lat"), F.when(~way, x).alias("lon"), F.when(way, ring).alias("geometry"), tags.alias("tags"))
    square = F.array(F.array(x, F.lit(43.0)), F.array(x + 0.001, F.lit(43.0)), F.array(x + 0.001, F.lit(43.001)))
    buildings = table(spark, d, "part").filter((F.col("p_size") > 25) & ~way).select(F.concat(F.lit("node/"), k.cast("string")).alias("osm_id"), square.alias("polygon"), F.create_map(F.lit("addr:housenumber"), F.lit("7"), F.lit("addr:street"), F.lit("Queen")).alias("tags"))
    out = P.points_of_interest(elements, buildings)
    return out.select("osm_id", "name", "brand", "phone", "lat", "lng", "address.housenumber", "address.street", F.col("polygon").isNotNull().alias("has_building"))


@query("""SELECT c_custkey, 'Her Majesty the Queen in right of Ontario as represented by the Minister ' || c_custkey || ', Energy Board' AS first, 'Second Limited Partnership' AS second, '416-555-0100' AS phone FROM customer""")
def h27_e11_party_names(spark, d):
    lines = F.array(F.lit("Her Majesty the Queen in right of"), F.lit("Ontario as represented by the"), F.concat(F.lit("Minister "), F.col("c_custkey").cast("string"), F.lit(",")), F.lit("Energy Board"), F.lit("Second"), F.lit("Limited Partnership     416-555-0100"))
    rows = spread(spark, d, "customer").select("c_custkey", R.parties(lines).alias("p"))
    return rows.select("c_custkey", F.col("p.parties")[0].alias("first"), F.col("p.parties")[1].alias("second"), "p.phone")


@query("""SELECT DISTINCT p_type, 'RR 4 PO ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' McGregor' AS title, contains(p_type, 'ECO') OR contains(p_type, 'PRO') AS known FROM part""")
def h11_h21_titles_and_keywords(spark, d):
    x = F.concat(F.lit("rr 4 po "), "p_type", F.lit(" McGregor"))
    return table(spark, d, "part").select("p_type", T.title_case(x).alias("title"), T.contains_any(F.col("p_type"), ("ECO", "PRO")).alias("known")).distinct()
