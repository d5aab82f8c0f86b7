"""What keeps the queries within their limits on large tables, seen in their plans and their tasks."""

from landgraph.plans import registry

SF = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stage_trace_builds_each_record_once(spark):
    assert optimized(registry.QUERIES["m1_stage_trace"](spark, SF)).count("StructsToJsonEvaluator") == 3


def test_areas_are_those_of_sql_for_far_and_long_rings(spark, tmp_path):
    import duckdb

    name = "h59_h61_centroid_and_area"
    spark.range(60_000).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute("CREATE TABLE supplier AS SELECT range AS s_suppkey FROM range(60000)")
    want = dict(con.execute(f"SELECT s_suppkey, ksqft FROM ({registry.SQL[name]})").fetchall())
    got = {r.s_suppkey: r.ksqft for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_point_query_broadcasts_no_lots(spark):
    assert broadcasts(registry.QUERIES["c9_point_query"](spark, SF)) == 0


def test_resolution_by_tiers_broadcasts_no_table(spark):
    assert broadcasts(registry.QUERIES["i5_resolution_by_tiers"](spark, SF)) == 0


def test_addresses_are_taken_apart_once_and_on_all_cores(spark):
    for name in ("h43_variations", "h42_search_keys"):
        plan = optimized(registry.QUERIES[name](spark, SF))
        assert "Repartition" in plan and plan.count("LOCATED") == 1, name


def test_rows_that_name_nothing_are_in_no_join(spark):
    from landgraph.operators.relational import left_join_named

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "z")], "id long, k string")
    dim = spark.createDataFrame([("a", 7), (None, 8)], "k string, v int")
    joined = left_join_named(rows, dim, "k")
    assert sorted((r.id, r.k, r.v) for r in joined.select("id", "k", "v").collect()) == [(1, "a", 7), (2, None, None), (3, None, None), (4, "z", None)]
    assert "Union" in optimized(registry.QUERIES["c25_deal_links"](spark, SF))


def test_page_patterns_try_nothing_but_at_a_tag(spark):
    import re

    from landgraph.functions import classify, sections

    starts = sections.any_marker("Site", also=(sections.POSITION,), end=sections.END).replace(r"\Q", "").replace(r"\E", "")
    page = 'a Site</font> <b><a href="?page=x"><font color="#848484">Sites <font color="#848484">%s<a  href="?page=details&x">'
    assert [re.search(starts, page % s).start() - page.index("%s") for s in ("Site</font>", "3 /4", "x", "</body>")] == [-22, -22, 1, 0]
    words = classify._any(classify.COMPANY)
    assert words.startswith("(?=[") and all(re.search(words, f"x {w}") for w in classify.COMPANY) and not re.search(words, "x realty y Real y")


def test_words_go_through_the_shuffle_as_parts_of_blocks(spark, tmp_path):
    import pyarrow as pa

    from landgraph.operators import fulltext

    rows = [(5000, "b", ["x", "runs", "x"]), (3, "b", ["x"]), (2, "b", ["run", "x"]), (2, "a", ["x"]), (7, "a", []), (None, "a", ["x"])]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.list_(pa.string())), strict=True)]
    got = {(r["term"], r["field"], r["block"]): [(d["offset"], d["places"]) for d in r["documents"]] for r in fulltext._ordered(*columns, True).to_pylist()}
    assert got.pop(("x", "a", None)) == [(4095, [0])]
    assert got == {("x", "b", 0): [(2, [1]), (3, [0])], ("x", "b", 1): [(904, [0, 2])], ("run", "b", 0): [(2, [0])], ("run", "b", 1): [(904, [1])], ("x", "a", 0): [(2, [0])]}
    docs = spark.createDataFrame([(i, "Runs é x x" if i % 2 else None) for i in range(5000)], "id long, t string")
    fulltext.write_index(docs, "id", ["t"], f"{tmp_path}/i")
    index = spark.read.parquet(f"{tmp_path}/i").selectExpr("term", "block", "size(documents) n", "documents[0] d").collect()
    assert sorted((r.term, r.block, r.n, r.d.offset, r.d.places) for r in index) == sorted((t, b, n, 1, p) for t, p in (("run", [0]), ("e", [1]), ("x", [2, 3])) for b, n in ((0, 2048), (1, 452)))


def test_page_lines_are_cleaned_as_one_text_with_patterns_compiled_once(spark):
    from pyspark.sql import functions as F

    from landgraph.functions import classify, sections

    text = "<p> <br>a<br\r/> b <br />\r<p>c &lt;br&gt;&am\rp;<p /><p>d<x\ry> \u0085<br> <br />\t e<\r><br><p>"
    x = F.col("x")
    df = spark.createDataFrame([(text,), ("",), ("<br /> <br />",)], "x string").select(sections.paragraphs(x).alias("p"), sections.broken(x).alias("b"))
    assert [tuple(r) for r in df.collect()] == [
        (["", "a", "b", "", "c &amp;", "", "", "d\u0085", "", "e"], ["", "a", "b", "c &amp;d\u0085", "", "e"]), ([], []), ([], []),
    ]
    page = optimized(spark.createDataFrame([(text,)], "x string").select(sections.page(F.col("x")).alias("p")))
    assert "split(" not in page
    label = optimized(spark.createDataFrame([(text,)], "x string").select(classify.line_label(F.col("x")).alias("l")))
    assert label.count(classify.CARE_OF) < 8


def test_a_record_is_traced_in_its_row(spark):
    from landgraph.operators.lineage import record_trace, stage_trace

    fields, order = (("a", "raw", "$.x"), ("a", "mid", "$.y.z"), ("a", "end", "$.x"), ("b", "raw", "$.b"), ("b", "end", "$.b")), ("raw", "mid", "end")
    rows = [(1, '{"x":"1","b":"q"}', '{"y":{"z":"1"}}', '{"x":"2","b":"q"}'), (2, '{"x":"1"}', None, '{"x":"1"}'), (3, None, '{"y":{"z":"5"}}', "{}"), (4, "no json", None, None), (None, None, None, '{"x":"7"}')]
    wide = spark.createDataFrame(rows, "id long, raw string, mid string, end string")
    long = wide.selectExpr("id", "stack(3, 'raw', raw, 'mid', mid, 'end', end) AS (stage, record)")
    want = {(r.id, r.field): tuple(r) for r in stage_trace(long, fields, order).collect()}
    assert {(r.id, r.field): tuple(r) for r in record_trace(wide, "id", fields, order).collect()} == want and len(want) == 5
    plan = optimized(registry.QUERIES["m1_stage_trace"](spark, SF))
    assert not any(x in plan for x in ("Aggregate [", "Join ", "Broker/Agent</font>\\E(?:")) and "Generate stack(4" in plan


def test_lines_are_typed_once(spark):
    from pyspark.sql import functions as F

    from landgraph.functions import record, sections, text

    x, xs = F.col("x"), F.col("xs")
    rows = [(t, [t]) for t in (" a\tb  c ", "416-555-0100 Ann", "Firm: Ann & Bob, Cy and Di 416-555-0100 x 5 more 416-555-0100", "a : b : c", "", None)]
    df = spark.createDataFrame(rows, "x string, xs array<string>")
    plan = lambda c: optimized(df.select(c.alias("c")))
    assert plan(sections.header(x)).count("array_position") == 1
    assert plan(record.site(xs)).count("Surface rights") == 1 and plan(record.address_entries(xs)).count("HIGHWAY|HWY") == 1
    words = df.select(text.words_of(x).alias("a"), F.split("x", r"\s+").alias("b")).collect()
    assert [r.a for r in words] == [r.b for r in words]
    brokers = [[(b.brokerage, b.agents, b.phone) for b in r.b] for r in df.filter("x is not null").select(record.brokers(xs).alias("b")).collect()]
    assert brokers == [[("", ["a\tb  c"], "")], [("", [], "416-555-0100")], [("Firm", ["Ann", "Bob", "Cy", "Di"], "416-555-0100 x 5")], [("a", ["b : c"], "")], []]


def test_searches_shuffle_documents_and_not_places(spark, tmp_path):
    from landgraph.operators import fulltext

    texts = {1: "a a b a", 2: "b a a", 3: "ab b a", 4: "a b a b", 5: None, 6: "a"}
    docs = spark.createDataFrame([(k, t, "b a" if k == 6 else "") for k, t in texts.items()], "id long, t string, u string")
    fulltext.write_index(docs, "id", ["t", "u"], f"{tmp_path}/i", stemmed=False)
    index = fulltext.Index(spark, f"{tmp_path}/i", ["t", "u"], stemmed=False)
    found = {q: sorted(r.key for r in index.search(q).collect()) for q in ('"a a"', '"a b a"', '"b a*"', "^b", '^"a b"', 't: "b a"', "a*", "NEAR(a b, 0)", '"a b a b a"', '""')}
    assert found == {'"a a"': [1, 2], '"a b a"': [1, 4], '"b a*"': [1, 2, 3, 4, 6], "^b": [2, 6], '^"a b"': [4], 't: "b a"': [1, 2, 3, 4], "a*": [1, 2, 3, 4, 6], "NEAR(a b, 0)": [1, 2, 3, 4, 6], '"a b a b a"': [], '""': []}
    starts = index._occurrences(fulltext.parse('"a b"', ["t", "u"]))
    assert sorted(tuple(r) for r in starts.collect()) == [(1, "t", 1, 2), (4, "t", 0, 2), (4, "t", 2, 2)]
    assert [optimized(index.search(q)).count("Generate explode(") for q in ("a", "^a", '"a b"')] == [1, 1, 2]
