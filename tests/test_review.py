"""The resolution chain, rules over nested records, deep differences, origins and the search language."""

import json
import random

import pytest
from pyspark.sql import functions as F

from landgraph.functions.classify import line_label
from landgraph.functions.porter import folding, porter
from landgraph.operators import fulltext, lineage, parcels, quality


def square(x, y, w=0.001):
    x, y = float(x), float(y)
    return [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]


def plain_lookup(x, y, lots):
    """The widening search over all lots."""
    for ring, number in sorted(((r, n) for n, r in lots if r), key=lambda p: p[1]):
        x0, y0, x1, y1 = ring[0][0], ring[0][1], ring[2][0], ring[2][1]
        if x0 <= x < x1 and y0 <= y < y1:
            return number, 0
    met = lambda w: [(n, r) for n, r in lots if r and r[0][0] - w <= x <= r[2][0] + w and r[0][1] - w <= y <= r[2][1] + w]
    if not met(0.0002):
        return None
    middle = lambda r: (sum(p[0] for p in r) / len(r), sum(p[1] for p in r) / len(r))
    return min(((middle(r)[0] - x) ** 2 + (middle(r)[1] - y) ** 2, n) for n, r in met(0.0018))[1], 1


def test_point_lookup_equals_all_pairs(spark):
    rng = random.Random(8)
    lots = [(f"{i:03d}", square(rng.uniform(0, 0.02), rng.uniform(0, 0.02), rng.uniform(0.0005, 0.004))) for i in range(40)] + [("900", None)]
    points = [(i, rng.uniform(-0.003, 0.027), rng.uniform(-0.003, 0.027)) for i in range(400)]
    got = parcels.point_lookup(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(lots, "number string, ring array<array<double>>"), "id")
    want = {i: hit for i, x, y in points if (hit := plain_lookup(x, y, lots))}
    assert {r.id: (r.number, r.tier) for r in got.collect()} == want
    assert {t for _, t in want.values()} == {0, 1} and len(want) < len(points)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_chain_has_every_case(spark):
    lots = [("A1", square(-80, 43)), ("A2", square(-80.01, 43)), ("A3", None), ("0000", square(-80.02, 43))]
    cache = [("C1", 43.0005, -79.9995), ("C2", None, None), ("C3", 43.1, -80.0)]
    records = [
        ("verified", "A1", 43.0005, -79.9995, None), ("override", "A2", 43.0005, -79.9995, None), ("cached", "C1", 43.0022, -80.0, None), ("unknown_centre", "C2", 43.5, -80.0, None),
        ("too_far", "C3", 43.0022, -80.5, None), ("service", "A1", 43.0035, -79.9995, None), ("spatial", "X", 43.0005, -79.9995, None), ("both", "A3", 44.0, -80.0, None),
        ("number_only", "A1", None, None, None), ("miss", "X", None, None, "P1"), ("point_only", "", 43.0005, -79.9995, "P1"), ("point_miss", None, 44.0, -80.0, None),
        ("none", "", None, None, None), ("bridge", "", None, None, " P1 "), ("zeros", "000", None, None, "P1"), ("no_bridge", "", None, None, "P2"), ("zero_parcel", "", 43.0005, -80.0195, None), ("no_lat", "A1", 0.0, -80.0, None),
    ]
    bridge = [("P1", "", 1), ("P1", "0000", 2), ("P1", "B7", 3), ("P1", "B8", 4), ("P2", "00", 1)]
    got = parcels.resolve_records(
        spark.createDataFrame(records, "id string, number string, lat double, lng double, pin string"), spark.createDataFrame(cache, "number string, lat double, lng double"),
        spark.createDataFrame(lots, "number string, ring array<array<double>>"), spark.createDataFrame(bridge, "pin string, number string, seq int"),
    )
    got = {r.id: (r.method, r.resolved, r.reason) for r in got.collect()}
    far = got.pop("too_far")
    assert far[:2] == ("unresolved", None) and far[2].startswith("arn_too_far_") and far[2].endswith("m")
    assert got == {
        "verified": ("arn_verified", "A1", None), "override": ("spatial_override", "A1", "arn_was_A2"), "cached": ("arn_cache", "C1", None), "unknown_centre": ("arn_cache", "C2", None),
        "service": ("arn_api", "A1", None), "spatial": ("spatial_geocode", "A1", None), "both": ("unresolved", None, "both_failed"), "number_only": ("arn_unverified", "A1", None), "miss": ("unresolved", None, "arn_api_miss"),
        "point_only": ("spatial_geocode", "A1", None), "point_miss": ("unresolved", None, "spatial_miss"), "none": ("unresolved", None, "no_identifiers"), "bridge": ("pin_gw", "B7", None), "zeros": ("pin_gw", "B7", None),
        "no_bridge": ("unresolved", None, "no_identifiers"), "zero_parcel": ("unresolved", None, "spatial_miss"), "no_lat": ("arn_unverified", "A1", None),
    }


def test_record_rules(spark):
    side = "struct<address:struct<lines:array<string>,original_lines:array<string>>,parties:array<struct<name:string>>,contacts:array<struct<name:string>>>"
    schema = f"id int, seller {side}, buyer {side}, transaction struct<sale_price:double,sale_date:string>"
    n = lambda *names: [(x,) for x in names]
    rows = [
        (1, ((["Acme Holdings", "Holdings St", "9 Acme Inc", "LP", None, "Incorporated"], None), n("Smith (416)555-0100", "12345 Ontario Ltd 416-555-0100", "abc 416-555-0100", "416.555.0100 abcd", None), n("12 King ST", "12th King St", "x12 King St")), None, (5.0, "2020-01-02")),
        (2, (([], ["Foo LLC"]), n("27 Bridge Street Inc", "27 Bridge Street"), None), ((None, None), None, n("Call 416 555 0100")), (0.0, "")),
        (3, None, None, (None, "Jan 2, 2020")), (4, None, None, None), (5, None, None, (1.0, None)),
    ]
    got = {(r.id, r.rule, r.severity, r.field_path, r.value) for r in quality.record_issues(spark.createDataFrame(rows, schema), "id").collect()}
    assert got == {
        (1, "company_in_address", "error", "seller.address.lines[0]", "Acme Holdings"), (1, "phone_in_name", "error", "seller.parties[0].name", "Smith (416)555-0100"), (1, "phone_in_name", "error", "seller.parties[3].name", "416.555.0100 abcd"),
        (1, "street_as_contact", "error", "seller.contacts[0].name", "12 King ST"), (2, "company_in_address", "error", "seller.address.lines[0]", "Foo LLC"), (2, "address_in_party", "warning", "seller.parties[1].name", "27 Bridge Street"),
        (2, "phone_in_name", "error", "buyer.contacts[0].name", "Call 416 555 0100"), (2, "null_required", "error", "transaction", "no price or date"), (3, "format_mismatch", "warning", "transaction.sale_date", "Jan 2, 2020"),
        (4, "null_required", "error", "transaction", "no price or date"),
    }


def test_parcel_rules(spark):
    parcel = "id int, pin string, assessments array<string>, address struct<street:string,postal_code:string>, is_active boolean, issues array<string>"
    rows = [(1, "1", ["a"], ("Main", "K1A"), True, []), (2, " ", [], None, False, ["address_parse_failed"]), (3, None, ["a", "b"], ("", ""), None, ["address_parse"]), (4, "4", ["a"], ("Main", "K1A"), None, None), (5, "5", ["a"], ("Main", "K1A"), None, None)]
    links = [(1, [("",), ("arn_cache",)]), (3, [("no_arn",), ("arn_api_miss",), ("",)]), (4, []), (5, [(None,)])]
    got = quality.parcel_issues(spark.createDataFrame(rows, parcel), spark.createDataFrame(links, "id int, resolutions array<struct<method:string>>"), "id")
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.id, set()).add(r.rule.removeprefix("gw_"))
        assert r.severity == quality.PARCEL_RULES[r.rule]
    assert by_id == {
        2: {"no_pin", "no_arn", "no_address", "inactive_registry", "address_parse_failed", "parcel_unresolved"},
        3: {"no_pin", "multiple_arns", "no_address", "no_postal", "parcel_unresolved"},
        4: {"parcel_unresolved"},
    }


def test_deep_diff(spark):
    pairs = [
        ({"a": {"b": {"c": 1, "d": [1, {"e": 2}]}}, "x": 1}, {"a": {"b": {"c": 2}}, "y": [[1]]}), ({"a": [1, 2, 3]}, {"a": [1, [2]]}), ({"a": 1, "_n": 1}, {"a": 1.0, "_n": 2}), ([1], {"a": 1}), ({"a": None}, {}), ({"z.q": 1}, {"z.q": "1"}), (None, None), ("same", "same"),
    ]
    side = lambda k: spark.createDataFrame([(i, json.dumps(p[k])) for i, p in enumerate(pairs)] + [(50 + k, "{}"), (60, "{bad" if k else "{}"), (61, None)], "id int, r string")
    got = {}
    for r in lineage.deep_diff(side(0), side(1), "id", "r").collect():
        got.setdefault(r.id, set()).add((r.path, r.change, r.old, r.new))
    assert got == {
        0: {("a.b.c", "changed", "1", "2"), ("a.b.d", "removed", '[1,{"e":2}]', None), ("x", "removed", "1", None), ("y", "added", None, "[[1]]")},
        1: {("a[1]", "changed", "2", "[2]"), ("a[2]", "removed", "3", None)},
        2: {("_n", "changed", "1", "2")}, 3: {("(root)", "changed", "[1]", '{"a":1}')}, 4: {("a", "removed", "null", None)}, 5: {("z.q", "changed", "1", '"1"')},
        50: {("(record)", "removed", "{}", None)}, 51: {("(record)", "added", None, "{}")}, 60: {("(root)", "changed", "{}", '"{bad"')},
    }
    assert {r.id for r in lineage.deep_diff(side(0), side(1), "id", "r", skip="_").collect()} == set(got) - {2}
    assert lineage.deep_diff(side(0).limit(0), side(1).limit(0), "id", "r").count() == 0


def test_trace_origin(spark):
    steps = [("a.b", 1, "s1", "a.b"), ("a.b", 2, "s2", "old"), ("a", 1, "s1", "a"), ("a.b.c", 1, "s2", "deep.c")]
    stages = [(1, "s1", {"a": {"b": ["v", {"x": "w"}]}}), (1, "s2", {"old": "v", "deep": {"c": 1}, "else": ["w"]}), (2, "s2", {"old": ["q"]})]
    issues = [(1, "a.b[0]", "v"), (1, "a.b[1].x", "w"), (1, "a.bb", "v"), (1, "a.z", "nowhere"), (1, "a.b.c", "v"), (2, "a.b", "q"), (2, "a.b", "r"), (3, "a.b", "v"), (1, "zzz", "v"), (1, "a.b[0]", "v")]
    got = lineage.trace_origin(
        spark.createDataFrame(issues, "id int, field_path string, value string"), spark.createDataFrame(steps, "field string, step int, stage string, stage_field string"), spark.createDataFrame([(i, s, json.dumps(r)) for i, s, r in stages], "id int, stage string, record string")
    )
    assert {(r.id, r.field_path, r.value): (r.introduced_at, r.origin_field, r.source_field) for r in got.collect()} == {
        (1, "a.b[0]", "v"): ("s2", "old", None), (1, "a.b[1].x", "w"): ("s1", "a.b", "old"), (1, "a.bb", "v"): ("s2", "old", None), (1, "a.z", "nowhere"): ("clean", "a.z", None), (1, "a.b.c", "v"): ("clean", "a.b.c", "deep.c"),
        (2, "a.b", "q"): ("s2", "old", None), (2, "a.b", "r"): ("clean", "a.b", None), (3, "a.b", "v"): ("clean", "a.b", None), (1, "zzz", "v"): ("unknown", "zzz", None),
    }


def test_porter_on_the_published_words():
    # The examples of the published description.
    words = (
        "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz "
        "failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile "
        "analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic "
        "formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens "
        "irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler "
        "probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil"
    ).split()
    assert {w: porter(w) for w in words[::2]} == dict(zip(words[::2], words[1::2], strict=True))
    assert porter("as") == "as" and porter("naïve") == "naïve" and porter("x2s") == "x2s"
    assert dict(zip(*folding(), strict=True))["é"] == "e" and "ø" not in folding()[0]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/t"
    rows = [(0, "The cats were Jumping over fences", "one"), (5000, "a cat jumps; the fence", "two cats"), (7, None, ""), (8, "Señor Müller's café", "x"), (9, "cat dog cat bird fish", "dog"), (10, "aa b aa b aa", None)]
    df = spark.createDataFrame(rows, "id long, body string, title string")
    fulltext.write_index(df, "id", ["body", "title"], path)
    return fulltext.Index(spark, path, ["body", "title"])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("cat", {0, 5000, 9}), ("cats jumped", {0, 5000}), ('"cat jump"', {5000}), ("title:cat", {5000}), ("{title body}: dog NOT bird", set()), ("senor OR CAFÉ", {8}), ("mull*", {8}), ("fenc* AND ^the", {0}), ("NEAR(cat fish, 1)", {9}), ("NEAR(cat fish, 0)", set()),
        ("NEAR(fish dog cat)", {9}), ("NEAR(dog fish,2) cat", {9}), ("aa + b + aa", {10}), ('"aa b aa b aa"', {10}), ('"b b"', set()), ("cat NOT (dog OR fence)", set()), ("dog cat OR senor", {8, 9}), ('"!!"', set()), ("title: body: cat", None), ("^dog", {9}),
        ("NOT cat", None), ("(cat", None), ("cat)", None), ("nocolumn: cat", None), ('"open', None), ("", None), ("cat AND", None), ("NEAR(cat, x)", None), ("NEAR()", None), ("a + ", None), ("* a", None), (":", None),
    ],
)
def test_search_language(index, text, want):
    if want is None:
        with pytest.raises(fulltext.SearchError):
            index.search(text)
    else:
        assert {r.key for r in index.search(text).collect()} == want


def test_search_reads_only_its_terms(index):
    plan = index.search("cat")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,cat)" in plan and "body" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_company_words_and_long_chargees(spark):
    from landgraph.functions.record import consideration

    lines = ["Hoist Catering", "Sunny Winery", "Albert Kowal CA", "Mary Smith"]
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select("x", line_label(F.col("x"))["label"].alias("label"))
    found = {r.x: r.label for r in rows.collect()}
    assert found["Hoist Catering"] == found["Sunny Winery"] == "company_name" and found["Mary Smith"] == "contact_name"
    name = "n" * 12_000
    df = spark.createDataFrame([(["cash: $5", "", f"chargee: {name}", "principal: $7"],)], "lines array<string>")
    assert df.select(consideration(F.col("lines"))["charges"][0]["chargee"].alias("c")).first().c == name


def test_elements_by_structure():
    from landgraph.functions.dom import Elements

    e = Elements("<div id=\"a\"><b>One</b> two</div><div id='b'>x<br>y<hr id=v>z</div><p id=c>open<p id=d>&lt;next&#62;</div><i id=''>n</i></p><ul id='e'><li>1<li>2</ul>after<div id=a>again</div><style>s</style>")
    assert [e.text(i) for i in "abvcdeq"] == ["Onetwo", "xyz", "", "open<next>n12afteragain", "<next>n", "12", ""]
    assert Elements("").spans == {}


def test_elements_of_pages(spark):
    from landgraph.functions.dom import element_texts

    df = spark.createDataFrame([(1, "<p id=x>a</p>"), (2, None), (3, ""), (4, "<i id=r></i>")], "k int, h string")
    got = {r.k: r.texts for r in element_texts(df, "k", "h", ["x"], required="r").collect()}
    assert got == {1: None, 2: None, 3: None, 4: {"x": ""}}
    assert {r.k: r.texts for r in element_texts(df, "k", "h", ["x"]).collect()}[1] == {"x": "a"}


def test_results_rows(spark):
    from landgraph.functions.html import results_rows

    td = '</td><td class="content">'
    page = f'<tr><td class="content">x{td}y</td></tr><tr><td class="content"><a class="propAddr">1 A</a>1 Jan 2020: late<br>2 Feb 2021<br>3 Mar 2022: z{td}S<font color="#cccccc">to</font>B1<br/>B2{td}<b>$5</b></td></tr>'
    rows = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(results_rows(F.col("h")).alias("r")).collect()
    assert [r.asDict() for r in rows[0].r] == [{"position": 1, "address_lines": ["1 A"], "city_region": "1 Jan 2020: late", "date_text": "2 Feb 2021", "note": "", "description": "", "seller_lines": ["S"], "buyer_lines": ["B1", "B2"], "price_text": "$5"}]
    assert rows[1].r is None and rows[2].r == []


def test_validation_summary_of_small_and_empty_tables(spark):
    from landgraph.operators.validation import validation_summary

    records = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("", None), (None, ""), ("b", "3")], "source_id string, resolved string")
    cache = spark.createDataFrame([("1",), ("1",), ("9",), (None,)], "number string")
    built = spark.range(6)
    rows = {r.check: r for r in validation_summary(records, cache, built, {"osm": spark.range(0), "pois": spark.range(0)}, needed=["osm"]).collect()}
    assert {c: (r.n, r.of) for c, r in rows.items()} == {
        "no_records": (6, None), "missing_source_id": (2, 6), "repeated_source_id": (2, 6), "resolved": (4, 6), "resolved_in_cache": (2, 4), "resolved_not_in_cache": (2, 4),
        "drift": (0, 6), "count_osm": (0, None), "count_pois": (0, None), "passed": (2, None),
    }
    assert {c for c, r in rows.items() if r.flagged} == {"missing_source_id", "repeated_source_id", "resolved_not_in_cache", "count_osm", "passed"}
    at = lambda n: {r.check: r.flagged for r in validation_summary(records, cache, spark.range(n), {}).collect()}["drift"]
    assert (at(0), at(5), at(7), at(100)) == (False, True, True, True)
    none = {r.check: (r.n, r.flagged) for r in validation_summary(records.limit(0), cache.limit(0), None, {}).collect()}
    assert none == {"no_records": (0, True), "missing_source_id": (0, False), "repeated_source_id": (0, False), "resolved": (0, False), "resolved_in_cache": (0, False), "resolved_not_in_cache": (0, False), "passed": (1, True)}


def test_fields_are_traced_over_stages_with_holes(spark):
    from landgraph.operators.lineage import stage_trace

    fields = (("a", "raw", "$.x"), ("a", "mid", "$.y.z"), ("a", "end", "$.x"), ("b", "raw", "$.b"), ("b", "end", "$.b"))
    rows = [
        (1, "raw", '{"x":"1","b":"q"}'), (1, "mid", '{"y":{"z":"1"}}'), (1, "end", '{"x":"2","b":"q"}'),
        (2, "raw", '{"x":"1"}'), (2, "end", '{"x":"1"}'),  # no middle record
        (3, "mid", '{"y":{"z":"5"}}'), (3, "end", "{}"),  # comes in late and is lost
        (4, "raw", "no json"), (5, "raw", None), (None, "end", '{"x":"7"}'), (6, "other", '{"x":"7"}'),
    ]
    stages = spark.createDataFrame(rows, "id long, stage string, record string")
    got = {(r.id, r.field): (r.first_value, r.last_value, r.changed_at, r.lost_at, r.held, len(r.trace)) for r in stage_trace(stages, fields, ("raw", "mid", "end")).collect()}
    assert got == {
        (1, "a"): ("1", "2", "end", None, 3, 3), (1, "b"): ("q", "q", None, "mid", 2, 2), (2, "a"): ("1", "1", None, "mid", 2, 2),
        (3, "a"): ("5", "5", None, "end", 1, 1), (None, "a"): ("7", "7", None, None, 1, 1),
    }
    assert stage_trace(stages.limit(0), fields, ("raw", "mid", "end")).count() == 0


def test_a_chargee_of_any_length_stays_whole(spark):
    from landgraph.functions.record import consideration

    name = "Bank " + "x" * 12_000
    lines = F.array(F.lit("cash: $1"), F.lit(""), F.lit("chargee: " + name), F.lit("principal: $7"))
    row = spark.range(1).select(consideration(lines).alias("c")).first().c
    assert [(c.chargee, c.principal) for c in row.charges] == [(name, 7)] and row.cash == 1
