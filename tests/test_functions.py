"""Scalar functions on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from landgraph.functions import address as A
from landgraph.functions import assessment as Q
from landgraph.functions import html as H
from landgraph.functions import record as R
from landgraph.functions import sections as S
from landgraph.functions import text as T
from landgraph.functions import values as V
from landgraph.functions.classify import line_label
from landgraph.plans.cases import ADDRESSES, LABELS


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'double' if isinstance(v, float) else 'string'}" for n, v in zip(names, values, strict=True)))
    return df.select(f(*(F.col(n) for n in names)).alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("12 34 567 890 12345", "12345678901234500000"), ("1234567890123", "12345678901230000000"), ("123", ""), ("A1234567890123", ""), ("12345678.90123", ""), ("0" * 15, ""), ("1" * 21, "")])
def test_roll_number(spark, raw, want):
    assert one(spark, V.roll_number, raw) == want


@pytest.mark.parametrize("raw,want", [("12345-678", "123456780"), ("1234567890", "1234567890"), ("", "")])
def test_pin(spark, raw, want):
    assert one(spark, V.pin, raw) == want


def test_several_pins(spark):
    assert one(spark, V.pins, "11111-1111, 222222222 and 333") == ["111111111", "222222222", "333000000"]


@pytest.mark.parametrize("raw,want", [("Acme Inc Ltd", "ACME INC"), ("Acme Ltd Inc", "ACME"), ("  acme   holdings ", "ACME HOLDINGS")])
def test_group_name(spark, raw, want):
    assert one(spark, T.group_name, raw) == want


@pytest.mark.parametrize("raw,want", [("1.5 acres", 1.5), ("2 ha", 4.94), ("43,560 sq ft", 1.0), ("irregular", None)])
def test_site_acres(spark, raw, want):
    assert one(spark, V.site_acres, raw) == want


def test_haversine(spark):
    at = lambda *v: one(spark, V.haversine, *v)
    assert at(43.0, -79.0, 43.0, -79.0) == 0
    assert 110_000 < at(43.0, -79.0, 44.0, -79.0) < 112_000


def test_decompose(spark):
    names = ("line", "number", "name", "suffix", "direction", "unit", "kind", "display")
    df = spark.createDataFrame(ADDRESSES, ", ".join(f"{n} string" for n in names)).withColumn("a", A.decompose(F.col("line")))
    got = df.select("line", F.col("a.street_number"), F.col("a.street_name"), F.col("a.street_suffix"), F.col("a.street_direction"), F.trim(F.concat_ws(" ", "a.suite_type", "a.suite_number")), A.address_type(F.col("a")), F.col("a.display"))
    assert sorted(map(tuple, got.collect())) == sorted(ADDRESSES)


def test_expand_range(spark):
    assert one(spark, A.expand_range, "10-14") == ["10-14", "10", "14"]
    assert one(spark, A.expand_range, "10, 12, 14") == ["10, 12, 14", "10", "12", "14"]
    assert one(spark, A.expand_range, "") == []


def test_line_labels(spark):
    df = spark.createDataFrame([(x[0], x[1], x[2]) for x in LABELS], "line string, label string, kind string")
    wrong = df.withColumn("got", line_label(F.col("line"))).filter(~(F.col("got.label").eqNullSafe(F.col("label")) & F.col("got.kind").eqNullSafe(F.col("kind"))))
    assert wrong.collect() == []
    # who is a person is told by the names given
    assert one(spark, lambda x: line_label(x, ("Zaphod",)), "Prefect and Zaphod Beeblebrox").label == "contact_name"


def test_names_and_titles_of_nulls(spark):
    got = spark.createDataFrame([(None,)], "x string").select(line_label(F.col("x")).alias("l"), A.decompose(F.col("x")).alias("a"), S.page(F.col("x")).alias("p"), R.classified(S.page(F.col("x"))).alias("c")).first()
    assert got.l.label == "empty" and got.a.display == "" and got.p.site_lines == [] and got.c.seller.parties == [] and got.c.consideration.cash is None


def test_sale_dates(spark):
    assert [one(spark, R.sale_date, x) for x in ("5 Jul 2014", "17 Foo 2001", "soon", "")] == ["2014-07-05", "2001-00-17", "soon", ""]


def test_address_entries(spark):
    lines = ["UNIT 9", "12 MAIN ST", "UNIT 4", "PT LOT 3", "PLAN 5", "HIGHWAY 7", "", "DOWNTOWN"]
    got = spark.createDataFrame([(lines,)], "x array<string>").select(R.address_entries(F.col("x")).alias("e")).first().e
    assert [(e.lines, e.type, e.geocodable) for e in got] == [(["UNIT 9"], "unit_only", False), (["12 MAIN ST", "UNIT 4"], "street_address", True), (["PT LOT 3", "PLAN 5"], "legal_description", False), (["HIGHWAY 7"], "highway", False), (["DOWNTOWN"], "name_only", False)]


def test_assessment_values(spark):
    area = lambda x: one(spark, Q.site_area, x)
    assert [tuple(area(x)) for x in ("104963.55F", "500M", "50,806  ft²", "1.2  acres", "3 ha")] == [(104963.55, "sqft", 2.41), (500.0, "sqm", 0.12), (50806.0, "sqft", 1.17), (1.2, "acres", 1.2), (3.0, "hectares", 7.41)]
    assert area("N/A") is None and one(spark, Q.dimension, "237.84 ft") == 237.84 and one(spark, Q.dimension, "N/A") is None
    got = one(spark, Q.assessed_address, "5 LONDON RD LONDON ON N4G 4W4", "London")
    assert (got.street, got.city, got.postal_code, got.display_street) == ("5 LONDON RD", "LONDON", "N4G 4W4", "5 London Road")


def test_html(spark):
    assert one(spark, H.lines, "a&nbsp;b<br />c<br><BR/>") == ["a b", "c"]
    assert one(spark, lambda x: H.between(x, "<h>", ("</h>", "<p>")), "x<h>yes<p>no</h>") == "yes"
    assert one(spark, lambda x: H.between(x, "<h>", ("</h>",)), "nothing") == ""
    assert one(spark, H.full_decoded, "&eacute;&amp;&nbsp;") == "é& "
    assert one(spark, H.table_rows, "<tr><td>a</td><th>b</th></tr>") == [["a", "b"]]


def test_dates_and_money(spark):
    assert one(spark, lambda x: V.iso_date(x, "d MMM yyyy"), "7 Jul 2014") == "2014-07-07"
    assert one(spark, lambda x: V.iso_date(x, "d MMM yyyy"), "soon") == "soon"
    assert one(spark, V.whole_money, "$2,550,000") == 2550000
    assert one(spark, V.whole_money, "n/a") is None
    assert one(spark, T.phone_of, "call (416) 555-0100 now") == "416-555-0100"
