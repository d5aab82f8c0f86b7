"""Quality rules over nested records: every breach with the indexed path of its field, in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = "array<struct<rule:string,severity:string,field_path:string,value:string>>"

# Words and patterns of the rules.
CORPORATE = ("INC", "LTD", "CORP", "LIMITED", "HOLDINGS", "INVESTMENTS", "ENTERPRISES", "LLC", "LP", "LLP")
STREET = (
    "STREET", "AVENUE", "ROAD", "DRIVE", "BOULEVARD", "CRESCENT", "COURT", "PLACE", "LANE", "CIRCLE", "TRAIL", "HIGHWAY", "WAY", "TERRACE",
    "PARKWAY", "CONCESSION", "DR", "ST", "AVE", "RD", "BLVD", "CRES", "CRT", "PL", "LN", "HWY",
)
NUMBERED = r"(?i)^\d{5,10}\s+(Ontario|Canada|Alberta|BC)\s+(Inc|Ltd|Corp|Limited)"
PHONE = r"(?:\(\d{3}\)\s*|\d{3}[-.\s])\d{3}[-.\s]\d{4}"
UNRESOLVED = ("no_arn", "arn_api_miss", "")
RECORD_RULES = {"company_in_address": "error", "phone_in_name": "error", "street_as_contact": "error", "address_in_party": "warning", "null_required": "error", "format_mismatch": "warning"}
PARCEL_RULES = {
    "gw_no_pin": "error", "gw_no_arn": "warning", "gw_no_address": "error", "gw_inactive_registry": "info", "gw_multiple_arns": "info",
    "gw_address_parse_failed": "warning", "gw_no_postal": "warning", "gw_parcel_unresolved": "error",
}


def _words(text: Column) -> Column:
    return F.split(F.upper(F.trim(text)), r"\s+")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(_words(text), F.array(*map(F.lit, words)))


def _numbered_start(text: Column) -> Column:
    return F.trim(text).rlike(r"^\d+\s")


def _issue(rule: str, path: Column, value: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit((RECORD_RULES | PARCEL_RULES)[rule]).alias("severity"), path.alias("field_path"), value.cast("string").alias("value"))


def _each(items: Column, rule: str, path: str, value, breaks) -> Column:
    """The issues of an array's items, with their place in the path."""
    found = F.transform(items, lambda x, i: F.when(breaks(value(x)), _issue(rule, F.format_string(path, i), value(x))))
    return F.coalesce(F.array_compact(found).cast(ISSUE), F.array().cast(ISSUE))


def company_in_address(line: Column) -> Column:
    return (F.char_length(F.trim(line)) > 3) & _has(line, CORPORATE) & ~_has(line, STREET) & ~_numbered_start(line)


def phone_in_name(name: Column) -> Column:
    """A phone with separators beside more than three other characters; numbered companies are none."""
    return name.rlike(PHONE) & ~F.trim(name).rlike(NUMBERED) & (F.char_length(F.trim(F.regexp_replace(name, PHONE, ""))) > 3)


def street_as_contact(name: Column) -> Column:
    return _numbered_start(name) & _has(name, STREET)


def address_in_party(name: Column) -> Column:
    return street_as_contact(name) & ~_has(name, CORPORATE)


def side_issues(side: Column, name: str) -> Column:
    """Issues of a STRUCT(address: STRUCT(lines, original_lines), parties: array<STRUCT(name)>, contacts: array<STRUCT(name)>)."""
    lines, original = side["address"]["lines"], side["address"]["original_lines"]
    lines = F.when(F.size(lines) > 0, lines).otherwise(original)
    named, itself = (lambda x: x["name"]), (lambda x: x)
    parties, contacts = side["parties"], side["contacts"]
    return F.concat(
        _each(lines, "company_in_address", f"{name}.address.lines[%d]", itself, company_in_address),
        _each(parties, "phone_in_name", f"{name}.parties[%d].name", named, phone_in_name),
        _each(contacts, "phone_in_name", f"{name}.contacts[%d].name", named, phone_in_name),
        _each(contacts, "street_as_contact", f"{name}.contacts[%d].name", named, street_as_contact),
        _each(parties, "address_in_party", f"{name}.parties[%d].name", named, address_in_party),
    )


def record_issues(records: DataFrame, key: str) -> DataFrame:
    """Rows (key, rule, severity, field_path, value) of records (key, seller, buyer, transaction: STRUCT(sale_price, sale_date))."""
    price, day = F.col("transaction.sale_price"), F.col("transaction.sale_date")
    dated = F.coalesce(day != "", F.lit(False))
    bare = ~F.coalesce(price != 0, F.lit(False)) & ~dated
    whole = F.array(
        F.when(bare, _issue("null_required", F.lit("transaction"), F.lit("no price or date"))),
        F.when(dated & ~day.rlike(r"^\d{4}-\d{2}-\d{2}$"), _issue("format_mismatch", F.lit("transaction.sale_date"), day)),
    )
    found = F.concat(side_issues(F.col("seller"), "seller"), side_issues(F.col("buyer"), "buyer"), F.array_compact(whole).cast(ISSUE))
    return records.select(key, F.explode(found).alias("i")).select(key, "i.*")


def parcel_issues(parcels: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Rows (key, rule, severity, field_path, value) of registry records and their links to parcels.

    parcels: (key, pin, assessments array, address STRUCT(street, postal_code), is_active, issues array<string>);
    links: (key, resolutions array<STRUCT(method)>). A resolution without a method counts as one.
    """
    rows = parcels.join(links.select(key, "resolutions"), key, "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    n = F.coalesce(F.greatest(F.size("assessments"), F.lit(0)), F.lit(0))
    address = F.col("address")
    failed = F.forall("resolutions", lambda r: F.coalesce(r["method"].isin(*UNRESOLVED), F.lit(False)))
    tests = {
        "gw_no_pin": blank(F.col("pin")),
        "gw_no_arn": n == 0,
        "gw_no_address": address.isNull() | blank(address["street"]),
        "gw_inactive_registry": ~F.coalesce("is_active", F.lit(True)),
        "gw_multiple_arns": n > 1,
        "gw_address_parse_failed": F.coalesce(F.array_contains("issues", "address_parse_failed"), F.lit(False)),
        "gw_no_postal": address.isNotNull() & blank(address["postal_code"]),
        "gw_parcel_unresolved": F.coalesce(failed, F.lit(True)),
    }
    found = F.array_compact(F.array(*(F.when(test, _issue(rule, F.lit("gw"), F.lit(None))) for rule, test in tests.items())))
    return rows.select(key, F.explode(found).alias("i")).select(key, "i.*")
