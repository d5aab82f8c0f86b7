"""Assessment records: addresses around a municipality's name, dates, areas, sizes and issue tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landgraph.functions.text import let
from landgraph.functions.values import ACRES_PER_HECTARE, SQFT_PER_ACRE, iso_date

# Short suffixes and directions of assessment addresses.
SHORT = {
    "ST": "Street", "AVE": "Avenue", "DR": "Drive", "RD": "Road", "BLVD": "Boulevard", "CRES": "Crescent", "CT": "Court", "CRT": "Court", "PL": "Place", "LN": "Lane", "CIR": "Circle", "HWY": "Highway", "PKWY": "Parkway",
    "TERR": "Terrace", "TR": "Trail", "TRL": "Trail", "WAY": "Way", "GATE": "Gate", "CR": "Crescent", "LINE": "Line", "CONC": "Concession", "RUE": "Rue",
}
TURNS = ("N", "S", "E", "W", "NORTH", "SOUTH", "EAST", "WEST")
SQM_PER_ACRE = 4046.86
CODE = r"([A-Z]\d[A-Z])\s?(\d[A-Z]\d)\s*$"


def street_title(x: Column) -> Column:
    """Title case; suffixes in full, directions in capitals."""
    table = F.create_map(*(F.lit(s) for p in SHORT.items() for s in p))
    word = lambda w: F.when(F.upper(w).isin(*TURNS), F.upper(w)).otherwise(F.coalesce(F.try_element_at(table, F.upper(w)), F.initcap(w)))
    return F.array_join(F.transform(F.filter(F.split(x, r"\s+"), lambda w: w != ""), word), " ")


def assessed_address(x: Column, municipality: Column) -> Column:
    """STRUCT(street, city, province, postal_code, display_street, display_city, geocode_string); null for no text.

    The last place where the municipality's name stands parts street and city.
    """

    def parted(raw: Column, postal: Column) -> Column:
        town = F.upper(F.trim(F.coalesce(municipality, F.lit(""))))
        rest = F.trim(F.regexp_replace(F.trim(F.regexp_replace(raw, CODE, "")), r"\s+ON\s*$", ""))

        def built(rest: Column) -> Column:
            # the text behind the last occurrence has no further one, so its length tells the place
            behind = F.length(F.call_function("substring_index", F.upper(rest), town, F.lit(-1)))
            at = F.length(rest) - behind - F.length(town)
            found = (town != "") & (at > 0) & F.contains(F.upper(rest), town)
            street = F.when(found, F.trim(F.substring(rest, F.lit(1), at))).otherwise(rest)
            city = F.when(found, F.substring(rest, at + 1, F.length(town))).otherwise(F.trim(F.coalesce(municipality, F.lit(""))))
            shown = lambda s, c: F.struct(
                street.alias("street"), city.alias("city"), F.lit("ON").alias("province"), postal.alias("postal_code"), s.alias("display_street"), c.alias("display_city"),
                F.when(s != "", F.regexp_replace(F.concat(s, F.lit(", "), c, F.lit(", Ontario "), postal, F.lit(", Canada")), "^[, ]+|[, ]+$", "")).alias("geocode_string"),
            )
            return let(street_title(street), lambda s: let(F.initcap(city), lambda c: shown(s, c)))

        return let(rest, built)

    code = lambda raw: F.when(raw.rlike(CODE), F.concat_ws(" ", F.regexp_extract(raw, CODE, 1), F.regexp_extract(raw, CODE, 2))).otherwise("")
    return F.when(F.coalesce(x, F.lit("")) != "", let(F.trim(x), lambda raw: parted(raw, code(raw))))


def summary_address(x: Column) -> Column:
    """The same parts of 'street, city, postal'."""

    def built(parts: Column) -> Column:
        part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
        shown = lambda s, c: F.struct(
            part(0).alias("street"), part(1).alias("city"), F.lit("ON").alias("province"), F.when(part(2).rlike(r"^[A-Z]\d[A-Z]"), part(2)).otherwise("").alias("postal_code"), s.alias("display_street"), c.alias("display_city"),
            F.when(part(0) != "", F.concat(s, F.lit(", "), c, F.lit(", Ontario, Canada"))).alias("geocode_string"),
        )
        return let(street_title(part(0)), lambda s: let(F.initcap(part(1)), lambda c: shown(s, c)))

    return F.when(F.coalesce(x, F.lit("")) != "", let(F.transform(F.split(x, ","), lambda p: F.trim(p)), built))


def sale_day(x: Column) -> Column:
    """'Oct 28, 2020', 'October 28, 2020' or ISO to ISO; other text passes."""
    return F.when(x != "", iso_date(F.trim(x), "MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd"))


def site_area(x: Column) -> Column:
    """STRUCT(value, unit, acres), rounded to 2, of '104963.55F', '500M', '50,806 ft²', '1.2 acres', '3 ha'; null otherwise."""
    shape = r"(?i)^([\d,.]+)\s*(?:(F|M)\s*$|(ft²|sq\s*ft)|(acres?|ac)|(m²)|(hectares?|ha))"
    n = F.replace(F.regexp_extract(x, shape, 1), F.lit(","), F.lit("")).try_cast("double")
    unit = F.lower(F.concat(*(F.regexp_extract(x, shape, i) for i in range(2, 7))))
    row = lambda u, a: F.struct(F.round(n, 2).alias("value"), F.lit(u).alias("unit"), F.round(a, 2).alias("acres"))
    found = F.when(unit.rlike("f"), row("sqft", n / SQFT_PER_ACRE)).when(unit.rlike("ac"), row("acres", n)).when(unit.rlike("m"), row("sqm", n / SQM_PER_ACRE)).when(unit.rlike("h"), row("hectares", n * round(ACRES_PER_HECTARE, 3)))
    return F.when(n.isNotNull(), found)


def dimension(x: Column) -> Column:
    """Feet of '237.84 ft', null without a number."""
    return F.replace(F.regexp_extract(F.trim(x), r"^([\d,.]+)", 1), F.lit(","), F.lit("")).try_cast("double")


def issue_tags(address: Column, pin: Column, n_assessments: Column) -> Column:
    """Names of what a normalised record lacks, in a fixed order."""
    none = address.isNull()
    tests = [("address_parse_failed", none), ("no_pin", F.coalesce(pin, F.lit("")) == ""), ("no_arn", F.coalesce(n_assessments, F.lit(0)) == 0), ("no_address", none), ("no_postal", ~none & (F.coalesce(address["postal_code"], F.lit("")) == ""))]
    return F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))
