"""Hand-written cases: what a line is, beside what it must become; the queries take the lines, the SQL the answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from landgraph.session import spread

#: line, label, kind
LABELS = (
    ("", "empty", None), ("K1A 0B1", "postal", None), ("90210", "postal", None), ("SW1A 1AA", "postal", None), ("*M5V2T6*", "postal", None), ("L4B 4W", "other", None), ("Ontario", "city_province", None),
    ("416-555-0100 x2", "phone", None), ("Tel: 416-555-0100", "phone", None), ("USA 90210", "country", None), ("Germany", "country", None), ("D-80333 Munich", "address_line", None),
    ("in trust for Mary", "company_name", None), ("P O Box 5", "address_line", None), ("Near PO Box 5", "address_line", None), ("RR 4", "address_line", None), ("Site 5, RR 2", "address_line", None),
    ("General Delivery", "address_line", None), ("12 Main St", "address_line", None), ("12 Anything", "address_line", None), ("One King St W", "address_line", None), ("Suite 400", "address_modifier", None),
    ("Second Floor", "address_modifier", None), ("Station A", "address_modifier", None), ("Toronto, Ontario", "city_province", None), ("Toronto, Ontario M5V 2T6", "city_province", None),
    ("Denver, CO 80202", "city_province", None), ("Vancouver, B. C.", "city_province", None), ("Vancouver, B.C.", "law_firm", None), ("Acme Co., Ontario", "company_name", None), ("Toronto ON", "city_province", None), ("Larry Smith CA", "contact_name", None),
    ("Smith, Q.C.", "law_firm", None), ("Acme Inc.", "company_name", None), ("Acme LLP Inc.", "law_firm", None), ("Smith Barristers", "law_firm", None), ("Levy Zavet PC", "law_firm", None), ("Royal Tower", "building_name", None),
    ("King Court", "building_name", None), ("Acme Realty", "company_name", None), ("Family Trust", "company_name", None), ("City of Guelph", "company_name", None), ("Via Roma 12", "address_line", None), ("TD", "company_name", None),
    ("Mr & Mrs Smith", "contact_name", None), ("Mary & John Smith", "contact_name", None), ("Smith & Jones", "law_firm", None), ("Mary Smith", "contact_name", None), ("Blue Heron", "company_name", None),
    ("The Oaks", "building_name", None), ("Fake Elm Way", "address_line", None), ("Somebody Nameless", "contact_name", None), ("$%^", "other", None), ("Attn: Mary Smith", "contact_name", "attn"),
    ("Pres: Acme Ltd", "company_name", None), ("Attn John Smith", "contact_name", "attn"), ("Attn: Legal Department", "company_name", None), ("Sec: Jones Barristers", "law_firm", None), ("c/o Acme Ltd", "care_of", "company"),
    ("c/o 12 Main St", "care_of", "address"), ("c/o Mary Smith", "care_of", "person"), ("c/o Smith Barristers", "care_of", "law_firm"),
    ("Hoist Catering", "company_name", None), ("Sunny Winery", "company_name", None), ("Jones Welding", "company_name", None), ("Special Accounts", "company_name", None), ("Audi Oakville", "company_name", None),
)
#: line, number, name, suffix, direction, unit, type, display
ADDRESSES = (
    ("12 Main St", "12", "Main", "Street", "", "", "street_address", "12 Main Street"),
    ("#3 - 12 Main St W", "12", "Main", "Street", "West", "# 3", "street_address", "12 Main Street West, #3"),
    ("5-120 King St. E.", "120", "King", "Street", "East", "Unit 5", "street_address", "120 King Street East, Unit 5"),
    ("100 - 120 King St", "100-120", "King", "Street", "", "", "street_address", "100-120 King Street"),
    ("69-71 SELBY RD", "69-71", "Selby", "Road", "", "", "street_address", "69-71 Selby Road"),
    ("1 The West Mall", "1", "The West Mall", "", "", "", "street_address", "1 The West Mall"),
    ("7 St. George St", "7", "St. George", "Street", "", "", "street_address", "7 St. George Street"),
    ("14 County Road 9", "14", "County Road 9", "", "", "", "street_address", "14 County Road 9"),
    ("Suite 200 45 King St W", "45", "King", "Street", "West", "Suite 200", "street_address", "45 King Street West, Suite 200"),
    ("45 King St W, Suite 200", "45", "King", "Street", "West", "Suite 200", "street_address", "45 King Street West, Suite 200"),
    ("59 McGregor Drive Unit 5", "59", "McGregor", "Drive", "", "Unit 5", "street_address", "59 McGregor Drive, Unit 5"),
    ("45 King St, #301", "45", "King", "Street", "", "# 301", "street_address", "45 King Street, #301"),
    ("2441 Yonge St, 2nd Floor", "2441", "Yonge", "Street", "", "Floor 2nd Floor", "street_address", "2441 Yonge Street, Floor 2nd Floor"),
    ("2441 YONGE ST, SECOND FLOOR", "2441", "Yonge", "Street", "", "Floor Second Floor", "street_address", "2441 Yonge Street, Floor Second Floor"),
    ("465448 Curries Rd, RR 4", "465448", "Curries", "Road", "", "RR 4", "street_address", "465448 Curries Road, RR 4"),
    ("B7-77 Billy Bishop Way", "77", "Billy Bishop", "Way", "", "Unit B7", "street_address", "77 Billy Bishop Way, Unit B7"),
    ("One Mount Pleasant Rd", "1", "Mount Pleasant", "Road", "", "", "street_address", "1 Mount Pleasant Road"),
    ("399 1/2 King St", "399 1/2", "King", "Street", "", "", "street_address", "399 1/2 King Street"),
    ("1255A+B Bay St", "1255A+B", "Bay", "Street", "", "", "street_address", "1255A+B Bay Street"),
    ("620A Main St", "620A", "Main", "Street", "", "", "street_address", "620A Main Street"),
    ("4, 14, 34 & 44 Main St", "4,14,34,44", "Main", "Street", "", "", "street_address", "4,14,34,44 Main Street"),
    ("245/251 Main St", "245/251", "Main", "Street", "", "", "street_address", "245/251 Main Street"),
    ("67-45th Ave", "67", "45th", "Avenue", "", "", "street_address", "67 45th Avenue"),
    ("Perth Rd 147", "", "Perth Road 147", "", "", "", "street_name_only", "Perth Road 147"),
    ("1200 rue Sherbrooke", "1200", "Sherbrooke", "Rue", "", "", "street_address", "1200 Sherbrooke Rue"),
    ("40 KENT STREET WEST SQ MALL", "40", "Kent", "Street", "West", "", "street_address", "40 Kent Street West"),
    ("LOCATED AT 6301 Silver Dart Dr", "6301", "Silver Dart", "Drive", "", "", "street_address", "6301 Silver Dart Drive"),
    ("123 Highway #7", "123", "Highway 7", "", "", "", "street_address", "123 Highway 7"),
    ("10 Queen's Quay W", "10", "Queens", "Quay", "West", "", "street_address", "10 Queens Quay West"),
    ("100 King St N-W", "100", "King", "Street", "Northwest", "", "street_address", "100 King Street Northwest"),
    ("59 Camelot Drive", "59", "Camelot", "Drive", "", "", "street_address", "59 Camelot Drive"),
    ("Hazeldean Road", "", "Hazeldean", "Road", "", "", "street_name_only", "Hazeldean Road"),
    ("42", "", "42", "", "", "", "street_name_only", "42"), ("", "", "", "", "", "", "unknown", ""),
    ("PO Box 12", "", "", "", "", "PO Box 12", "po_box", "PO Box 12"), ("P.O. Box 123", "", "", "", "", "PO Box 123", "po_box", "PO Box 123"), ("R.R. #3", "", "", "", "", "RR 3", "rural_route", "RR 3"),
    ("General Delivery", "", "", "", "", "General Delivery", "general_delivery", "General Delivery"), ("LOTS 6, 8, 14-18", "", "Lots 6, 8, 14-18", "", "", "", "legal_description", "Lots 6, 8, 14-18"),
    ("PLAN 33M-666", "", "Plan 33m-666", "", "", "", "legal_description", "Plan 33m-666"), ("CONC 9", "", "Conc 9", "", "", "", "legal_description", "Conc 9"), ("21, 43 & 44", "", "21, 43 & 44", "", "", "", "lot_continuation", "21, 43 & 44"),
)
#: header line, type
HEADER_LINES = (
    ("69 - 71 SELBY RD", "range_address"), ("10 & 20 WOODSLEE AVE", "range_address"), ("12 MAIN ST", "numbered_address"), ("UNIT 4", "unit_suite"), ("SUITE 200", "unit_suite"), ("PT LOT 3", "legal_description"), ("PLAN 5", "legal_description"),
    ("HIGHWAY 7", "highway"), ("COUNTY RD 9", "highway"), ("(north side)", "location_qualifier"), ("HAZELDEAN RD", "street_name"), ("DOWNTOWN", "name_only"),
)
#: street, city, province, postal, country, geocoding text
GEOCODES = (
    ("66 Wellington Street West", "Toronto", "ON", "m5k1a1", "", "66 Wellington Street West, Toronto, Ontario M5K 1A1, Canada"), ("1 Main Street", "Buffalo", "ny", "14201", "", "1 Main Street, Buffalo, New York 14201, United States"),
    ("2 High Street", "London", "", "", "uk", "2 High Street, London, United Kingdom"), ("", "Toronto", "ON", "", "", None), ("3 Elm Street", "", "Ontrio", "", "", "3 Elm Street, Ontario, Canada"),
)


def literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"


def values(rows) -> str:
    """Rows as SQL, numbered from 0."""
    return ", ".join("(" + ", ".join(literal(v) for v in (i, *row)) + ")" for i, row in enumerate(rows))


def dealt(spark, d, name: str, key: str, *columns: list):
    """Every row of a table with one case each, by its key; the cases are a fixed list."""
    names = [f"c{i}" for i in range(len(columns))]
    rows = list(zip(range(len(columns[0])), *columns, strict=True))
    dim = spark.createDataFrame(rows, ", ".join(["case int", *(f"{n} string" for n in names)]))
    return spread(spark, d, name).select(key, (F.col(key) % len(rows)).cast("int").alias("case")).join(F.broadcast(dim), "case").drop("case")
