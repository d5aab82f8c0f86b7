"""Names, phones and plain text as Column -> Column functions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes, in the order in which they are stripped, once each.
LEGAL_SUFFIXES = ("INCORPORATED", "CORPORATION", "LIMITED PARTNERSHIP", "LIMITED", "COMPANY", "INC.", "INC", "LTD.", "LTD", "CORP.", "CORP", "CO.", "LLP", "LP")
PHONE = r"(?:\+?1[-. ])?\(?([2-9][0-9]{2})\)?[-. ]([0-9]{3})[-. ]([0-9]{4})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(x: Column) -> Column:
    """split(x, \\s+); a split at one character compiles no pattern, which one at a pattern does for each row."""
    return F.split(F.regexp_replace(x, r"\s+", " "), " ")


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def fingerprint(name: Column) -> Column:
    """A contact's identity: upper case, single spaces."""
    return F.upper(squeezed(name))


def group_name(name: Column) -> Column:
    """A group's identity: one ordered pass over the legal suffixes."""
    step = lambda x, s: F.trim(F.regexp_replace(x, " " + s.replace(".", r"\.") + "$", ""))
    return reduce(step, LEGAL_SUFFIXES, fingerprint(name))


def brand_key(name: Column) -> Column:
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")


def comparable(x: Column) -> Column:
    """Upper case with commas, dollars, dots and spaces as one space."""
    return F.trim(F.regexp_replace(F.upper(x), r"[,$.\s]+", " "))


def first_name(name: Column) -> Column:
    return F.split(F.trim(name), r"\s+")[0]


def other_names(name: Column) -> Column:
    parts = F.split(F.trim(name), r"\s+")
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " ")


def comma_spaced(x: Column) -> Column:
    return F.regexp_replace(x, r",(?!\s)", ", ")


def phone_of(x: Column) -> Column:
    """The first phone number as NNN-NNN-NNNN, or ''."""
    part = lambda i: F.regexp_extract(x, PHONE, i)
    return F.when(part(1) == "", "").otherwise(F.concat_ws("-", part(1), part(2), part(3)))


def title_case(x: Column, keep: tuple[str, ...] = ("PO", "RR", "NE", "NW", "SE", "SW")) -> Column:
    """Words of one case get an initial capital; mixed-case words and those in `keep` stay."""
    one = lambda w: F.when(F.upper(w).isin(*keep), F.upper(w)).when((w == F.upper(w)) | (w == F.lower(w)), F.initcap(w)).otherwise(w)
    return F.array_join(F.transform(F.split(x, " "), one), " ")


def contains_word(x: Column, words: tuple[str, ...]) -> Column:
    """Whether a word of x is in the list, any case."""
    return F.exists(F.split(F.regexp_replace(F.upper(x), r"[^A-Z0-9]+", " "), " "), lambda w: w.isin(*(v.upper() for v in words)))


def contains_any(x: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands anywhere in x, case counting."""
    return x.rlike("|".join(map(re.escape, words)))


def tags(x: Column, rules: dict[str, str]) -> Column:
    """Names of the rules (name -> pattern) that x meets."""
    return F.array_compact(F.array(*(F.when(x.rlike(p), F.lit(n)) for n, p in rules.items())))


def currency(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, 0))


def compact_money(x: Column) -> Column:
    """$1.2M, $340K, $12."""
    return (
        F.when(x >= 1_000_000, F.concat(F.lit("$"), F.format_string("%.1f", x / 1_000_000), F.lit("M")))
        .when(x >= 1_000, F.concat(F.lit("$"), F.format_string("%.0f", F.floor(x / 1_000).cast("double")), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), F.format_string("%.0f", F.floor(x).cast("double"))))
    )
