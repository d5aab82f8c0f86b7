"""Entity resolution: groups, contacts, properties, enrichment and identifier bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgraph.functions.text import fingerprint, group_name
from landgraph.operators.folds import fold_latest


def resolve_groups(mentions: DataFrame, name: str, seq: list[str], item: str, is_buyer: Column) -> DataFrame:
    """Per normalised name: first display name, mentions, distinct items bought, and raw variants."""
    order = F.struct(*seq)
    rows = mentions.withColumn("group_key", group_name(F.col(name))).filter("group_key <> ''")
    return rows.groupBy("group_key").agg(
        F.min_by(name, order).alias("display_name"),
        F.count(F.lit(1)).alias("n_mentions"),
        F.count_distinct(F.when(is_buyer, F.col(item))).alias("n_items"),
        F.min(name).alias("variant"),
        F.count_distinct(name).alias("n_variants"),
    )


def resolve_contacts(mentions: DataFrame, name: str, seq: list[str], date: str, fields: list[str]) -> DataFrame:
    """Contacts by fingerprint; later dates replace attributes, equal ones do not."""
    rows = mentions.withColumn("contact_key", fingerprint(F.col(name)))
    return fold_latest(rows, ["contact_key"], seq, date, fields, ties_win=False)


def enrich(base: DataFrame, more: DataFrame, key: str, overrides: list[str], tag: str, defaults: dict[str, Column]) -> DataFrame:
    """Full outer upsert: non-empty values of `more` override, rows only in `more` are created with defaults."""
    m = more.select(key, *(F.col(c).alias(f"__{c}") for c in overrides), F.lit(True).alias("__in"))
    both = base.withColumn("__had", F.lit(True)).join(m, key, "full")
    out = both.withColumns({c: F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c)) for c in overrides})
    created = F.col("__had").isNull()
    out = out.withColumns({c: F.when(created, v).otherwise(F.col(c)) for c, v in defaults.items()})
    return out.withColumn(tag, created).drop("__had", "__in", *(f"__{c}" for c in overrides))


def newer_sale(date: Column, price: Column, source: Column, other_date: Column, other_price: Column, tag: str) -> Column:
    """STRUCT(date, price, source): another source's sale replaces only if strictly newer; empty is older than all."""
    wins = F.coalesce(other_date, F.lit("")) > F.coalesce(date, F.lit(""))
    return F.when(wins, F.struct(other_date.alias("date"), other_price.alias("price"), F.lit(tag).alias("source"))).otherwise(F.struct(date.alias("date"), price.alias("price"), source.alias("source")))


def bridge(orphans: DataFrame, records: DataFrame, pin: str, number: str, order: list[str]) -> DataFrame:
    """Orphans with the first valid number known for their pin; one row of the right side per pin."""
    known = records.filter(F.col(number).isNotNull() & (F.col(number) != "")).groupBy(pin).agg(F.min_by(number, F.struct(*order)).alias("bridged"))
    return orphans.join(known, pin, "left")


def related(groups: DataFrame, block: list[str], key: str) -> DataFrame:
    """(a, b): each group of a block with the next one of its block, in order of the key: a chain through the block, not all its pairs."""
    following = F.lead(key).over(Window.partitionBy(*block).orderBy(key))
    return groups.select(F.col(key).alias("a"), following.alias("b")).filter("b is not null")


def parties_by_contacts(records: DataFrame, parties: str, contacts: str, unnamed: str = "Named Individual(s)") -> DataFrame:
    """A record's parties times its contacts; a party without contacts has one null contact; unnamed-only sides have none."""
    named = F.filter(parties, lambda p: p != unnamed)
    return records.withColumn("party", F.explode(named)).withColumn("contact", F.explode_outer(contacts))
