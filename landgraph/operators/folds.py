"""Ordered folds: what loops with 'if newer then replace' compute, as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def record_setters(df: DataFrame, key: list[str], seq: list[str], date: str, ties_win: bool) -> DataFrame:
    """Adds `setter`: the row is its key's first, or has a date later than (or, if ties win, equal to) all before.

    An empty date is the smallest text, so it never beats a date; with strict comparison a
    row needs a date of its own.
    """
    before = Window.partitionBy(*key).orderBy(*seq).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(date).over(before)
    beats = F.col(date) >= best if ties_win else (F.col(date) != "") & (F.col(date) > best)
    return df.withColumn("setter", best.isNull() | beats)


def fold_latest(df: DataFrame, key: list[str], seq: list[str], date: str, fields: list[str], ties_win: bool) -> DataFrame:
    """Per key: count, first and last date, and each field's last non-empty value among record-setting rows."""
    rows = record_setters(df, key, seq, date, ties_win)
    order = F.struct(*seq)
    last = [F.coalesce(F.max_by(F.col(f), F.when(F.col("setter") & (F.col(f) != ""), order)), F.lit("")).alias(f) for f in fields]
    first_date = F.coalesce(F.min(F.when(F.col(date) != "", F.col(date))), F.lit("")).alias("first_date")
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), first_date, F.max(date).alias("last_date"), *last)


def best_per_key(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that must be total."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")


def latest_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """As best_per_key; rows without a key all stay."""
    return best_per_key(df.filter(F.col(key).isNotNull()), [key], *order).unionByName(df.filter(F.col(key).isNull()))


def duplicate_pointer(df: DataFrame, same: str, row: str, name: str = "dedup_of") -> DataFrame:
    """Points later rows of the same value at the first row; null for the first itself."""
    first = df.groupBy(same).agg(F.min(row).alias("__first"))
    return df.join(first, same).withColumn(name, F.when(F.col(row) != F.col("__first"), F.col("__first"))).drop("__first")


def islands(df: DataFrame, key: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows; a row where `breaks` holds, and a key's first, begins a run."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(w))


def sampled_counts(df: DataFrame, rank: Column, key: str, step: int, name: str) -> DataFrame:
    """Counts by key from every step-th record of a rank, scaled by the step."""
    rows = df.filter(F.pmod(rank, F.lit(step)) == 0)
    return rows.groupBy(key).agg((F.count(F.lit(1)) * step).alias(name))


def registered_ids(keys: DataFrame, registry: DataFrame, key: str, first: str, fmt: str) -> DataFrame:
    """(key, n, id): ids already given stay, new keys get the next numbers in order of first sight."""
    top = registry.agg(F.coalesce(F.max("n"), F.lit(0)).alias("__top"))
    fresh = keys.join(registry.select(key), key, "left_anti")
    from landgraph.operators.relational import ranked_ids

    fresh = ranked_ids(fresh, [F.col(first), F.col(key)], "%d", "__n").join(F.broadcast(top))
    fresh = fresh.select(key, (F.col("__n").cast("long") + F.col("__top")).alias("n"))
    out = registry.select(key, "n").unionByName(fresh)
    return out.withColumn("id", F.format_string(fmt, "n"))
