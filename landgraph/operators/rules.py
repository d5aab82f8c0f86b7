"""Data-quality rules: one issues table, lifecycle and root causes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(df: DataFrame, key: str, rules: list[tuple[str, str, str, Column, Column]]) -> DataFrame:
    """(key, rule, severity, field, value) for every rule (name, severity, field, test, value) a row breaks, in one scan."""
    found = [F.when(test, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.lit(f).alias("field"), value.cast("string").alias("value"))) for n, s, f, test, value in rules]
    return df.select(key, F.explode(F.array_compact(F.array(*found))).alias("i")).select(key, "i.*")


def rescan(old: DataFrame, found: DataFrame, in_scope: Column) -> DataFrame:
    """Replaces the open issues in scope by those found; closed ones and others stay."""
    stays = old.filter(~((F.col("status") == "open") & in_scope))
    return stays.unionByName(found.filter(in_scope).withColumn("status", F.lit("open")))


def rule_counts(catalogue: DataFrame, found: DataFrame) -> DataFrame:
    """Every rule with its number of issues, also 0."""
    n = found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return catalogue.join(n, "rule", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def root_cause(value: Column, stages: list[tuple[str, Column]]) -> Column:
    """The first stage, walking back from the last, whose text lacks the value: there it came in."""
    return reduce(lambda later, s: F.when(F.coalesce(F.contains(s[1], value), F.lit(False)), later).otherwise(s[0]), stages, F.lit("source"))


def drift(now: Column, before: Column, percent: float = 10.0) -> Column:
    return F.coalesce(F.abs(now - before) * 100.0 / F.nullif(before, F.lit(0)) > percent, now != before)
