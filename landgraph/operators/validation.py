"""The summary that precedes a build: are the stages' tables whole, resolved, cached and near the last build's size?"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _tallies(records: DataFrame, cache: DataFrame, built: DataFrame | None, others: Mapping[str, DataFrame]) -> DataFrame:
    """Rows (name, n): each table is read once for its counts; records are counted per number and per id before they meet anything."""
    numbers = records.filter(_filled("resolved")).groupBy("resolved").agg(F.count(F.lit(1)).alias("n"))
    held = cache.filter(_filled("number")).select(F.col("number").alias("resolved")).distinct().withColumn("held", F.lit(True))
    numbers = numbers.join(held, "resolved", "left").agg(F.sum("n").alias("resolved"), F.sum(F.when(F.col("held"), F.col("n"))).alias("cached"))
    ids = records.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    ids = ids.agg(F.sum("n").alias("records"), F.sum(F.when(~_filled("source_id"), F.col("n"))).alias("missing"), F.sum(F.when(_filled("source_id"), F.col("n") - 1)).alias("repeated"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = [numbers, ids, *(one(t, f"of:{name}") for name, t in others.items()), *([one(built, "built")] if built is not None else [])]
    out = None
    for df in counts:
        rows = df.select(F.explode(F.create_map(*(x for c in df.columns for x in (F.lit(c), F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long"))))).alias("name", "n"))
        out = rows if out is None else out.union(rows)
    return out


def validation_summary(records: DataFrame, cache: DataFrame, built: DataFrame | None, others: Mapping[str, DataFrame], *, needed: Collection[str] = (), percent: float = 10.0) -> DataFrame:
    """Rows (check, level, n, of, percent, flagged), one per check, and a last one `passed`, flagged where an issue is.

    records (source_id, resolved) are all records, not a sample; cache (number) holds the parcels fetched before;
    built is the last build's table of records (None: the first build, which has no drift); others are the tables
    of the other sources, of which those in `needed` warn when they are empty. A check's level says what
    it is when flagged; checks that only inform are never flagged. percent is null where its base is 0.
    Empty and null ids are missing, and no repeats of each other.
    """
    tally = _tallies(records, cache, built, others).agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("t"))  # a row per count, few and fixed
    n = lambda name: F.col("t")[name]
    share = lambda a, b: F.when(b > 0, a * 100.0 / b)
    none, zero, no = F.lit(None).cast("long"), F.lit(0), F.lit(False)
    records_, resolved, cached = n("records"), n("resolved"), n("cached")
    checks = [
        ("no_records", "issue", records_, none, records_ == 0),
        ("missing_source_id", "issue", n("missing"), records_, n("missing") > 0),
        ("repeated_source_id", "issue", n("repeated"), records_, n("repeated") > 0),
        ("resolved", "info", resolved, records_, no),
        ("resolved_in_cache", "info", cached, resolved, no),
        ("resolved_not_in_cache", "warning", resolved - cached, resolved, resolved > cached),
    ]
    if built is not None:
        away = F.abs(records_ - n("built"))
        checks.append(("drift", "warning", away, n("built"), (records_ > 0) & (n("built") > 0) & (away * 100.0 / F.nullif(n("built"), zero) > percent)))
    for name in others:
        checks.append((f"count_{name}", "warning" if name in needed else "info", n(f"of:{name}"), none, (n(f"of:{name}") == 0) if name in needed else no))
    rows = [F.struct(F.lit(c).alias("check"), F.lit(level).alias("level"), a.alias("n"), of.alias("of"), share(a, of).alias("percent"), F.coalesce(hit, no).alias("flagged")) for c, level, a, of, hit in checks]
    tally = tally.select(F.array(*rows).alias("rows"))
    issues = F.size(F.filter("rows", lambda r: (r["level"] == "issue") & r["flagged"])).cast("long")
    last = F.struct(F.lit("passed").alias("check"), F.lit("issue").alias("level"), issues.alias("n"), none.alias("of"), F.lit(None).cast("double").alias("percent"), (issues > 0).alias("flagged"))
    return tally.select(F.explode(F.concat("rows", F.array(last))).alias("r")).select("r.*")
