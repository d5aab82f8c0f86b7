"""Browse, page, merge and tally helpers on DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows that meet every condition given; None is no condition."""
    given = [c for c in conditions if c is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def sort_key(allowed: dict[str, Column], name: str, order: str, default: str) -> Column:
    """An allow-listed sort column; unknown names and orders fall back."""
    key = allowed.get(name, allowed[default])
    return key.asc_nulls_first() if order == "asc" else key.desc_nulls_last()


def page(df: DataFrame, *order: Column, number: int = 1, size: int = 20) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent non-empty values."""
    kept = df.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    return kept.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)


def tallies(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by each key on its own, in one pass: (dimension, value, n), null as 'unknown'."""
    text = [F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias(k) for k in keys]
    sets = df.select(*text).groupingSets([[k] for k in keys], *keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    masks = {k: (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i)) for i, k in enumerate(keys)}
    dimension = reduce(lambda later, k: F.when(F.col("g") == masks[k], k).otherwise(later), keys, F.lit(None))
    return sets.select(dimension.alias("dimension"), F.coalesce(*keys).alias("value"), "n")


def pending(status: Column, retry: Column) -> Column:
    """Records without a status, and failed ones to be tried again."""
    return status.isNull() | ((status == "failed") & retry)


def share_of_largest(counts: DataFrame, n: str = "n") -> DataFrame:
    """n / max(n): the largest comes from a one-row aggregate, not from a window over all rows."""
    most = counts.agg(F.max(n).alias("__most"))
    return counts.join(F.broadcast(most)).withColumn("share", F.col(n) / F.col("__most")).drop("__most")


def merge_top(n: int, *branches: DataFrame, order: list[Column]) -> DataFrame:
    """The first n of several sorted branches; each is cut before the union."""
    cut = [b.orderBy(*order).limit(n) for b in branches]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cut).orderBy(*order).limit(n)


def dated(*branches: tuple[str, DataFrame]) -> DataFrame:
    """Union of sources, each tagged by its name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source", F.lit(name)) for name, df in branches])


def nested(parent: DataFrame, child: DataFrame, key: str, fields: list[str], order: list[str], name: str) -> DataFrame:
    """Parents with their children as an ordered array of structs, by one join."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("__row")))), lambda x: x["__row"])
    return parent.join(child.groupBy(key).agg(packed.alias(name)), key, "left")


def pipeline_stages(stages: list[str], rows: DataFrame, stage: str, amount: str, closed: list[str]) -> DataFrame:
    """Per stage, also an empty one, in the given order: count, amount and whether it is active."""
    dim = rows.sparkSession.createDataFrame([(i, s, s not in closed) for i, s in enumerate(stages)], "place int, stage string, active boolean")
    sums = rows.groupBy(F.col(stage).alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col(amount), F.lit(0))).alias("amount"))
    return dim.join(sums, "stage", "left").select("place", "stage", "active", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("amount", F.lit(0)).alias("amount"))


def ranked_ids(df: DataFrame, order: list[Column], fmt: str, name: str) -> DataFrame:
    """Dense ids by sort order, without a single-task window: range partitions, then offsets per partition.

    The ranges are written once to the shared folder, so both readings see the same ones, and
    each is numbered in place.
    """
    from landgraph.sources.files import checkpointed

    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # partition in the upper bits, row from 0 in the lower 33
    inside = checkpointed(ordered.withColumns({"__part": F.shiftright(place, 33), "__at": place.bitwiseAND(F.lit((1 << 33) - 1)) + 1}))
    sizes = inside.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return inside.join(F.broadcast(offsets), "__part").withColumn(name, F.format_string(fmt, F.col("__at") + F.col("__before"))).drop("__part", "__at", "__before")


def left_join_named(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """A left join of rows whose key is often null: those go beside the join with nulls, as in it they would all be one task's.

    The dimension grows with the rows, so it is shuffled and not broadcast.
    """
    met = rows.filter(F.col(key).isNotNull()).join(dim.hint("merge"), key, "left")
    return met.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)
