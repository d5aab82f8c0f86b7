"""Incremental ingestion: file streams that run the batch transforms, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """Parquet files as they land; the checkpoint remembers which were seen."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Feeds all that is there to `each` in micro-batches and returns."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Share(NamedTuple):
    """What a share of the table consists of: the batch that wrote its base, the batches of its deltas, and their rows."""

    base: int = -1
    base_rows: int = 0
    deltas: tuple[int, ...] = ()
    delta_rows: int = 0


def upsert_latest(path: str, key: str, *order: Column, shares: int = 16, compact_at: float = 0.5) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each key's first row in an order, across batches.

    The table lies in shares by the key's hash, each a base and deltas over it. A batch writes its own
    rows as a delta; a share is written anew only when its deltas have grown beyond `compact_at` of its
    base, so what is written grows with the batches and not with the table. A small index of each
    batch says what the shares consist of. Files that neither the last index nor the one before names
    are deleted. A repeated batch does the same again. read_latest() reads the table.
    """
    from landgraph.operators.folds import best_per_key

    def rows_by_share(spark: SparkSession, folder: str) -> dict[int, int]:
        return {r.share: r.n for r in spark.read.parquet(folder).groupBy("share").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `shares`

    def write(batch: DataFrame, number: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        before = _shares(spark, path, number)
        now = dict(before)
        dealt = best_per_key(batch, [key], *order).withColumn("share", F.pmod(F.xxhash64(key), F.lit(shares)).cast("int"))
        dealt.write.mode("overwrite").partitionBy("share").parquet(f"{path}/delta={number}")
        for s, n in ({} if batch.isEmpty() else rows_by_share(spark, f"{path}/delta={number}")).items():
            old = now.get(s, Share())
            now[s] = old._replace(deltas=(*old.deltas, number), delta_rows=old.delta_rows + n)
        due = {s: x for s, x in now.items() if x.delta_rows > compact_at * x.base_rows}
        if due:
            whole = best_per_key(_rows(spark, path, schema, due), [key], *order)
            whole.write.mode("overwrite").partitionBy("share").parquet(f"{path}/base={number}")
            now |= {s: Share(number, n) for s, n in rows_by_share(spark, f"{path}/base={number}").items()}
        index = spark.createDataFrame([(s, *x[:2], list(x.deltas), x.delta_rows) for s, x in sorted(now.items())], "share int, base long, base_rows long, deltas array<long>, delta_rows long")
        index.coalesce(1).write.mode("overwrite").parquet(f"{path}_index/{number:012d}")
        _clear(spark, path, number, before, now)

    return write


def _files(shares: dict[int, Share]) -> set[str]:
    return {f"base={x.base}" for x in shares.values() if x.base >= 0} | {f"delta={d}" for x in shares.values() for d in x.deltas}


def _clear(spark: SparkSession, path: str, number: int, before: dict[int, Share], now: dict[int, Share]) -> None:
    """Deletes what two indexes no longer name, and the indexes before them."""
    kept = _files(before) | _files(now)
    indexes = _listed(spark, f"{path}_index/*")
    for folder in _listed(spark, f"{path}/*"):
        name = folder.rsplit("/", 1)[1]
        if "=" in name and name not in kept and int(name.split("=")[1]) <= number:
            _delete(spark, folder)
    for folder in sorted(f for f in indexes if int(f.rsplit("/", 1)[1]) < number)[:-1]:
        _delete(spark, folder)


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [str(f.getPath()) for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _shares(spark: SparkSession, path: str, below: int = 10**12) -> dict[int, Share]:
    """The last index of a batch below a number; numbers may be left out, so the folders tell which is last."""
    names = sorted(f.rsplit("/", 1)[0] for f in _listed(spark, f"{path}_index/*/_SUCCESS"))
    names = [n for n in names if int(n.rsplit("/", 1)[1]) < below]
    return {r.share: Share(r.base, r.base_rows, tuple(r.deltas), r.delta_rows) for r in spark.read.parquet(names[-1]).collect()} if names else {}


def _rows(spark: SparkSession, path: str, schema: StructType | str, shares: dict[int, Share]) -> DataFrame:
    """Bases and deltas of some shares, with the share: several rows a key."""
    files = sorted(f"{path}/{kind}={v}/share={s}" for s, x in shares.items() for kind, v in [("base", x.base)] * (x.base >= 0) + [("delta", d) for d in x.deltas])
    if not files:
        return spark.createDataFrame([], schema).withColumn("share", F.lit(0))
    rows = spark.read.schema(schema).parquet(*files)
    return rows.withColumn("share", F.regexp_extract(F.col("_metadata.file_path"), r"/share=(\d+)/[^/]*$", 1).cast("int"))


def read_latest(spark: SparkSession, path: str, schema: StructType | str, key: str, *order: Column) -> DataFrame:
    """The table that upsert_latest() keeps with the same key and order, empty before the first batch."""
    from landgraph.operators.folds import best_per_key

    return best_per_key(_rows(spark, path, schema, _shares(spark, path)), [key], *order).drop("share")


def hourly(events: DataFrame, ts: str, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and sums in tumbling windows; works on a stream (with its watermark) and on a table."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if rows.isStreaming else rows
    grouped = rows.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("starts"), "event_type", "n", "total")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, gap) if rows.isStreaming else rows
    grouped = rows.groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(user, F.col("s.start").alias("starts"), "n")
