"""Scratch tables, vector sums and connected components shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; only where none is named, as in local tests, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="landgraph-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Tables written to the shared folder so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """A saved table in buckets of `key`: joins and groupings on it shuffle nothing of this side.

        The rows should be partitioned by `key` already, so that each task writes its own buckets.
        """
        table = f"{self.root.rsplit('/', 1)[1].replace('-', '_')}_{name}"
        buckets = shuffle_partitions(self.spark)
        df.write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", self.path(name)).bucketBy(buckets, key).saveAsTable(table)
        return self.spark.table(table)

    def drop_bucketed(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.root.rsplit('/', 1)[1].replace('-', '_')}_{name}")
        self.drop(name)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def sum_vectors(df: DataFrame, width: int, dtype: str) -> np.ndarray:
    """Sums rows (part int, data binary) into one vector of `width`.

    Each part is a slice of the vector. A part's rows stream through one task, which holds
    a single slice, and what reaches the driver is the vector itself: `width` is a model
    parameter and does not grow with the data.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(data.as_buffer(), dtype=dtype)
                held[part] = held[part] + v if part in held else v.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["part", "data"]
        )

    n = shuffle_partitions(df.sparkSession)
    for parts in (max(1, n), 0):  # salted partial sums first, then one task for each slice
        if parts:
            df = df.withColumn("salt", (F.rand(7) * 8).cast("int")).repartition(parts, "part", "salt").drop("salt")
        else:
            df = df.repartition(max(1, n), "part")
        df = df.mapInArrow(fold, "part int, data binary")
    rows = sorted((r.part, bytes(r.data)) for r in df.collect())
    out = np.concatenate([np.frombuffer(d, dtype=dtype) for _, d in rows]) if rows else np.zeros(0, dtype)
    return out if len(out) == width else np.zeros(width, dtype)


def slices(vector: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows (part, data) of a vector, for sum_vectors."""
    return pa.RecordBatch.from_arrays(
        [pa.array(range(parts), pa.int32()), pa.array([v.tobytes() for v in np.split(vector, parts)], pa.binary())], ["part", "data"]
    )


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Connected components of rows (a, b): one row (id, component) per vertex, component being its smallest id.

    Labels go to the smallest label of the neighbours, then jump to their label's label, so
    chains halve each round. All steps are joins and partial aggregates; nothing is collected.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.save(both.filter("a <> b").distinct(), f"{name}_edges")
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), f"{name}_l0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        moved = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        moved = moved.join(jump, "label").select("id", "was", F.least("label", "far").alias("label"))
        moved = scratch.save(moved, f"{name}_l{step}")
        scratch.drop(f"{name}_l{step - 1}")
        labels = moved.select("id", "label")
        if moved.filter("label <> was").isEmpty():
            scratch.drop(f"{name}_edges")
            return labels.withColumnRenamed("label", "component")
