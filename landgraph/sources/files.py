"""Sources and sinks: raw files, JSON stages, brand tables, and checkpointed intermediate tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; where none is named, as in local tests, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="landgraph-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows behind a reliable checkpoint, in the folder that the session names, else in one of our own."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def raw_documents(spark: SparkSession, root: str, glob: str = "*.html") -> DataFrame:
    """Whole files with path parts: .../region/type/page/position.ext."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    path = F.col("_metadata.file_path")
    part = lambda i: F.element_at(F.split(path, "/"), -i)
    return rows.select(path.alias("path"), "value", part(4).alias("region"), part(3).alias("kind"), part(2).alias("page"), F.regexp_extract(part(1), r"(\d+)", 1).alias("position")).filter("page like 'p%'")


def export_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of the JSON array that each file holds: folder, position in the array, and the fields, absent text as ''."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    rows = rows.select(folder.alias("folder"), F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("position", "r")).select("folder", "position", "r.*")
    return rows.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" and c != "folder" else F.col(c) for c, t in rows.dtypes))


def at_position(items: Column, i: Column) -> Column:
    """An array's element by index from 0, null outside."""
    return F.get(items, i)


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Names and sizes of a stage's files, without reading them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return rows.select("path", F.substring_index("path", "/", -1).alias("name"), "length", "modificationTime")


def cached_parcels(records: DataFrame, parcels: DataFrame, key: str) -> DataFrame:
    """Records with their parcel from a key-value table, or null; `cached` tells whether there is one."""
    known = parcels.dropDuplicates([key]).withColumn("cached", F.lit(True))
    return records.join(known, key, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def stage_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records of a stage; broken ones keep their text in _corrupt_record. Files named _* are skipped by Spark."""
    return spark.read.schema(schema + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_stage(df: DataFrame, path: str, *partitions: str) -> None:
    """A stage's table; Spark's commit protocol keeps readers from seeing half of it."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def new_files(listing: DataFrame, done: DataFrame, name: str, prefix: str, suffix: str) -> DataFrame:
    """Files of the wanted names that were not ingested yet."""
    wanted = listing.filter(F.col(name).startswith(prefix) & F.col(name).endswith(suffix))
    return wanted.join(done.select(name), name, "left_anti")


def brand_table(spark: SparkSession, path: str) -> DataFrame:
    """Brands with one row for each alias, keyed by normalised name."""
    from landgraph.functions.text import brand_key

    rows = spark.read.option("header", True).csv(path)
    names = F.array_distinct(F.concat(F.array("Brand Name"), F.split(F.coalesce(F.col("Aliases"), F.lit("")), r"\s*\|\s*")))
    rows = rows.withColumn("alias", F.explode(F.filter(names, lambda n: n != "")))
    return rows.select(brand_key(F.col("alias")).alias("brand_key"), F.col("Brand Name").alias("brand"), F.col("Category").alias("category")).dropDuplicates(["brand_key"])


def reject_reason(pid: Column, brand: Column, lat: Column, lng: Column) -> Column:
    """Why a point of interest is refused, or null."""
    return (
        F.when(~F.coalesce(pid, F.lit("")).rlike("^(node|way|relation)/"), "bad_id")
        .when(F.coalesce(F.trim(brand), F.lit("")) == "", "no_brand")
        .when(lat.isNull() | lng.isNull(), "no_coords")
        .when(~lat.between(41, 57) | ~lng.between(-96, -74), "outside")
    )
