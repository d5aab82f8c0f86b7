"""A corpus pipeline: quality, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's
result as Parquet to the shared folder and gives it to the next one. All stages but the last
keep the columns of documents, others of any name included.

A stage names the documents that it rejects by doc_id: rows that share an id go together, and
a row without an id, which no verdict can name, stays. Null and empty texts are texts without
words: the classifier judges them, and line_dedup drops a document only where its lines were
taken from it. Texts are read whole, however long; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgraph.llm.common import Scratch
from landgraph.llm.decontaminate import contaminated
from landgraph.llm.line_dedup import dedup_lines
from landgraph.llm.near_dedup import near_duplicates
from landgraph.llm.packing import pack_documents
from landgraph.llm.quality import classify
from landgraph.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    judged = classify(docs, table(spark, sf_dir, "labels"))
    return docs.join(judged.filter(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those of which nothing is left go."""
    aside = {c: f"__own_{c}" for c in docs.columns if c in ("n_lines", "n_dropped")}
    out = dedup_lines(docs.withColumnsRenamed(aside))
    out = out.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.drop(*aside).withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    found = near_duplicates(docs)
    return docs.join(found.filter(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the place of each piece of each document."""
    out = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

ORACLE_SQL = None  # the classifier and the similarity search are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's packed pieces of documents."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
