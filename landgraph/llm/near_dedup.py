"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document's features are its five-word shingles, weighted by count times inverse document
frequency. Frequencies come from all documents, counted in 2^20 hashed buckets, a table whose
size does not grow with the corpus. ICWS draws `bands * rows` samples, each equal for two
documents with a probability of their weighted Jaccard similarity; documents that share a
band are linked where their weighted Jaccard similarity, computed exactly from whole texts, is
at least `threshold`. Equal word sequences are one class from the start. With 10 bands of 3
rows a pair at 0.8 is missed with a probability below 0.001.

Words are runs of bytes outside [\\x20\\x09-\\x0D], A-Z lower-cased. A text of one to four words
is one shingle; null, empty and blank texts have none and link with nothing, not even each
other. Rows that share an id are one vertex. A null id is never the smallest of its component;
a document with a null id is kept only where it links with no other id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgraph.llm.common import Scratch, slices, sum_vectors
from landgraph.llm.hashing import STEP, Words, mix, sequence_hash, word_slices
from landgraph.llm.linking import Features, link_buckets

BITS = 20
PARTS = 64


def distinct_shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, hash, count), ordered by doc and hash."""
    h, doc, _ = words.shingles(width)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _frequencies(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            docs += len(b)
            for words in word_slices(b.column(0)):
                doc, h, _ = distinct_shingles(words, width)
                # a bucket counts a document once
                key = (doc.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS))
                seen = np.unique(key) & np.uint64((1 << BITS) - 1)
                counts += np.bincount(seen.astype(np.int64), minlength=1 << BITS)
        if docs:
            yield slices(counts, PARTS)

    return run


def inverse_frequencies(texts: DataFrame, width: int) -> np.ndarray:
    """For each hashed bucket, 1 + log((1 + documents) / (1 + documents with a shingle of it))."""
    n = texts.count()
    df = sum_vectors(texts.mapInArrow(_frequencies(width), "part int, data binary"), 1 << BITS, "int64")
    return (1 + np.log((1 + n) / (1 + df.astype(np.float64)))).astype(np.float32)


class Sampler:
    """ICWS: for each sample, the shingle of least ln a and its quantised log weight."""

    def __init__(self, samples: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        u = -np.log(1 - rng.random((4, 1 << 16)))
        self.r = (u[0] + u[1]).astype(np.float32)  # Gamma(2, 1)
        self.ln_c = np.log(u[2] + u[3]).astype(np.float32)
        self.odd = rng.integers(1, 1 << 62, samples, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, h: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sample hashes of shape (groups, samples); groups begin at starts and have shingles."""
        ln_w = np.log(weight).astype(np.float32)
        sizes = np.diff(np.append(starts, len(h)))
        out = np.empty((len(starts), len(self.odd)), np.uint64)
        for k, odd in enumerate(self.odd):
            x = h * odd
            x ^= x >> np.uint64(32)
            x *= STEP
            r = self.r[(x >> np.uint64(48)).astype(np.uint16)]
            beta = (x & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
            t = np.floor(ln_w / r + beta)
            ln_a = self.ln_c[((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)] - r * (t - beta + 1)
            least = np.minimum.reduceat(ln_a, starts)
            hits = np.flatnonzero(ln_a == np.repeat(least, sizes))
            pick = hits[np.searchsorted(hits, starts)]
            out[:, k] = mix(h[pick] ^ mix(t[pick].astype(np.int64).view(np.uint64) * STEP + odd))
        return out


def _sign(width: int, bands: int, rows: int, idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, weights = Sampler(bands * rows), idf.value
        for b in batches:
            for words in word_slices(b.column(1)):
                doc, h, tf = distinct_shingles(words, width)
                if not len(h):
                    continue
                starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                which = doc[starts]
                signs = sampler(h, tf * weights[(h >> np.uint64(64 - BITS)).astype(np.int64)], starts)
                keys = np.empty((len(starts), bands), np.uint64)
                for band in range(bands):
                    acc = np.full(len(starts), band, np.uint64)
                    for row in range(rows):
                        acc = mix(acc * STEP + signs[:, band * rows + row])
                    keys[:, band] = acc
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * bands, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                same = [pa.array(sequence_hash(words, s)[which].view(np.int64)) for s in (1, 2)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which + words.first)), *same, lists], ["id", "c1", "c2", "bands"])

    return run


def weighted_shingles(width: int, idf) -> Features:
    """Shingles with their TF-IDF weights."""

    def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for words in word_slices(column):
            doc, h, tf = distinct_shingles(words, width)
            yield doc + words.first, h, tf * idf.value[(h >> np.uint64(64 - BITS)).astype(np.int64)].astype(np.float64)

    return features


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, bands: int = 10, rows: int = 3) -> DataFrame:
    """One row for each row of docs: (id, component_id: the smallest id of its near-duplicate component, kept: id = component_id)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "near")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    idf = spark.sparkContext.broadcast(inverse_frequencies(texts.select("text"), width))
    kind = dict(texts.dtypes)["id"]
    signs = scratch.save(texts.mapInArrow(_sign(width, bands, rows, idf), f"id {kind}, c1 long, c2 long, bands array<long>"), "signs")
    classes = scratch.save(signs.groupBy("c1", "c2").agg(F.min("id").alias("v"), F.first("bands").alias("bands")), "classes")
    each = classes.filter("v is not null").select(F.col("v").cast("long").alias("v"), F.explode("bands").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = scratch.save(each.join(shared, "bucket"), "members0")
    wanted = members.select("v").distinct().hint("merge")  # the join leaves the texts partitioned by v
    bodies = texts.filter("id is not null").withColumn("v", F.col("id").cast("long")).join(wanted, "v", "left_semi").select("v", F.col("text").alias("body"))
    labels = link_buckets(members, bodies, threshold, scratch, weighted_shingles(width, idf))
    scratch.drop("members0")
    root = classes.join(labels.withColumnRenamed("id", "v"), "v", "left").select("c1", "c2", F.coalesce("component", "v").alias("component_id"))
    found = signs.select("id", "c1", "c2").join(root, ["c1", "c2"]).select("id", "component_id")
    # texts without shingles have no signature
    bare = texts.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select("id", F.col("id").alias("component_id"))
    out = found.unionByName(bare)
    return out.select(F.col("id").alias(id_col), "component_id", (F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"))
