"""Repeated passages: paragraph MinHash banding, exact Jaccard, and removal by components.

Units are paragraphs (lines) of at least `min_words` words, and, for passages pasted into the
middle of paragraphs, windows of `window` words at content-defined anchors: the least hash of
each run of `window` word trigrams, so that any repeated run of 2 * window words holds a whole
common window wherever it stands. Equal windows that continue each other are one span, which
grows word by word to both sides as long as it equals the kept occurrence: the whole repeat
goes, not only its windows. A second hash over the span must agree as well, so an equality
rests on 128 bits.

Paragraphs are signed by MinHash over five-word shingles; the number of bands is the smallest
with the asked recall at the threshold. Paragraphs that share a band are compared by exact
Jaccard similarity of their shingles and clustered by connected components. In each component
the first occurrence (smallest id, then position) stays; every other one is a removal.

Null and empty texts have no units. Rows that share an id are one document whose occurrences
at the same position are one. Occurrences with a null id are never removed or kept from. Ties
go to the smaller id, then to the earlier position. Texts are read whole, however long; other
columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgraph.llm.common import Scratch
from landgraph.llm.hashing import STEP, Words, _powers, mix, word_slices
from landgraph.llm.linking import Features, link_buckets
from landgraph.llm.near_dedup import distinct_shingles

POSITION = 28  # bits of a word's place in a slice of texts; longer slices are refused
AROUND = 28  # words around a span in which it may grow: anchors lie at most `window` words apart


def tune_bands(threshold: float, rows: int, recall: float) -> int:
    """The fewest bands of `rows` rows that find a pair at the threshold with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    have, low = 1, values
    while have * 2 <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(values) - width + 1], low[width - have : width - have + len(values) - width + 1])
    return low


def anchored_windows(words: Words, window: int) -> np.ndarray:
    """First words of the windows at content-defined anchors."""
    h, doc, n = words.hash, words.doc, len(words.hash)
    if n < window + 2:
        return np.zeros(0, np.int64)
    if n >> POSITION:
        raise ValueError(f"a text of over {1 << POSITION} words")
    grams = mix((h[:-2] * STEP + h[1:-1]) * STEP + h[2:])
    packed = (grams & ~np.uint64((1 << POSITION) - 1)) | np.arange(len(grams), dtype=np.uint64)
    low = _least(packed, window)
    whole = doc[: len(low)] == doc[window + 1 :]
    anchors = np.unique((low[whole] & np.uint64((1 << POSITION) - 1)).astype(np.int64))
    anchors = anchors[anchors + window <= n]
    return anchors[doc[anchors] == doc[anchors + window - 1]]


def paragraphs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of each line that has words."""
    lines = np.cumsum(words.data == 10)[words.start] if len(words.start) else np.zeros(0, np.int64)
    new = np.ones(len(lines), bool)
    new[1:] = (lines[1:] != lines[:-1]) | (words.doc[1:] != words.doc[:-1])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(lines))


def span_hash(words: Words, first: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of runs of words; another salt gives independent ones."""
    up, down = _powers(len(words.hash) + 1)
    sums = np.zeros(len(words.hash) + 1, np.uint64)
    each = mix(words.hash ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if salt else words.hash
    np.cumsum(each * up[: len(words.hash)], out=sums[1:])
    return mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))


def band_keys(words: Words, first: np.ndarray, end: np.ndarray, width: int, bands: int, rows: int) -> np.ndarray:
    """Band hashes of spans that have `width` words at least."""
    h, n = words.hash, len(words.hash)
    acc = h[: n - width + 1].copy()
    for j in range(1, width):
        acc = acc * STEP + h[j : n - width + 1 + j]
    shingles = np.append(mix(acc), np.uint64(0))
    at = np.column_stack([first, end - width + 1]).ravel()
    rng = np.random.default_rng(5)
    keys = np.empty((len(first), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(first), band, np.uint64)
        for odd in rng.integers(1, 1 << 62, rows, np.uint64):
            x = shingles * (odd * np.uint64(2) + np.uint64(1))
            x ^= x >> np.uint64(32)
            key = mix(key * STEP + np.minimum.reduceat(x, at)[::2])
        keys[:, band] = key
    return keys


def _units(window: int, min_words: int, width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words in word_slices(b.column(1)):
                at = anchored_windows(words, window)
                first, end = paragraphs(words)
                long = end - first >= max(min_words, width)
                first, end = first[long], end[long]
                starts, ends = np.append(at, first), np.append(at + window, end)
                if not len(starts):
                    continue
                keys = band_keys(words, first, end, width, bands, rows) if len(first) else np.zeros((0, bands), np.uint64)
                offsets = np.append(np.zeros(len(at), np.int64), np.arange(len(first) + 1) * bands)
                doc = words.doc[starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(doc + words.first)),
                        pa.array(np.arange(len(starts)) >= len(at)),
                        pa.array(starts - words.bounds[doc], pa.int32()),
                        pa.array(ends - starts, pa.int32()),
                        pa.array(span_hash(words, starts, ends).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel().view(np.int64))),
                    ],
                    ["id", "paragraph", "start", "n_words", "h", "bands"],
                )

    return run


def _reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For spans (paragraph, start, n_words, h) of a document: a paragraph's text; a passage's surroundings and second hash."""
    for b in batches:
        n = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
        bounds, flat = np.concatenate([[0], np.cumsum(n)]), b.column(2).flatten()
        paragraph, start, size, h = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        for words in word_slices(b.column(1)):
            of = slice(words.first, words.first + words.docs)
            here = np.arange(bounds[of.start], bounds[of.stop])
            doc = np.repeat(np.arange(words.docs), n[of])
            i = words.bounds[doc] + start[here]
            j = i + size[here]
            good = j <= words.bounds[doc + 1]  # rows that share an id may be shorter texts
            here, doc, i, j = here[good], doc[good], i[good], j[good]
            short = (words.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # 0 is no word
            steps = np.arange(AROUND)

            def around(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
                inside = (at >= lo[:, None]) & (at < hi[:, None])
                return [x.tobytes() for x in np.where(inside, short[np.clip(at, 0, len(short) - 1)], 0).astype(np.uint32)]

            first, last = words.bounds[doc], words.bounds[doc + 1]
            is_text = paragraph[here].astype(bool)
            texts = [words.data[words.start[x] : words.end[y - 1]].tobytes().decode() if t else None for x, y, t in zip(i, j, is_text, strict=True)]
            p = np.flatnonzero(~is_text)
            before, after = np.full(len(here), None, object), np.full(len(here), None, object)
            if len(p):
                before[p] = around(i[p, None] - 1 - steps, first[p], last[p])
                after[p] = around(j[p, None] + steps, first[p], last[p])
            check = span_hash(words, i, j, salt=1) if len(here) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(doc + words.first)), pa.array(is_text), pa.array(start[here], pa.int32()), pa.array(size[here], pa.int32()), pa.array(h[here], pa.int64()),
                    pa.array(texts, pa.string()), pa.array(before.tolist(), pa.binary()), pa.array(after.tolist(), pa.binary()), pa.array(check.view(np.int64)),
                ],
                ["id", "paragraph", "start", "n_words", "v", "body", "before", "after", "check"],
            )


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and their kept occurrence, longer by the words that both have before and after."""
    for b in batches:
        names = b.schema.names
        if not len(b):
            continue

        def common(which: str, b: pa.RecordBatch = b) -> np.ndarray:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(len(b), AROUND) for c in (which, f"kept_{which}"))
            same = (x == y) & (x > 0)
            return np.where(same.all(1), AROUND, same.argmin(1))

        start, size, kept = (b.column(c).to_numpy() for c in ("start", "n_words", "kept_start"))
        left, right = common("before"), common("after")
        own = b.column("own").to_numpy(zero_copy_only=False).astype(bool)
        left = np.where(own, np.minimum(left, np.maximum(start - kept - size, 0)), left)  # not into the kept occurrence
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(start - left, pa.int32()), pa.array(size + left + right, pa.int32()), b.column(names.index("kept_id")), pa.array(kept - left, pa.int32())], ["id", "start", "n_words", "kept_id", "kept_start"])


def plain_shingles(width: int) -> Features:
    """Distinct shingles, all of one weight."""

    def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for words in word_slices(column):
            doc, h, _ = distinct_shingles(words, width)
            yield doc + words.first, h, np.ones(len(h))

    return features


def repeated_passages(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 25, min_words: int = 25, width: int = 5, threshold: float = 0.8, rows: int = 4, recall: float = 0.999
) -> DataFrame:
    """Removals (id, paragraph, start, n_words, component, kept_id, kept_start); positions count words."""
    scratch, bands = Scratch(docs.sparkSession, "passages"), tune_bands(threshold, rows, recall)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    kind = dict(texts.dtypes)["id"]
    units = texts.mapInArrow(_units(window, min_words, width, bands, rows), f"id {kind}, paragraph boolean, start int, n_words int, h long, bands array<long>")
    units = scratch.save(units, "units")
    place = F.struct("id", "start")
    windows = units.filter("not paragraph").select("id", "start", "h")
    # tables of their own, so that joins on them may split the rows of a common passage
    first = scratch.save(windows.groupBy("h").agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "first")
    again = windows.join(first, "h").filter(place != F.col("kept")).select("id", "start", F.col("kept.id").alias("kept_id"), F.col("kept.start").alias("kept_start")).distinct()
    line = Window.partitionBy("id", "kept_id", "shift").orderBy("start")
    again = again.withColumn("shift", F.col("start") - F.col("kept_start"))
    again = again.withColumn("breaks", F.coalesce(F.col("start") > F.lag("start").over(line) + window, F.lit(True)).cast("int")).withColumn("island", F.sum("breaks").over(line))
    spans = again.groupBy("id", "kept_id", "shift", "island").agg(F.min("start").alias("start"), (F.max("start") - F.min("start") + window).alias("n_words"))
    spans = scratch.save(spans.select("id", "start", "n_words", "kept_id", (F.col("start") - F.col("shift")).alias("kept_start")), "spans")

    lines = scratch.save(units.filter("paragraph").drop("paragraph"), "lines")
    scratch.drop("units")
    scratch.drop("first")
    classes = scratch.save(lines.groupBy("h").agg(F.min(F.struct("id", "start", "n_words")).alias("kept"), F.first("bands").alias("bands")), "classes")
    each = classes.select(F.col("h").alias("v"), F.explode("bands").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = scratch.save(each.join(shared, "bucket"), "members0")
    # one reading of the texts: paragraphs to compare, and the surroundings of spans; a document's own distinct places
    wanted = members.select(F.col("v").alias("h")).distinct().join(classes.select("h", "kept"), "h").select("kept.id", F.lit(True).alias("paragraph"), "kept.start", "kept.n_words", "h")
    edges = spans.select("id", "start", "n_words").union(spans.select("kept_id", "kept_start", "n_words")).distinct()
    wanted = wanted.union(edges.select("id", F.lit(False), "start", "n_words", F.lit(0).cast("long")))
    wanted = wanted.groupBy("id").agg(F.collect_list(F.struct("paragraph", "start", "n_words", "h")).alias("spans"))
    reads = texts.join(wanted, "id").select("id", "text", "spans").mapInArrow(_reads, f"id {kind}, paragraph boolean, start int, n_words int, v long, body string, before binary, after binary, check long")
    reads = scratch.save(reads, "reads")

    about = reads.filter("not paragraph").select("id", "start", "n_words", "before", "after", "check").distinct()
    kept = about.select(*(F.col(c).alias(f"kept_{c}") for c in ("id", "start", "before", "after", "check")), "n_words")
    both = spans.join(about, ["id", "start", "n_words"]).join(kept, ["kept_id", "kept_start", "n_words"]).filter("check = kept_check")
    both = both.select("id", "start", "n_words", "kept_id", "kept_start", "before", "after", "kept_before", "kept_after", (F.col("id") == F.col("kept_id")).alias("own"))
    whole = both.mapInArrow(_grow, f"id {kind}, start int, n_words int, kept_id {kind}, kept_start int").distinct()
    again = whole.select("id", F.lit(False).alias("paragraph"), "start", "n_words", F.xxhash64("kept_id", "kept_start").alias("component"), F.struct(F.col("kept_id").alias("id"), F.col("kept_start").alias("start")).alias("kept"))

    bodies = reads.filter("paragraph").select("v", "body").dropDuplicates(["v"])
    # copies whose edits are their own are apart by a few shingles: only many classes tell them from similar ones
    labels = link_buckets(members, bodies, threshold, scratch, plain_shingles(width), classes=256)
    root = classes.join(labels.withColumnRenamed("id", "h"), "h", "left").select("h", "kept", F.coalesce("component", "h").alias("component"))
    root = scratch.save(root, "root")
    keeper = scratch.save(root.groupBy("component").agg(F.min("kept").alias("kept")), "keeper")
    root = scratch.save(root.select("h", "component").join(keeper, "component"), "roots")
    near = lines.join(root, "h").filter(place != F.struct("kept.id", "kept.start"))
    near = near.select("id", F.lit(True).alias("paragraph"), "start", "n_words", "component", F.struct("kept.id", "kept.start").alias("kept"))
    out = again.unionByName(near)
    return out.select(F.col("id").alias(id_col), "paragraph", "start", "n_words", "component", F.col("kept.id").alias("kept_id"), F.col("kept.start").alias("kept_start"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, out = b.column(1).to_pylist(), []
        for words in word_slices(b.column(0)):
            for d in range(words.docs):
                lo, hi = words.bounds[d], words.bounds[d + 1]
                keep = np.ones(words.ends[d + 1] - words.ends[d], bool)
                for s in spans[words.first + d] or ():
                    i, j = lo + s["start"], min(lo + s["start"] + s["n_words"], hi)
                    keep[words.start[i] - words.ends[d] : words.end[j - 1] - words.ends[d]] = False
                out.append(words.data[words.ends[d] : words.ends[d + 1]][keep].tobytes().decode())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *b.columns[2:]], ["text", *b.schema.names[2:]])


def without_passages(docs: DataFrame, removals: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of documents without their removed passages."""
    spans = removals.groupBy(id_col).agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(spans, id_col, "left").select("text", "spans", id_col)
    return rows.mapInArrow(_cut, f"text string, `{id_col}` {dict(docs.dtypes)[id_col]}").select(id_col, F.col("text").alias(text_col))
