"""Line deduplication with two Bloom filters.

A first pass hashes every line's key and sends, for each Arrow batch and hash segment, the
batch's distinct hashes to the segment's task, which keeps two Bloom filters: keys seen once
and keys seen twice. A second pass probes the twice-seen filters, broadcast in slabs of a
bounded size, and only suspected repeats (128-bit keys) shuffle for exact counts and for the
choice of the occurrence that stays. The number of segments grows with the texts, so that one
segment's filters stay below a slab however many lines there are.

Null or empty texts are one empty line. Each row counts as a document; rows that share the
largest id of a key all keep its line. A null id keeps a line only where every holder's id is
null. Texts are read whole, however long; an empty table gives an empty result. Other columns
pass through, whatever their names, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgraph.llm.common import Scratch, shuffle_partitions
from landgraph.llm.hashing import LOWER, SPACE, Words, mix, word_slices

PROBES = 5
BITS_A_KEY = 12
# At most half of a segment's keys are met twice, and layers double: 2^24 keys make twice-seen filters of at most 24 MB.
SEGMENT_KEYS = 1 << 24


class Bloom:
    """A Bloom filter that adds a larger layer when its last one is full."""

    def __init__(self, capacity: int = 1 << 14):
        self.layers: list[np.ndarray] = []
        self.capacity, self.left = max(1, capacity // 2), 0

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
        other = mix(keys) | np.uint64(1)
        return [(keys + np.uint64(i) * other) % np.uint64(bits) for i in range(PROBES)]

    @staticmethod
    def test(layer: np.ndarray, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for p in Bloom.places(keys, len(layer) * 8):
            found &= (layer[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
        return found

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        for layer in self.layers:
            found |= self.test(layer, keys)
        return found

    def add(self, keys: np.ndarray) -> None:
        while len(keys):
            if not self.left:
                self.capacity *= 2
                self.left = self.capacity
                self.layers.append(np.zeros(self.capacity * BITS_A_KEY // 8, np.uint8))
            part, keys = keys[: self.left], keys[self.left :]
            self.left -= len(part)
            for p in self.places(part, len(self.layers[-1]) * 8):
                np.bitwise_or.at(self.layers[-1], p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))


class Lines:
    """Lines of a slice of texts: doc, byte span, 128-bit key, and the key's length in code points."""

    def __init__(self, words: Words):
        data, ends, n = words.data, words.ends, len(words.data)
        breaks = np.flatnonzero(data == 10)
        # a break at byte b ends a line of the text that holds b; every text also ends its last line
        stops = np.concatenate([breaks, ends[1:]])
        doc = np.concatenate([np.searchsorted(ends, breaks, side="right") - 1, np.arange(words.docs)])
        # texts of no bytes share their end with others; order by text first
        order = np.lexsort((stops, doc))
        self.end, self.doc = stops[order], doc[order]
        first = np.ones(len(self.doc), bool)
        first[1:] = self.doc[1:] != self.doc[:-1]
        self.start = np.where(first, ends[self.doc], np.append(0, self.end[:-1] + 1))
        solid = np.flatnonzero(~SPACE[data])
        lo, hi = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        full = hi > lo
        begin, stop = self.start.copy(), self.start.copy()
        begin[full], stop[full] = solid[lo[full]], solid[hi[full] - 1] + 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.length = points[stop] - points[begin]
        self.h1 = mix((words.sums[stop] - words.sums[begin]) * words.down[begin])
        other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(LOWER[data] + np.uint64(77)) * words.up[:n])])
        self.h2 = mix((other[stop] - other[begin]) * words.down[begin] + self.length.astype(np.uint64))


def _keys(min_chars: int):
    """Rows (id, h1 list, h2 list): a document's distinct long enough keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words in word_slices(b.column(1)):
                x = Lines(words)
                long = x.length >= min_chars
                doc, h1, h2 = x.doc[long], x.h1[long], x.h2[long]
                order = np.lexsort((h2, h1, doc))
                doc, h1, h2 = doc[order], h1[order], h2[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                yield b.column(0).take(pa.array(doc[new] + words.first)), h1[new], h2[new]

    return run


def _send(segments: int, min_chars: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [h1 for _, h1, _ in _keys(min_chars)([b])]
            keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
            seg = (mix(keys) % np.uint64(segments)).astype(np.int64)
            order = np.argsort(seg, kind="stable")
            keys, counts, seg = keys[order], counts[order], seg[order]
            names, starts = np.unique(seg, return_index=True)
            ends = [*starts[1:], len(seg)][: len(names)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.int32()),
                    pa.array([keys[i:j][counts[i:j] == 1].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()),
                    pa.array([keys[i:j][counts[i:j] > 1].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()),
                ],
                ["segment", "once", "more"],
            )

    return send


def _twice_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (segment, layers): the segment's twice-seen filter, which has every key met twice.

    A key that the filter seems to have already sets no bits, but then tests positive in the
    layers as they go out too: false positives add suspects and lose none.
    """
    seen: dict[int, tuple[Bloom, Bloom]] = {}
    for b in batches:
        for seg, once, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            first, second = seen.setdefault(seg, (Bloom(), Bloom(1 << 12)))
            once, more = np.frombuffer(once, np.uint64), np.frombuffer(more, np.uint64)
            hit = first.has(once)
            again = np.concatenate([once[hit], more])
            second.add(again[~second.has(again)])
            first.add(np.concatenate([once[~hit], more]))
    out = [(seg, [x.tobytes() for x in second.layers]) for seg, (_, second) in seen.items() if second.layers]
    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([x for _, x in out], pa.list_(pa.binary()))], ["segment", "layers"])


def _probe(segments: int, min_chars: int, shared):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {s: [np.frombuffer(x, np.uint8) for x in layers] for s, layers in shared.value.items()}
        for b in batches:
            for ids, keys, second in _keys(min_chars)([b]):
                seg = (mix(keys) % np.uint64(segments)).astype(np.int64)
                keep = np.zeros(len(keys), bool)
                order = np.argsort(seg, kind="stable")
                names, starts = np.unique(seg[order], return_index=True)
                for s, i, j in zip(names, starts, [*starts[1:], len(seg)][: len(names)], strict=True):
                    if s in filters:
                        at = order[i:j]
                        for layer in filters[s]:
                            keep[at] |= Bloom.test(layer, keys[at])
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(keep)), pa.array(keys[keep].view(np.int64)), pa.array(second[keep].view(np.int64))], ["id", "h1", "h2"])

    return probe


def _drop(min_chars: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            gone = b.column(1).to_pylist()
            for words in word_slices(b.column(0)):
                x = Lines(words)
                bounds = np.searchsorted(x.doc, np.arange(words.docs + 1))
                n_lines += np.diff(bounds).tolist()
                for d in range(words.docs):
                    raw, drops = words.data[words.ends[d] : words.ends[d + 1]], gone[words.first + d]
                    stays = None
                    if drops:
                        keys = {(k["h1"], k["h2"]) for k in drops}
                        at = slice(bounds[d], bounds[d + 1])
                        pairs = zip(x.h1[at].view(np.int64).tolist(), x.h2[at].view(np.int64).tolist(), x.length[at].tolist(), strict=True)
                        stays = [n < min_chars or (p, q) not in keys for p, q, n in pairs]
                    text = raw.tobytes().decode()
                    if stays is not None and not all(stays):
                        text = "\n".join(line for line, stay in zip(text.split("\n"), stays, strict=True) if stay)
                    texts.append(text)
                    n_dropped.append(0 if stays is None else len(stays) - sum(stays))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), *b.columns[2:]], names)

    return run


def segments_for(docs: DataFrame, text_col: str, min_chars: int, segment_keys: int) -> int:
    """Segments such that each has at most `segment_keys` keys in the mean: a key takes min_chars bytes and a break, or ends its text."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("n")).first().n or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // (max(0, min_chars) + 1) // segment_keys))


def repeated_lines(docs: DataFrame, scratch: Scratch, *, id_col: str, text_col: str, min_chars: int, min_docs: int, slab_bytes: int, segment_keys: int = SEGMENT_KEYS) -> DataFrame:
    """Rows (id, h1, h2): keys that a document must drop."""
    spark, segments = docs.sparkSession, segments_for(docs, text_col, min_chars, segment_keys)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(texts.dtypes)["id"]
    sent = texts.mapInArrow(_send(segments, min_chars), "segment int, once binary, more binary")
    filters = scratch.save(sent.repartition(segments, "segment").mapInArrow(_twice_seen, "segment int, layers array<binary>"), "filters")
    slabs, room = [[]], slab_bytes
    for seg, size in sorted((r[0], r[1]) for r in filters.select("segment", F.expr("aggregate(layers, 0L, (n, x) -> n + length(x))")).collect()):
        if size > room and slabs[-1]:
            slabs.append([])
            room = slab_bytes
        slabs[-1].append(seg)
        room -= size
    found = None
    for slab in slabs:
        held = {r.segment: [bytes(x) for x in r.layers] for r in filters.filter(F.col("segment").isin(slab)).collect()} if slab else {}
        part = texts.mapInArrow(_probe(segments, min_chars, spark.sparkContext.broadcast(held)), f"id {kind}, h1 long, h2 long")
        found = part if found is None else found.union(part)
    found = scratch.save(found, "suspected")
    counts = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs).drop("n")
    counts = scratch.save(counts, "confirmed")  # a table of its own, so that the join may split the rows of a common line
    return found.join(counts, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", "h1", "h2")


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, slab_bytes: int = 32 << 20, segment_keys: int = SEGMENT_KEYS
) -> DataFrame:
    """The documents with `text` after dropping repeated lines, and n_lines, n_dropped (replacing columns so named)."""
    scratch = Scratch(docs.sparkSession, "lines")
    drops = repeated_lines(docs, scratch, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs, slab_bytes=slab_bytes, segment_keys=segment_keys)
    drops = drops.groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("__drop")).withColumnRenamed("id", "__id")
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    whole = docs.join(drops, docs[id_col].eqNullSafe(drops["__id"]), "left").select(text_col, "__drop", *rest)
    schema = T.StructType([T.StructField(text_col, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), *(docs.schema[c] for c in rest)])
    return whole.mapInArrow(_drop(min_chars, schema.fieldNames()), schema)
