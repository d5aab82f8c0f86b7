"""Spelling variants: near words of a vocabulary by a bit-sliced position index.

For each position and letter the index holds a bitset over the words of a block: those that have
the letter there. A query is run against all words of the block at once, a letter at a time, by
word-parallel recurrences over four sets: words equal so far, words with one letter replaced, and,
read at positions shifted by one, words with one letter more or fewer. At the query's end the sets
are cut by the words' lengths; nothing but near pairs comes out.

Which words meet is settled by a key: of two words of c and c or c + 1 letters that differ by one
edit, either the first c / 2 letters are equal or the last c - c / 2. So a word has two keys as the
shorter one of c letters and two as the longer one of c + 1, and words of one key meet in blocks.
Keys of few words share a block, keys of more than BLOCK words are dealt over several blocks in each of
which all the key's words are queries, so the work is spread and no task holds a large key.

Words that occur often are counted within a task before they are shuffled. A null text has no
words; a null id counts as an empty one. Rows that share an id are documents of their own. Texts
and words are taken whole, however long. Ties go to the smaller word in code-point order. An empty
vocabulary gives an empty result. Columns not named play no part, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgraph.llm.common import Scratch, shuffle_partitions

RUN = re.compile("[a-zÀ-ÿ]+")
HELD = 300_000  # distinct words that a task counts before it passes them on
LONG = 1_000_000  # characters of a text from which its words are not listed at once
BLOCK, PENDING = 4096, 1024  # words of a block at most, and those from which small keys are a block
QUERIES = 512  # words that are run against a block at once
CELLS = 4_000_000  # 64-bit cells of a block's index at most, but for a single key


def _count(min_length: int, delete_every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], ["word", "n"])
            totals.clear()
            return out

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                lowered = (text.as_py() or "").encode().lower().decode()  # bytes know no letters but A-Z
                own = Counter(RUN.findall(lowered) if len(lowered) < LONG else (m.group() for m in RUN.finditer(lowered)))
                prefix = zlib.crc32(f"{key}:".encode())
                for word, n in own.items():
                    if len(word) < min_length:
                        continue
                    if delete_every:
                        h = zlib.crc32(word.encode(), prefix)
                        if h % delete_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length:
                                continue
                    totals[word] += n
                if len(totals) >= HELD:
                    yield flush()
        yield flush()

    return run


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, delete_every: int = 0) -> DataFrame:
    """Rows (word, n) of the texts' runs of letters, A-Z lower-cased.

    With `delete_every` a run loses a letter where the CRC-32 h of `id:run` is a multiple of it: the one at h modulo its length.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_count(min_length, delete_every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class PositionIndex:
    """Bitsets over some words by (position, letter)."""

    def __init__(self, words: list[str]):
        self.words, self.width = words, -(-len(words) // 64)
        letters, sizes = self._letters(words)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.keys, row = np.unique(place << 21 | letters, return_inverse=True)
        self.bits = np.zeros((len(self.keys) + 1, self.width), np.uint64)  # the last row: in no word
        np.bitwise_or.at(self.bits, (row, word >> 6), np.uint64(1) << (word & 63).astype(np.uint64))
        self.sizes = sizes
        self.longest = int(sizes.max(initial=0))

    @staticmethod
    def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        return letters, np.fromiter(map(len, words), np.int64, len(words))

    def _having(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each letter the words that have it at the position."""
        if position < 0 or position >= self.longest:
            return self.bits[np.full(len(letters), -1)]
        want = position << 21 | letters
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return self.bits[np.where(self.keys[at] == want, at, -1)]

    def _bitset(self, of: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width * 64, np.uint8)
        out[: len(of)] = of
        return np.packbits(out, bitorder="little").view(np.uint64)

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) one inserted, deleted or replaced letter apart, as places in the two lists."""
        order = np.array(sorted(range(len(queries)), key=lambda i: -len(queries[i])))
        letters, sizes = self._letters([queries[i] for i in order])
        starts = np.cumsum(sizes) - sizes
        found: list[tuple[np.ndarray, np.ndarray]] = []
        equal = np.broadcast_to(self._bitset(np.ones(len(self.words), bool)), (len(queries), self.width)).copy()
        replaced, more, fewer = (np.zeros_like(equal) for _ in range(3))
        active = len(queries)
        for j in range(int(sizes.max(initial=0)) + 1):
            longer = self._bitset(self.sizes > j)  # words with a letter at j
            more |= equal & longer
            left = int(np.searchsorted(-sizes[:active], -j, side="left"))  # queries with a letter at j
            if left < active:
                same, plus, minus = (self._bitset(self.sizes == n) for n in (j, j + 1, j - 1))
                ends = slice(left, active)
                hits = (replaced[ends] & same) | (more[ends] & plus) | (fewer[ends] & minus)
                q, cell = np.nonzero(hits)
                bit = np.unpackbits(hits[q, cell].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                which, offset = np.nonzero(bit)
                found.append((order[q[which] + left], cell[which] * 64 + offset))
                active = left
                equal, replaced, more, fewer = (x[:active] for x in (equal, replaced, more, fewer))
            if not active:
                break
            c = letters[starts[:active] + j]
            here = self._having(j, c)
            fewer = (fewer & self._having(j - 1, c)) | equal
            more = more & self._having(j + 1, c)
            replaced = (replaced & here) | (equal & ~here & longer)
            equal = equal & here
        return tuple(np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in (0, 1))


def _match(index: list[tuple[str, int]], queries: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    counts = dict(index)
    words = PositionIndex(list(counts))
    weights = np.fromiter(counts.values(), np.int64, len(counts))
    asked = dict(queries)
    names, asked_n = list(asked), np.fromiter(asked.values(), np.int64, len(asked))
    step = max(1, min(QUERIES, CELLS // max(1, words.width)))
    for lo in range(0, len(names), step):
        q, w = words.near(names[lo : lo + step])
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[lo + i] for i in q.tolist()], pa.string()), pa.array(asked_n[lo + q]), pa.array([words.words[i] for i in w.tolist()], pa.string()), pa.array(weights[w])],
            ["a", "n_a", "b", "n_b"],
        )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of rows (key, block, indexed, asks, word, n), sorted by key and block, indexed rows first."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    index: list[tuple[str, int]] = []
    queries: list[tuple[str, int]] = []
    letters = 0
    for _, group in groupby(rows, key=lambda r: r[:2]):
        own: list[tuple[str, int]] = []
        asks: list[tuple[str, int]] = []
        for _, _, indexed, asking, word, n in group:
            if indexed:
                own.append((word, n))
            if asking:
                asks.append((word, n))
            if len(asks) >= BLOCK and not indexed:  # all words of the block's index have come
                yield from _match(own, asks)
                asks = []
        more = sum(len(w) for w, _ in own)
        if index and (len(index) + len(own) > PENDING or (letters + more) * (len(index) + len(own)) > CELLS * 64):
            yield from _match(index, queries)
            index, queries, letters = [], [], 0
        index += own
        queries += asks
        letters += more
    if index:
        yield from _match(index, queries)


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (a, n_a, b, n_b) of words one edit apart, each pair once or more, the shorter word first or either; words has (word, n)."""

    def keys(short: int) -> list[Column]:
        """The keys of a word's beginning and end, as the shorter word of a pair (0) or as the longer one by a letter (1)."""
        c = f"(char_length(word) - {short})"
        begin, end = f"substring(word, 1, {c} div 2)", f"substring(word, char_length(word) - ({c} - {c} div 2) + 1)"
        return [F.struct(F.expr(f"xxhash64({c}, '{side}', {part})").alias("key"), F.lit(not short).alias("asks")) for side, part in (("begin", begin), ("end", end))]

    each = words.select("word", "n", F.explode(F.array(*keys(0), *keys(1))).alias("k")).select("k.key", "k.asks", "word", "n")
    each = scratch.save(each, "keys")
    sizes = each.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max("asks").alias("asked")).filter("members > 1 and asked")
    sizes = scratch.save(sizes.select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "key_sizes")
    met = each.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("word", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = met.withColumn("block", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
    rows = dealt.select("key", "block", (F.col("block") == F.col("own")).alias("indexed"), "asks", "word", "n")
    rows = rows.repartition(shuffle_partitions(scratch.spark), "key", "block").sortWithinPartitions("key", "block", F.desc("indexed"))
    return rows.mapInArrow(_blocks, "a string, n_a long, b string, n_b long")


def spelling_variants(words: DataFrame, *, ratio: int = 2) -> DataFrame:
    """Rows (word, n, n_near, form, form_n, root) of a vocabulary (word, n).

    The form is the near word of largest n, if that is at least `ratio` times the word's own; the root
    is where the forms lead to. Counts grow along forms, so the way to a root is at most as long as
    their logarithm, and jumps over jumps halve it.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.save(words.select("word", "n"), "words")
    pairs = near_words(words, scratch)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    links = pairs.select(both.alias("p")).select("p.*").distinct()
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = links.groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), best)
    wins = -F.col("best.less") >= ratio * F.col("n")
    near = scratch.save(near.select("word", "n_near", F.when(wins, F.col("best.near")).alias("form"), F.when(wins, -F.col("best.less")).alias("form_n")), "near")
    roots, step = scratch.save(near.filter("form is not null").select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        step += 1
        jump = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = scratch.save(roots.join(jump, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), f"roots{step}")
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
