"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenised once into pieces of at most `capacity` tokens; a document that is
longer is cut so that all pieces but the first are full. Full pieces are sequences of their
own. The others are dealt evenly by hash into shards of a bounded size, and on each shard
several islands evolve packings: a chromosome is a list of bins, and the first ones are best fit
in random orders that lean toward long pieces first. Crossover injects well-filled bins of one
parent whole into the other, drops the duplicates with their bins and the worst bins that are
left, and puts the displaced pieces back by best fit. Between epochs each island's elite migrates
to the next island of its shard. After the last epoch each shard keeps its best packing, the pieces of badly filled
bins are dealt anew and packed together, so shards leave hardly any bin half empty.
Evolution stops at the lower bound ceil(tokens / capacity), which cannot be beaten.

Null texts are empty; every document has at least the final token, so each row has a piece.
Rows that share an id are packed as documents of their own, a null id's like any other. Texts
are tokenised whole, however long: a task holds one text's ids at a time beside its batch. An
empty table has no pieces. Columns other than id and text are not carried, so their names
(piece, length, key and the like) cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgraph.llm.common import Scratch

END_OF_TEXT = "<|endoftext|>"


def encoder(ranks_path: str, pattern: str):
    """A byte-level BPE encoder; the end-of-text string is a token, as in the vocabulary's own file."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})
    return lambda text: enc.encode(text, allowed_special="all") if END_OF_TEXT in text else enc.encode_ordinary(text)


def _tokenise(ranks_path: str, pattern: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern)
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                rows, pieces, starts, lengths, data = [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                    head = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
                    cuts = [0, *range(head, len(ids), capacity), len(ids)]
                    for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(row)
                        pieces.append(k)
                        starts.append(i)
                        lengths.append(j - i)
                        data.append(ids[i:j].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(data, pa.binary())],
                    ["id", "piece", "start", "length", "ids"],
                )

    return run


def token_pieces(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Rows (id, piece, start, length, ids): ids are little-endian unsigned 32-bit."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, piece int, start long, length long, ids binary"
    return rows.mapInArrow(_tokenise(ranks_path, pattern, end_id, capacity), schema)


class Bins:
    """Bins under construction with constant-time best fit: a bit of `free` says that some bin has that room."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free = 0

    def open(self, members: list[int]) -> None:
        left = self.capacity - sum(self.lengths[i] for i in members)
        self.bins.append(members)
        self._offer(len(self.bins) - 1, left)

    def _offer(self, at: int, left: int) -> None:
        if left:
            self.room[left].append(at)
            self.free |= 1 << left

    def best_fit(self, items: list[int]) -> None:
        self.place(sorted(items, key=lambda i: -self.lengths[i]))

    def place(self, items: list[int]) -> None:
        """Best fit in the order given."""
        for i in items:
            need = self.lengths[i]
            fits = self.free >> need
            if not fits:
                self.open([i])
                continue
            left = need + (fits & -fits).bit_length() - 1
            at = self.room[left].pop()
            if not self.room[left]:
                self.free &= ~(1 << left)
            self.bins[at].append(i)
            self._offer(at, left - need)


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> float:
    """Mean squared fill: prefers well-filled bins beside nearly empty ones."""
    return sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def worth(b: list[int], lengths: list[int], capacity: int) -> tuple:
    """Order of bins, best first: filled to 99 % with few pieces, as small pieces are of more use elsewhere; then by fill."""
    fill = sum(lengths[i] for i in b)
    return fill * 100 < 99 * capacity, len(b), -fill


def crossover(giver: list[list[int]], taker: list[list[int]], lengths: list[int], capacity: int, share: float, loosen: float = 0.5) -> list[list[int]]:
    """The giver's best bins whole; of the taker's bins without their pieces the better ones; displaced pieces by best fit.

    `share` of the giver's bins are injected, `loosen` of the taker's untouched bins are dissolved.
    """
    rank = lambda b: worth(b, lengths, capacity)
    injected = sorted(giver, key=rank)[: max(1, int(len(giver) * share))]
    used = {i for b in injected for i in b}
    apart = sorted((b for b in taker if used.isdisjoint(b)), key=rank)
    kept = apart[: len(apart) - int(len(apart) * loosen)]
    child = Bins(lengths, capacity)
    for b in [*injected, *kept]:
        child.open(list(b))
    used.update(i for b in kept for i in b)
    child.best_fit([i for b in taker for i in b if i not in used])
    return child.bins


def randomised(lengths: list[int], capacity: int, rng: np.random.Generator, spread: float = 0.9) -> list[list[int]]:
    """Best fit by length times a random factor of 1 - spread to 1 + spread."""
    start = Bins(lengths, capacity)
    start.place(np.argsort(-np.array(lengths) * rng.uniform(1 - spread, 1 + spread, len(lengths)), kind="stable").tolist())
    return start.bins


def mutate(bins: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Dissolves the worst filled bins and a few others, and packs their pieces anew."""
    ranked = sorted(bins, key=lambda b: -sum(lengths[i] for i in b))
    gone = max(1, len(ranked) // 50)
    picked = set(range(len(ranked) - gone, len(ranked))) | set(rng.integers(0, len(ranked), gone).tolist())
    child = Bins(lengths, capacity)
    for k, b in enumerate(ranked):
        if k not in picked:
            child.open(list(b))
    child.best_fit([i for k in picked for i in ranked[k]])
    return child.bins


def evolve(lengths: list[int], capacity: int, seed: int, population: int, generations: int, immigrants: list[list[list[int]]] = ()) -> list[list[int]]:
    bound = -(-sum(lengths) // capacity)
    rng = np.random.default_rng(seed)
    rate = lambda x: (-len(x), fitness(x, lengths, capacity))
    pool = list(immigrants)
    if pool and min(map(len, pool)) <= bound:
        return min(pool, key=len)
    pool += [randomised(lengths, capacity, rng) for _ in range(max(2, population) - len(pool))]
    pool.sort(key=rate, reverse=True)
    for _ in range(generations):
        if len(pool[0]) <= bound:
            break
        a, b = rng.choice(len(pool), 2, replace=False)
        child = crossover(pool[a], pool[b], lengths, capacity, 0.1 + 0.4 * rng.random())
        if rng.random() < 0.25:
            child = mutate(child, lengths, capacity, rng)
        pool = sorted([*pool, child], key=rate, reverse=True)[: max(2, population)]
    return pool[0]


def _bin_numbers(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _island(capacity: int, population: int, generations: int, islands: int, epoch: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable", ignore_index=True)
        lengths = pdf.length.tolist()
        came = []
        if "elite" in pdf and pdf.elite.notna().all():
            groups: dict[int, list[int]] = {}
            for i, e in enumerate(pdf.elite.tolist()):
                groups.setdefault(int(e), []).append(i)
            came = [list(groups.values())]
        bins = evolve(lengths, capacity, hash((int(key[0]), int(key[1]), epoch)) & 0x7FFFFFFF, population, generations, came)
        return pd.DataFrame({"shard": key[0], "island": (key[1] + 1) % islands, "key": pdf.key, "length": pdf.length, "elite": _bin_numbers(bins, len(lengths)), "n_bins": len(bins)})

    return run


PACKED = "shard int, island int, key long, length long, elite int, n_bins int"


def pack(
    pieces: DataFrame, scratch: Scratch, *, capacity: int = 2048, shard_items: int = 20_000, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 24, finish_below: float = 0.98
) -> DataFrame:
    """Places rows (key long unique, length long) of at most `capacity` into sequences: (key, sequence_id, offset)."""
    n = pieces.filter(F.col("length") < capacity).count()
    shards = max(1, -(-n // shard_items))
    # a sequence's number: its kind in the last two bits, before it the full piece's key, or shard and bin
    number = lambda kind: F.shiftleft(F.shiftleft(F.col("shard").cast("long"), 32) + F.col("elite"), 2) + kind
    full = pieces.filter(F.col("length") >= capacity).select("key", (F.when(F.col("key") < 1 << 61, F.shiftleft("key", 2)).otherwise(F.raise_error(F.lit("piece keys out of range")))).alias("bin"), "length")

    def epochs_of(items: DataFrame, shards: int, label: str) -> DataFrame:
        """(key, length, shard, elite): the best island's packing of each shard."""
        deal = items.select(F.pmod(F.xxhash64("key", F.lit(label)), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "key", "length")
        for epoch in range(epochs):
            deal = deal.groupBy("shard", "island").applyInPandas(_island(capacity, population, generations, islands, epoch), PACKED)
            deal = scratch.save(deal, f"{label}{epoch}")
        best = deal.groupBy("shard").agg(F.min_by("island", F.struct("n_bins", "island")).alias("island"))
        return deal.join(best, ["shard", "island"]).select("key", "length", "shard", "elite")

    first = epochs_of(pieces.filter(F.col("length") < capacity), shards, "a")
    if shards > 1:
        fill = first.groupBy("shard", "elite").agg(F.sum("length").alias("fill"))
        first = scratch.save(first.join(fill, ["shard", "elite"]), "first")
        good = first.filter(F.col("fill") >= F.lit(finish_below * capacity))
        rest = first.filter(F.col("fill") < F.lit(finish_below * capacity)).select("key", "length")
        again = max(1, -(-rest.count() // shard_items))
        done = good.select("key", number(1).alias("bin"), "length")
        done = done.union(epochs_of(rest, again, "b").select("key", number(2).alias("bin"), "length"))
    else:
        done = first.select("key", number(1).alias("bin"), "length")
    order = Window.partitionBy("bin").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = full.union(done).withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
    return placed.select("key", F.col("bin").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = True, **kw) -> DataFrame:
    """Rows (id, piece, start, length, ids, ids_crc32, sequence_id, offset).

    With with_ids=False the token ids themselves are dropped once their checksum is taken.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = token_pieces(docs, ranks_path, pattern, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id)
    pieces = pieces.withColumns({"ids_crc32": F.crc32("ids"), "key": F.monotonically_increasing_id()})
    pieces = scratch.save(pieces if with_ids else pieces.drop("ids"), "pieces")
    placed = pack(pieces.select("key", "length"), scratch, capacity=capacity, **kw)
    return pieces.join(placed, "key").drop("key").withColumnRenamed("id", id_col)
