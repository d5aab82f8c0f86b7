"""Word and shingle hashes of whole texts, over the UTF-8 buffers of Arrow batches.

Words are runs of bytes other than [\\x20\\x09-\\x0D], with A-Z lower-cased. A word's hash is
a polynomial over its bytes, taken from prefix sums, so a whole batch is hashed by a few
numpy passes. Work goes in slices of about a megabyte, so memory is bounded by the longest
single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

np.seterr(over="ignore")  # hashes wrap on purpose
SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
STEP = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("up", ())) < n + 1:
        size = max(n + 1, SLICE + 1)
        with np.errstate(over="ignore"):
            for key, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _pow[key] = np.multiply.accumulate(steps)
    return _pow["up"], _pow["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of some texts: hash, doc (index of the text), and the byte span in the slice's buffer."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, first: int):
        n, count = len(data), len(ends) - 1
        self.first, self.docs, self.data, self.ends = first, count, data, ends
        gap = SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[ends[:-1]] = True
        inside = ~gap
        before = np.ones(n, bool)
        before[1:] = gap[:-1]
        self.start = np.flatnonzero(inside & (before | cut[:n]))
        after = np.ones(n, bool)
        after[:-1] = gap[1:]
        closes = np.zeros(n + 1, bool)
        closes[ends[1:]] = True
        self.end = np.flatnonzero(inside & (after | closes[1:])) + 1
        up, down = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((LOWER[data] + np.uint64(1)) * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.sums, self.up, self.down = sums, up, down
        self.doc = np.searchsorted(ends, self.start, side="right") - 1
        # texts without bytes share a start with the next one; searchsorted's right side names the last
        self.bounds = np.searchsorted(self.doc, np.arange(count + 1))

    def prefix_hash(self, width: int) -> np.ndarray:
        """Hashes of the words' first `width` bytes."""
        stop = np.minimum(self.end, self.start + width)
        return mix((self.sums[stop] - self.sums[self.start]) * self.down[self.start] + STEP)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of runs of `width` words, their text's index and first word.

        A text of fewer words, but one at least, has a single shingle of all its words.
        """
        h, n = self.hash, len(self.hash)
        if n >= width:
            acc = h[: n - width + 1].copy()
            for j in range(1, width):
                acc = acc * STEP + h[j : n - width + 1 + j]
            first = np.flatnonzero(self.doc[: n - width + 1] == self.doc[width - 1 :])
            out, doc = mix(acc[first]), self.doc[first]
        else:
            out, doc, first = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.diff(self.bounds)
        short = np.flatnonzero((sizes > 0) & (sizes < width))
        if len(short):
            more = []
            for d in short:
                acc1 = np.uint64(0)
                for x in h[self.bounds[d] : self.bounds[d + 1]]:
                    acc1 = acc1 * STEP + x
                more.append(acc1)
            out = np.concatenate([out, mix(np.array(more, np.uint64))])
            doc, first = np.concatenate([doc, short]), np.concatenate([first, self.bounds[short]])
            order = np.argsort(doc, kind="stable")
            out, doc, first = out[order], doc[order], first[order]
        return out, doc, first


def word_slices(column: pa.Array) -> Iterator[Words]:
    """The texts of a column, null as empty, in slices of whole texts."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    with np.errstate(over="ignore"):
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, side="right")) - 1)
            hi = min(hi, len(column))
            yield Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo)
            lo = hi


def sequence_hash(words: Words, salt: int) -> np.ndarray:
    """For each text, a hash of its sequence of words; texts without words get 0."""
    out = np.zeros(words.docs, np.uint64)
    if not len(words.hash):
        return out
    place = (np.arange(len(words.hash)) - words.bounds[words.doc]).astype(np.uint64)
    each = mix(words.hash ^ mix(place * STEP + np.uint64(salt)))
    full = np.flatnonzero(np.diff(words.bounds))
    out[full] = mix(np.add.reduceat(each, words.bounds[full]))
    return out
