"""Benchmark decontamination by template canonicalisation.

Words lose punctuation at their ends and case; numbers become <num>, quantities with a glued
unit <qty>, units <unit>, and each run of up to four capitalised words that no punctuation
parts <name>, at the start of a sentence as elsewhere (longer runs are headlines and stay
words). A benchmark item is the list of its windows of `window` canonical words; a document
holds it where it has at least `coverage` of them in one place. By the pigeonhole principle
such a document has one of any n - ceil(coverage * n) + 1 of the item's n windows, so only
each item's rarest ones are hash-joined with the documents' windows, and windows that many
items share join nothing. The pairs found are judged by all windows: matches whose shifts
(place in the document less place in the item) lie near each other are one alignment, so a
word put in or left out does not end it. The words behind placeholders must agree: on an
alignment the same slot value of the item stands for the same value in the document and the
other way round, so a question with new names and numbers matches and a chance mixture does
not; values that stay what they are count only where they conflict. Every alignment is judged; of those that pass, the one of most coverage is reported, of
equals the earliest. Items shorter than a window are one window of their own.

The benchmark's windows are broadcast in slabs of at most `slab_windows` (an item is not
split); a larger benchmark takes more passes over the documents, not more memory.

Null and empty texts match nothing; items without words are ignored. Items that share an id
are items of their own; repeated rows of the documents are reported for each row, a null id
like any other. Texts are read whole, however long. Empty tables give an empty result; other
columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgraph.llm.hashing import STEP, Words, mix, word_slices

# Unit words.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs day days week weeks month months year years hour hours minute minutes second seconds meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres dollar dollars euro euros cent cents percent degree degrees volt volts watt watts kw kwh mb gb tb".split()
NUM, QTY, UNIT, NAME = (np.uint64(x) for x in (0xA11CE5ED00000001, 0xA11CE5ED00000002, 0xA11CE5ED00000003, 0xA11CE5ED00000004))

HEADLINE = 5  # capitalised words in a row that are no name any more
BLOCK = 1 << 20  # matches looked at together

_ascii = lambda chars: np.isin(np.arange(256), np.frombuffer(chars.encode(), np.uint8))
EDGE = _ascii("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
DIGIT = _ascii("0123456789")
NUMERIC = _ascii("0123456789.,:/%-+")
UPPER = _ascii("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _unit_hashes() -> np.ndarray:
    words = next(word_slices(pa.array([" ".join(UNITS)])))
    return np.sort(words.hash)


class Canonical:
    """Canonical words of a slice: form (hash), value (hash of the words themselves), slot, doc, and bounds by text."""

    def __init__(self, words: Words, units: np.ndarray):
        data, start, end = words.data, words.start.copy(), words.end.copy()
        for _ in range(8):
            start += (start < end) & EDGE[data[np.minimum(start, len(data) - 1)]]
            end -= (start < end) & EDGE[data[end - 1]]
        full = start < end
        parted = (words.end != end)[full]  # punctuation behind the word
        start, end, doc = start[full], end[full], words.doc[full]
        value = mix((words.sums[end] - words.sums[start]) * words.down[start])
        first, second = data[start], data[np.minimum(start + 1, len(data) - 1)]
        numeric = np.concatenate([[0], np.cumsum(NUMERIC[data])])
        all_numeric = numeric[end] - numeric[start] == end - start
        digit = DIGIT[first]
        # capitals of two-byte Latin letters are C3 80..9E
        capital = UPPER[first] | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        unit = units[np.minimum(np.searchsorted(units, value), len(units) - 1)] == value
        # a run of capitalised words is one name
        goes_on = np.zeros(len(value), bool)
        goes_on[1:] = capital[1:] & capital[:-1] & ~parted[:-1] & (doc[1:] == doc[:-1])
        heads = np.flatnonzero(~goes_on)
        sizes = np.diff(np.append(heads, len(value)))
        name = capital & np.repeat(sizes < HEADLINE, sizes)
        rank = (np.arange(len(value)) - np.repeat(heads, sizes)).astype(np.uint64)
        form = value.copy()
        form[name] = NAME
        form[unit & ~name] = UNIT
        form[digit] = QTY
        form[digit & all_numeric] = NUM
        if len(heads):
            whole = mix(np.add.reduceat(mix(value + rank * STEP), heads))
            value = np.where(name & np.repeat(sizes > 1, sizes), np.repeat(whole, sizes), value)
        one = ~(name & goes_on)  # the first word of a name stands for all of it
        self.form, self.value, self.doc = form[one], value[one], doc[one]
        self.slot = self.form != self.value
        self.bounds = np.searchsorted(self.doc, np.arange(words.docs + 1))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of windows within one text, and their first words."""
        n = len(self.form)
        if n < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        acc = self.form[: n - width + 1].copy()
        for j in range(1, width):
            acc = acc * STEP + self.form[j : n - width + 1 + j]
        first = np.flatnonzero(self.doc[: n - width + 1] == self.doc[width - 1 :])
        return mix(acc[first] + np.uint64(width)), first


def template_windows(texts: list[str], window: int, coverage: float) -> dict:
    """The benchmark's side of the join: each item's rarest windows sorted by hash, and the items whole."""
    units, items = _unit_hashes(), []
    for text in texts:
        c = next(iter([Canonical(words, units) for words in word_slices(pa.array([text]))]))
        width = min(window, len(c.form))
        items.append({"width": width, "windows": c.windows(width)[0] if width else np.zeros(0, np.uint64), "value": c.value, "slot": c.slot})
    every, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x["windows"] for x in items)]), return_counts=True)
    rare: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for k, x in enumerate(items):
        h = x["windows"]
        need = len(h) - math.ceil(round(coverage * len(h), 9)) + 1 if len(h) else 0
        order = np.lexsort((h, counts[np.searchsorted(every, h)]))
        picked = np.unique(h[order[:need]])
        rare.setdefault(x["width"], []).append((picked, np.full(len(picked), k)))
    index = {}
    for width, rows in rare.items():
        h, item = (np.concatenate([r[i] for r in rows]) for i in range(2))
        order = np.argsort(h, kind="stable")
        if width:
            index[width] = (h[order], item[order])
    return {"index": index, "items": items}


def judge(item: dict, at: np.ndarray, pos: np.ndarray, value: np.ndarray, coverage: float, agreement: float) -> tuple[float, float, bool] | None:
    """Coverage, slot agreement and whether slots differ, of the best alignment that passes; at and pos are matching windows."""
    n, slack = len(item["windows"]), max(4, len(item["windows"]) // 8)
    order = np.lexsort((pos, at - pos))
    at, pos = at[order], pos[order]
    cuts = np.flatnonzero(np.append(True, np.diff(at - pos) > slack))
    best = None
    for i, j in zip(cuts, [*cuts[1:], len(at)], strict=True):
        share = len(np.unique(pos[i:j])) / n
        if share < coverage or (best and share <= best[0]):
            continue
        step = np.arange(item["width"])
        here, there = (pos[i:j, None] + step).ravel(), (at[i:j, None] + step).ravel()
        slots = item["slot"][here]
        mine, theirs = item["value"][here[slots]], value[there[slots]]
        pairs = np.unique(np.column_stack([mine, theirs]), axis=0)
        # a value that stands for itself alone is no evidence either way
        (_, p, n_p), (_, q, n_q) = (np.unique(pairs[:, k], return_inverse=True, return_counts=True) for k in (0, 1))
        pairs = pairs[(pairs[:, 0] != pairs[:, 1]) | (n_p[p] > 1) | (n_q[q] > 1)]
        same = min(len(np.unique(pairs[:, 0])), len(np.unique(pairs[:, 1]))) / len(pairs) if len(pairs) else 1.0
        if same >= agreement:
            best = (share, same, bool((mine != theirs).any()))
    return best


def _candidates(c: Canonical, t: dict) -> list[tuple[int, int]]:
    """Pairs (text of the slice, item) that share one of the item's rarest windows."""
    found = [np.zeros(0, np.int64)]
    for width, (keys, item) in t["index"].items():
        h, first = c.windows(width)
        lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        some = np.flatnonzero(hi > lo)
        n, lo, doc = (hi - lo)[some], lo[some], c.doc[first[some]].astype(np.int64)
        ends = np.cumsum(n)
        for a in range(0, int(ends[-1]) if len(ends) else 0, BLOCK):
            k = np.arange(a, min(a + BLOCK, int(ends[-1])))
            row = np.searchsorted(ends, k, side="right")
            found.append(np.unique((doc[row] << 32) | item[lo[row] + k - (ends[row] - n[row])]))
        found = [np.unique(np.concatenate(found))]
    return [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in np.unique(np.concatenate(found))]


def _scan(shared, coverage: float, agreement: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, units = shared.value, _unit_hashes()
        for b in batches:
            rows: list[tuple] = []
            for words in word_slices(b.column(1)):
                c = Canonical(words, units)
                sorted_windows: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
                for d, k in _candidates(c, t):
                    item = t["items"][k]
                    if (d, item["width"]) not in sorted_windows:
                        part = Canonical.__new__(Canonical)
                        lo, hi = c.bounds[d], c.bounds[d + 1]
                        part.form, part.doc = c.form[lo:hi], np.zeros(hi - lo, np.int64)
                        h, first = part.windows(item["width"])
                        order = np.argsort(h, kind="stable")
                        sorted_windows = {key: x for key, x in sorted_windows.items() if key[0] == d}
                        sorted_windows[d, item["width"]] = h[order], first[order]
                    h, first = sorted_windows[d, item["width"]]
                    lo, hi = np.searchsorted(h, item["windows"], "left"), np.searchsorted(h, item["windows"], "right")
                    n = hi - lo
                    pos = np.repeat(np.arange(len(n)), n)
                    at = first[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
                    verdict = judge(item, at, pos, c.value[c.bounds[d] : c.bounds[d + 1]], coverage, agreement)
                    if verdict:
                        rows.append((d + words.first, k, *verdict))
            at, items, found, agreed, changed = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array([t["ids"][k] for k in items], t["type"]), pa.array(found, pa.float64()), pa.array(agreed, pa.float64()), pa.array(changed, pa.bool_())],
                ["id", "item", "coverage", "agreement", "reparametrised"],
            )

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, coverage: float = 0.6, agreement: float = 0.8, slab_windows: int = 1_000_000
) -> DataFrame:
    """Rows (id, item, coverage, agreement, reparametrised), one for each document and item it holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    kinds = {"id": dict(rows.dtypes)["id"], "item": dict(items.dtypes)["item"]}
    schema = f"`{id_col}` {kinds['id']}, `{item_col}` {kinds['item']}, coverage double, agreement double, reparametrised boolean"
    out, slab, held = None, [], 0

    def scan(slab: list) -> DataFrame:
        t = template_windows([x.text or "" for x in slab], window, coverage)
        t |= {"ids": [x.item for x in slab], "type": pa.int64() if kinds["item"] == "bigint" else pa.int32() if kinds["item"] == "int" else pa.string()}
        return rows.mapInArrow(_scan(spark.sparkContext.broadcast(t), coverage, agreement), schema)

    for x in items.toLocalIterator():  # a slab at a time
        n = len((x.text or "").split())
        if held + n > slab_windows and slab:
            found = scan(slab)
            out, slab, held = found if out is None else out.union(found), [], 0
        slab.append(x)
        held += n
    found = scan(slab)
    return found if out is None else out.union(found)
