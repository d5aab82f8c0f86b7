"""Byte-level BPE: encoding and decoding whole texts with a sentencepiece model made from a rank file.

The rank file (base64 token, rank) becomes a sentencepiece BPE model: each token is a piece of
byte-mapped characters, one character a byte, scored by its negative rank, with identity
normalisation and no dummy prefix. sentencepiece merges the adjacent pair of highest score,
leftmost first, which is the pair of lowest rank. Texts are split by the pre-tokenisation
pattern, each match is encoded by itself, and what a match that is a token as a whole becomes is
settled beforehand: that token. Decoding joins the tokens' bytes.

The driver serialises the model, whose size is the vocabulary's, and tasks get it with their
code; nothing is shuffled. Matches already seen in a task are looked up; that memory is emptied
when it has grown to CACHE characters. A null text has the ids of an empty one: none; null ids
decode to null and ids outside the vocabulary are an error. Rows that share an id are documents of
their own; a null id stays null. Texts are read whole, however long; columns other than
id and text are not carried, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 1_500_000  # characters of matches that a task remembers
LONG, RUN = 1_000_000, 200_000  # a text of so many characters is encoded in runs of so many matches
SLICE = 1_000_000  # bytes of texts that are encoded together
NORMAL, UNKNOWN, BPE = 1, 2, 2  # kinds of sentencepiece's model format


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of their ranks, which must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def byte_characters() -> str:
    """256 characters for the bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = iter(range(0x100, 0x200))
    own = set(plain)
    return "".join(chr(b if b in own else next(odd)) for b in range(256))


CHARACTERS = dict(enumerate(byte_characters()))


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(CHARACTERS)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protocol buffer field: varint, 32-bit float, or bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose ids are the tokens' places; the unknown piece, which no byte string needs, comes last."""
    if len(tokens) >= 1 << 24:
        raise ValueError("a rank must fit a single-precision score exactly")
    piece = lambda text, score, kind: _field(1, _field(1, text) + _field(2, score) + _field(3, kind))
    pieces = [piece(mapped(t).encode(), -float(rank), NORMAL) for rank, t in enumerate(tokens)]
    pieces.append(piece(b"<unk>", 0.0, UNKNOWN))
    none = (1 << 64) - 1  # -1
    trainer = _field(3, BPE) + _field(40, len(tokens)) + _field(41, none) + _field(42, none) + _field(43, none)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Ids of texts by a serialised model."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        got = self.pieces.encode([mapped(t) for t in tokens], num_threads=1)
        # tokens that merging does not reach: as a whole match they are themselves all the same
        self.whole = {t: rank for rank, (t, ids) in enumerate(zip(tokens, got, strict=True)) if ids != [rank]}
        self.packed = [struct.pack("<I", i) for i in range(len(tokens))]
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, matches: set[str]) -> None:
        new = list(matches)
        data = [m.encode() for m in new]
        found = self.pieces.encode([mapped(x) for x in data], num_threads=1)
        if self.whole:
            found = [[self.whole[raw]] if raw in self.whole else ids for raw, ids in zip(data, found, strict=True)]
        packed = self.packed.__getitem__
        self.known.update(zip(new, [b"".join(map(packed, ids)) for ids in found], strict=True))
        self.held += sum(map(len, new)) + sum(map(len, found))

    def _ids(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each list of matches."""
        if self.held > CACHE:
            self.known.clear()
            self.held = 0
        if new := set().union(*texts).difference(self.known):
            self._learn(new)
        look = self.known.__getitem__
        return [b"".join(map(look, matches)) for matches in texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        short = [t for t in texts if len(t) < LONG]
        done = iter(self._ids([self.pattern.findall(t) for t in short]))
        return [next(done) if len(t) < LONG else self._long(t) for t in texts]

    def _long(self, text: str) -> bytes:
        found = (m.group() for m in self.pattern.finditer(text))
        return b"".join(self._ids([run])[0] for run in iter(lambda: list(islice(found, RUN)), []))


def _encode(model: bytes, tokens: list[bytes], pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or Encoder(model, tokens, pattern)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy())
            lo = 0
            while lo < len(b):
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE)))
                part = b.slice(lo, hi - lo)
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
                flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["id", "ids"])
                lo = hi

    return run


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>): the tokens of each text, without special tokens."""
    tokens = read_ranks(ranks_path)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_encode(serialise_model(tokens), tokens, pattern), f"id {dict(rows.dtypes)['id']}, ids array<int>")
    return out.select(F.col("id").alias(id_col), "ids")


def _decode(tokens: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = np.array(tokens, object)
        for b in batches:
            lists = b.column(b.num_columns - 1)
            data = [None if ids is None else b"".join(vocabulary[np.asarray(ids)].tolist()) if len(ids) else b"" for ids in (x.values.to_numpy() if x.is_valid else None for x in lists)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], [*b.schema.names, "decoded"])

    return run


def decode_ids(encoded: DataFrame, ranks_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, ids, decoded binary) of rows (id, ids)."""
    tokens = read_ranks(ranks_path)
    odd = F.exists("ids", lambda i: i.isNull() | (i < 0) | (i >= len(tokens)))
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    rows = rows.select("id", F.when(odd, F.raise_error(F.lit("an id outside the vocabulary"))).otherwise(F.col("ids")).alias("ids"))
    out = rows.mapInArrow(_decode(tokens), f"id {dict(rows.dtypes)['id']}, ids array<int>, decoded binary")
    return out.select(F.col("id").alias(id_col), F.col("ids").alias(ids_col), "decoded")
