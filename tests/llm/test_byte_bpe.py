"""Byte-level BPE against the tiktoken library, and round trips."""

import base64
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.errors import PySparkException

from landgraph.llm import byte_bpe
from landgraph.llm.byte_bpe import Encoder, decode_ids, encode_texts, mapped, read_ranks, serialise_model

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    tokens = read_ranks(RANKS)
    return Encoder(serialise_model(tokens), tokens, P.PATTERN)


def ids(encoder, text):
    return list(struct.unpack(f"<{len(x) // 4}I", x) if (x := encoder.encode([text])[0]) else ())


def test_characters_and_odd_strings(encoder, reference):
    for start in range(0, 0x110000, 0x1000):  # every code point, between letters, digits, signs and spaces
        text = "".join(f"a{c} 1{c}! {c}  {c}\n" for c in map(chr, range(start, start + 0x1000)) if not 0xD800 <= ord(c) < 0xE000)
        assert ids(encoder, text) == reference.encode_ordinary(text)
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "日本", "😀", "1", "23", "'s", "'LL", "'ll", "!?", "\x00", " ", "\x1c", "XyZ", "<|endoftext|>", "\r\n", "　"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert ids(encoder, text) == reference.encode_ordinary(text), text


def test_tokens_and_long_matches(encoder, reference):
    tokens = read_ranks(RANKS)
    for t in tokens:  # a match that is a token is that token
        if len(t) > 1 and t.isalpha():
            assert ids(encoder, t.decode()) == reference.encode_ordinary(t.decode())
    for text in ("a" * 50_000, " " * 50_000, "ab" * 20_000 + "!" * 9_000, "été" * 10_000):
        assert ids(encoder, text) == reference.encode_ordinary(text)


def test_matches_that_merging_does_not_reach():
    """`abc` is a token although neither `ab` nor `bc` is one."""
    tokens = [bytes([i]) for i in range(256)] + [b"abc", b" abc"]
    e = Encoder(serialise_model(tokens), tokens, P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    assert set(e.whole) == {b"abc", b" abc"}
    for text in ("abc", "abc abc", "abcd abc", "xabc", ""):
        assert ids(e, text) == own.encode_ordinary(text)


def test_long_texts_and_full_memory(encoder, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG", 100)
    monkeypatch.setattr(byte_bpe, "RUN", 7)
    monkeypatch.setattr(byte_bpe, "CACHE", 50)
    text = "One two  three\n\n  fourth's 5th, " * 60
    assert ids(encoder, text) == reference.encode_ordinary(text)


def test_ranks_must_be_whole(tmp_path):
    path = tmp_path / "ranks"
    path.write_text(f"{base64.b64encode(b'a').decode()} 1\n")
    with pytest.raises(ValueError):
        read_ranks(str(path))
    assert mapped(b"\x00 a\xff") == "ĀĠa\xff"


def test_tables(spark, reference):
    texts = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "no id"), (4, "word " * 120_000), (5, "a\x00b\n")]
    rows = spark.createDataFrame([(i, t, "x", [7]) for i, t in texts], "doc_id long, text string, id string, ids array<int>")
    got = decode_ids(encode_texts(rows, RANKS, P.PATTERN), RANKS).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode(), r.ids) for r in got) == sorted((str(i), t or "", reference.encode_ordinary(t or "")) for i, t in texts)
    assert encode_texts(rows.limit(0), RANKS, P.PATTERN).count() == 0
    named = encode_texts(rows.select("text", "id"), RANKS, P.PATTERN, id_col="id")
    assert named.columns == ["id", "ids"] and named.count() == len(texts)


def test_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in decode_ids(rows, RANKS).collect()} == {1: None, 2: b""}
    with pytest.raises(PySparkException):
        decode_ids(spark.createDataFrame([(1, [50_256])], "doc_id long, ids array<int>"), RANKS).collect()
