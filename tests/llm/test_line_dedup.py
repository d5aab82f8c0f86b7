"""Line dedup against a plain version."""

import hashlib
import random

from landgraph.llm.line_dedup import Bloom, dedup_lines, segments_for
import numpy as np

SPACES = "\t\n\x0b\x0c\r "


def plain(docs, min_chars=20, min_docs=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))
    holders = {}
    for i, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append(i)
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def texts():
    rng = random.Random(1)
    pool = ["A Common line of Text that Repeats", "  a common line of text that repeats\t", "ééééééééééééééééééé é", "short", "", "   ", "\r", "exactly twenty chars", "nineteen characters"]
    docs = [(i, "\n".join(rng.choice(pool + [f"own line number {i} and some more"]) for _ in range(rng.randint(1, 9)))) for i in range(200)]
    return docs + [(200, None), (201, ""), (202, "\n\n"), (203, "x" * 200_000 + "\n" + pool[0]), (204, "ÀÉ" * 10), (205, "àé" * 10)]


def test_equals_the_plain_version(spark):
    docs = texts()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for slab in (32 << 20, 1):  # one broadcast, and one for each segment
        got = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in dedup_lines(df, slab_bytes=slab).collect()}
        assert got == plain(docs)


def test_segments_grow_with_the_texts(spark):
    docs = texts()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    size = sum(len((t or "").encode()) + 1 for _, t in docs)
    assert segments_for(df, "text", 20, 1 << 24) == 4 == segments_for(df.limit(0), "text", 20, 100)
    n = segments_for(df, "text", 20, 100)
    assert n == -(-size // 21 // 100) > 50
    got = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in dedup_lines(df, segment_keys=100).collect()}
    assert got == plain(docs)


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_lines(df).count() == 0
    line = "the same line in every row"
    df = spark.createDataFrame([(1, line, "a"), (1, line, "b"), (None, line, "c"), (0, line, "d")], "doc_id long, text string, n_lines string")
    got = [(r.doc_id, r.text) for r in dedup_lines(df).collect()]
    assert sorted(got, key=str) == sorted([(1, line), (1, line), (None, ""), (0, "")], key=str)


def test_every_repeated_key_is_found(spark):
    # one key, an odd number in few segments, and so many that the filters' false positives show
    for n in (1, 3, 7, 60_001):
        lines = [f"repeated line number {k} of {n}" for k in range(n)]
        docs = [(i, "\n".join(lines[j::4])) for j in range(4) for i in range(3 * j, 3 * j + 3)]
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(12, "doc_id")
        got = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in dedup_lines(df).collect()}
        assert got == plain(docs)


def test_bloom_has_no_false_negatives():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 50_000).astype(np.uint64)
    b = Bloom(1 << 10)
    b.add(keys)
    assert b.has(keys).all() and b.has(keys + np.uint64(1)).mean() < 0.05
