"""Spelling variants against all pairs in plain Python."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from landgraph.llm import spelling
from landgraph.llm.common import Scratch
from landgraph.llm.spelling import PositionIndex, count_words, near_words, spelling_variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(docs, min_length=5, min_count=3, delete_every=97):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if delete_every and h % delete_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= min_count}


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        if vs:
            best = min(vs, key=lambda v: (-counts[v], v))
            if counts[best] >= 2 * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), counts[w], len(near[w]), counts.get(form.get(w))) for w in counts)


def rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def vocabulary(rng, n, letters="abcé", sizes=(5, 6, 7, 8, 11)):
    out = {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(n)}
    for w in list(out)[: n // 2]:
        i = rng.randrange(len(w))
        out |= {w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w + "a", "a" + w}
    return sorted(w for w in out if len(w) >= 5)


def test_index_finds_exactly_one_edit():
    rng = random.Random(2)
    words = vocabulary(rng, 120) + ["x" * 300, "x" * 299, "x" * 150 + "y" + "x" * 149, "y" + "x" * 299]
    q, w = PositionIndex(words).near(words)
    got = sorted(zip(q.tolist(), w.tolist(), strict=True))
    assert got == sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b))
    assert len(PositionIndex(["aaaaa"]).near([])[0]) == 0


@pytest.mark.parametrize(("block", "pending", "queries"), [(4096, 1024, 512), (16, 8, 5), (3, 1, 2)])
def test_variants_equal_all_pairs(spark, monkeypatch, block, pending, queries):
    rng = random.Random(block)
    counts = {w: rng.choice([3, 4, 6, 8, 8, 16, 40, 1000]) for w in vocabulary(rng, 150)}
    counts |= {f"stamm{a}{b}": 5 for a in "abcdefghij" for b in "abcdefghij"}  # one hot key
    monkeypatch.setattr(spelling, "BLOCK", block)  # read by the driver, and by tasks as they import it anew: sizes only
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    assert rows(spelling_variants(df)) == plain_variants(counts)
    # what tasks do with small limits
    monkeypatch.setattr(spelling, "PENDING", pending)
    monkeypatch.setattr(spelling, "QUERIES", queries)
    import pyarrow as pa

    words = sorted(counts)
    batch = pa.RecordBatch.from_pylist([{"key": 1, "block": 0, "indexed": i < 40, "asks": True, "word": w, "n": counts[w]} for i, w in enumerate(words)])
    found = {(r["a"], r["b"]) for out in spelling._blocks(iter([batch])) for r in out.to_pylist()}
    assert found == {(a, b) for a in words for b in words[:40] if one_edit(a, b)}


def test_hot_key_is_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 10)
    counts = {f"stamm{a}{b}": 5 + ord(a) for a in "abcdefghij" for b in "abcdefghij"}
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    found = near_words(df, Scratch(spark, "test")).distinct()
    assert {frozenset((r.a, r.b)) for r in found.collect()} == {frozenset((a, b)) for a in counts for b in counts if one_edit(a, b)}


def test_chains_and_ties(spark):
    counts = {"abcde": 100, "abcdx": 50, "abcyx": 25, "azcyx": 12, "abcdz": 50, "bbbbbb": 10, "abbbbb": 5, "bbbbba": 10, "lonely": 3}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows(spelling_variants(df))
    assert got == plain_variants(counts)
    assert next(r for r in got if r[0] == "azcyx")[2] == "abcde"


def test_counting(spark):
    rng = random.Random(7)
    words = ["Größe", "WORLD", "naïve", "ÉCOLE", "école", "x×y÷zz", "four", "don't", "abcdef123ghijkl", "Zürich"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(200)]
    docs += [(3, "again WORLD"), (None, "Zürich Zürich Zürich"), (500, None), (501, ""), (502, "longword" * 200_000), (503, "longword" * 200_000), (504, "longword" * 200_000)]
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in docs], "doc_id long, text string, n int, word string")
    for every in (0, 97, 3):
        got = {r.word: r.n for r in count_words(df, delete_every=every).collect()}
        assert got == plain_counts(docs, delete_every=every)


def test_empty(spark):
    assert spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert count_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_sql_and_plain_version(spark):
    from landgraph.llm.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    theirs = con.execute(SQL["op11_spelling_variants"])
    columns = [c[0] for c in theirs.description]
    want = sorted(map(str, theirs.fetchall()))
    assert sorted(str(tuple(r)) for r in QUERIES["op11_spelling_variants"](spark, sf).select(*columns).collect()) == want
    counts = plain_counts(con.execute("SELECT doc_id, text FROM documents").fetchall())
    assert len(want) == len(counts)
