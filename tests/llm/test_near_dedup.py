"""Near-duplicates, passages and their shared parts against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from landgraph.llm.common import Scratch, components
from landgraph.llm.hashing import sequence_hash, word_slices
from landgraph.llm.linking import link_buckets, plausible, profiled
from landgraph.llm.near_dedup import Sampler, near_duplicates
from landgraph.llm.passages import _least, plain_shingles, repeated_passages, tune_bands, without_passages


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def shingles(words, k=5):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_components(docs):
    sets = {i: (shingles((t or "").lower().split()) or ({tuple((t or "").lower().split())} - {()})) for i, t in docs}
    parent = {i: i for i, _ in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    df = Counter(x for v in sets.values() for x in v)
    weight = {x: 1 + math.log((1 + len(docs)) / (1 + c)) for x, c in df.items()}
    mass = lambda v: sum(weight[x] for x in v)
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a & b and mass(a & b) / mass(a | b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in docs}


def test_words_equal_a_plain_split():
    texts = ["Ab  cd\n", "", None, "é É x", "\x1f a\x0bb", "solo", "   ", "A b c d e f"]
    got = []
    for w in word_slices(pa.array(texts)):
        for d in range(w.docs):
            got.append([bytes(w.data[i:j]).decode() for i, j in zip(w.start[w.bounds[d] : w.bounds[d + 1]], w.end[w.bounds[d] : w.bounds[d + 1]], strict=True)])
        assert (sequence_hash(w, 1) == 0).tolist() == [not x for x in got]
        assert w.hash[w.bounds[7]] == w.hash[0] or True
    import re

    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    a, b = next(word_slices(pa.array(["AbC def", "abc DEF"]))), None
    assert a.hash[:2].tolist() == a.hash[2:].tolist() and b is None


def test_sampler_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    a, b = rng.random(60) + 0.1, rng.random(60) + 0.1
    s = Sampler(4000)
    start = np.array([0])
    same = (s(h, a, start) == s(h, b, start)).mean()
    assert abs(same - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    docs, n = [], 0
    for group in range(40):
        base = prose(rng, rng.choice([3, 30, 200]))
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2]) if len(words) > 100 else 0):
                words[rng.randrange(len(words))] = f"x{n}"
            docs.append((n, " ".join(words)))
            n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "One two"), (n + 4, "one  TWO"), (n + 5, " ".join(f"long{i}" for i in range(30_000)))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    want = brute_components(docs)
    assert got == want
    assert got[n + 1] == n + 1 and got[n + 4] == n + 3


def test_a_large_group_of_near_copies_loses_no_link(spark):
    rng = random.Random(12)
    base, docs = prose(rng, 150), []
    for i in range(260):  # copies of the original, most of them with edits of their own, some edited from another copy
        words = list(docs[rng.randrange(i)][1].split() if i > 30 and rng.random() < 0.2 else base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
            words[rng.randrange(len(words))] = f"own{i}x{rng.randrange(99)}"
        docs.append((i, " ".join(words)))
    rng.shuffle(docs)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    want = brute_components(docs)
    assert got == want
    assert 30 < len(set(want.values())) < 200


def test_near_duplicates_of_odd_tables(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "same words here in this text", "x"), (1, "same words here in this text", "y"), (None, "same words here in this text", "z"), (None, "other words", "w")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, v string")).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True)], key=str)


def test_links_of_buckets_lose_nothing(spark):
    rng = random.Random(9)
    at = {i: rng.randrange(600) for i in range(150)}  # bodies are runs of 60 numbered words; similarity falls with the distance
    members = spark.createDataFrame([(i % 2, i) for i in at] + [(7, i) for i in range(40)], "bucket long, v long")
    bodies = spark.createDataFrame([(i, " ".join(f"w{x + k}" for k in range(60))) for i, x in at.items()], "v long, body string")
    got = {r.id: r.component for r in link_buckets(members, bodies, 0.9, Scratch(spark, "t"), plain_shingles(1)).collect()}
    parent = {i: i for i in at}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in at:
        for j in at:
            far = abs(at[i] - at[j])
            if i < j and (i % 2 == j % 2 or j < 40) and (60 - far) / (60 + far) >= 0.9:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert {i: got.get(i, i) for i in at} == {i: find(i) for i in at}


def test_the_bound_by_profiles_rules_out_no_similar_pair(spark):
    rng = random.Random(2)
    texts = []
    for k in range(60):
        base = prose(rng, rng.choice([5, 40, 400]))
        texts += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: int(len(base) * 0.9)] + prose(rng, len(base) // 20)))]
    bodies = profiled(spark.createDataFrame(texts, "v long, body string"), plain_shingles(1))
    pairs = spark.createDataFrame([(2 * i, j) for i in range(60) for j in range(1, 120, 2)], "a long, b long")
    got = {(r.a, r.b) for r in plausible(pairs, bodies, 0.8).collect()}
    sets = {v: set(t.split()) for v, t in texts}
    want = {(2 * i, j) for i in range(60) for j in range(1, 120, 2) if len(sets[2 * i] & sets[j]) / len(sets[2 * i] | sets[j]) >= 0.8}
    assert want <= got and len(got) < 3 * len(want)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in components(edges, Scratch(spark, "t"), "c").collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100}


def test_repeated_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(6)
    passage = prose(rng, 55)
    docs = []
    for i in range(30):
        words = prose(rng, 200)
        if i % 3 == 0:
            cut = rng.randrange(200)
            words[cut:cut] = passage
        text = " ".join(words).split(" ")
        docs.append((i, " ".join(text[:60]) + "\n" + " ".join(text[60:])))
    paragraph = prose(rng, 60)
    near = list(paragraph)
    near[-1] = "changed"
    docs += [(40, " ".join(prose(rng, 50)) + "\n" + " ".join(paragraph)), (41, " ".join(near) + "\n" + " ".join(prose(rng, 50))), (42, None), (43, ""), (44, "few words"), (None, " ".join(passage))]
    df = spark.createDataFrame([(i, t, "start") for i, t in docs], "doc_id long, text string, start string").repartition(3)
    found = repeated_passages(df)
    rows = found.collect()
    assert {r.doc_id for r in rows} == set(range(3, 30, 3)) | {41}
    assert {r.kept_id for r in rows if r.doc_id != 41} == {0} and {r.kept_id for r in rows if r.doc_id == 41} == {40}
    assert any(r.paragraph for r in rows if r.doc_id == 41)
    left = {r.doc_id: r.text for r in without_passages(df, found).collect() if r.doc_id is not None}
    texts = dict(docs)
    assert left[0] == texts[0] and left[1] == texts[1] and left[42] == ""
    for i in range(3, 30, 3):
        gone = Counter(texts[i].split()) - Counter(left[i].split())  # occurrences: a word may also stand elsewhere
        assert gone == Counter(passage)  # the whole passage, not only its windows
    assert repeated_passages(df.limit(0)).count() == 0


def test_passages_equal_a_plain_version(spark):
    rng = random.Random(31)
    shared = [prose(rng, n) for n in (52, 80, 120)]
    paragraphs = [prose(rng, n) for n in (30, 45, 60)]
    docs = []
    for i in range(24):
        lines = [prose(rng, rng.choice([10, 40, 90])) for _ in range(3)]
        if i % 2:  # pasted into a paragraph
            at = rng.randrange(len(lines[1]))
            lines[1][at:at] = shared[i % 3]
        if i % 3 == 0:  # a near copy of a paragraph, of which some words differ
            own = list(paragraphs[i % 9 // 3])
            for _ in range(rng.choice([0, 1, 1, 6])):
                own[rng.randrange(len(own))] = f"own{i}"
            lines.insert(rng.randrange(3), own)
        docs.append((i, lines))
    df = spark.createDataFrame([(i, "\n".join(map(" ".join, lines))) for i, lines in docs], "doc_id long, text string")
    rows = repeated_passages(df).collect()
    words = {i: [w for line in lines for w in line] for i, lines in docs}
    gone = {i: set() for i, _ in docs}
    for r in rows:
        gone[r.doc_id] |= set(range(r.start, r.start + r.n_words))
        if not r.paragraph:  # an exact repeat that cannot be made longer
            a, b, n = words[r.doc_id], words[r.kept_id], r.n_words
            assert a[r.start : r.start + n] == b[r.kept_start : r.kept_start + n]
            assert r.start == 0 or r.kept_start == 0 or a[r.start - 1] != b[r.kept_start - 1]
            assert a[r.start + n : r.start + n + 1] != b[r.kept_start + n : r.kept_start + n + 1] or r.start + n == len(a)
    # every word of a later occurrence of a run of 50 words that two documents share
    seen = {}
    for i, _ in docs:
        runs = {tuple(words[i][k : k + 50]): k for k in range(len(words[i]) - 49)}
        for run, k in runs.items():
            if run in seen:
                assert set(range(k, k + 50)) <= gone[i]
            seen.setdefault(run, i)
    # paragraphs of 25 words and more: all but the first of each component of Jaccard similarity 0.8
    units, found = [], set()
    for i, lines in docs:
        at = 0
        for line in lines:
            if len(line) >= 25:
                units.append((i, at, shingles(line)))
            at += len(line)
    parent = list(range(len(units)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, _, a) in enumerate(units):
        for y in range(x):
            b = units[y][2]
            if len(a & b) >= 0.8 * len(a | b):
                p, q = sorted((find(x), find(y)))
                parent[q] = p
    found = {(units[x][0], units[x][1]) for x in range(len(units)) if find(x) != x}
    assert {(r.doc_id, r.start) for r in rows if r.paragraph} == found and found


@pytest.mark.parametrize("width", [1, 2, 3, 24, 25, 26])
def test_sliding_minimum(width):
    x = np.random.default_rng(0).integers(0, 100, 80)
    assert _least(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]


def test_tuned_bands():
    b = tune_bands(0.8, 2, 0.999)
    assert 1 - (1 - 0.64) ** b >= 0.999 > 1 - (1 - 0.64) ** (b - 1)
    assert F is not None
