"""Decontamination, quality, the hidden Markov model, vectors and the pipeline."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from landgraph.llm import hidden_markov
from landgraph.llm.decontaminate import contaminated
from landgraph.llm.hidden_markov import Segments, expected_counts, score_texts
from landgraph.llm.common import Scratch
from landgraph.llm.nn_descent import descend, near_vectors
from landgraph.llm.quality import classify


def prose(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def plain_contamination(docs, items, window=8, coverage=0.6, agreement=0.8):
    """Every document against every item, window by window, in plain Python."""
    from landgraph.llm.decontaminate import UNITS

    def canonical(text):
        out, run = [], []
        for raw in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
            word = raw.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
            if not word:
                continue
            if word[0].isupper() and run is not None:
                run.append((word, raw))
            else:
                out += flush(run)
                run = []
                out.append(("<num>" if word[0].isdigit() and re.fullmatch(r"[0-9.,:/%+-]+", word) else "<qty>" if word[0].isdigit() else "<unit>" if word.lower() in UNITS else word.lower(), word.lower()))
            if run and raw != raw.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
                out += flush(run)
                run = []
        return out + flush(run)

    def flush(run):
        words = [w for w, _ in run]
        if not words:
            return []
        return [("<name>", " ".join(words).lower())] if len(words) < 5 else [("<unit>" if w.lower() in UNITS else w.lower(), w.lower()) for w in words]

    found = set()
    for d, text in docs:
        a = canonical(text)
        for k, other in items:
            b = canonical(other)
            width = min(window, len(b))
            if not width:
                continue
            n = len(b) - width + 1
            hits = sorted((i - j, j, i) for i in range(len(a) - width + 1) for j in range(n) if all(x[0] == y[0] for x, y in zip(a[i : i + width], b[j : j + width], strict=True)))
            groups = []
            for h in hits:
                if not groups or h[0] - groups[-1][-1][0] > max(4, n // 8):
                    groups.append([])
                groups[-1].append(h)
            for g in groups:
                if len({j for _, j, _ in g}) / n < coverage:
                    continue
                pairs = {(b[j + s][1], a[i + s][1]) for _, j, i in g for s in range(width) if b[j + s][0].startswith("<")}
                pairs = {(x, y) for x, y in pairs if x != y or sum(x == z for z, _ in pairs) > 1 or sum(y == z for _, z in pairs) > 1}
                if not pairs or min(len({x for x, _ in pairs}), len({y for _, y in pairs})) / len(pairs) >= agreement:
                    found.add((d, k))
                    break
    return found


def test_contamination_equals_a_plain_version(spark):
    rng = random.Random(21)
    names = ["Alice", "Bob Stone", "Carla", "Dan Lee Fox"]
    base = "{0} has {1} apples and 3 kg of pears . {0} buys {2} apples from {3} , who sells them for {4} dollars each day . How many apples does {0} hold now ?"
    items = [(0, base.format("Alice", 5, 4, "Tom", 9)), (1, prose(rng, 40)), (2, prose(rng, 12)), (3, "only four words here"), (4, prose(rng, 20) + " Mary Smith " + prose(rng, 20)), (5, None)]
    docs = []
    for i in range(40):
        text = prose(rng, 60)
        kind = i % 8
        who = rng.choice(names)
        if kind == 0:
            text += ". " + base.format(who, rng.randrange(20, 30), rng.randrange(30, 40), rng.choice(["Tom", "Ute"]), rng.randrange(40, 50)) + " " + prose(rng, 10)
        elif kind == 1:  # a word put in about the middle
            words = items[1][1].split()
            text += " " + " ".join([*words[:20], "inserted", *words[20:]])
        elif kind == 2:
            text = items[2][1] + " " + text
        elif kind == 3:
            text += " only four words here"
        elif kind == 4:
            text += " " + items[4][1].replace("Mary Smith", who)
        elif kind == 5:  # too little of it
            text += " " + " ".join(items[1][1].split()[:20])
        docs.append((i, text))
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain_contamination(docs, items)
    assert got == want
    assert {(i, 0) for i in range(0, 40, 8)} <= got and {(i, 1) for i in range(1, 40, 8)} <= got and not {d for d, _ in got if d % 8 in (5, 6, 7)}


def test_contaminated_documents(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, 30)) for i in range(20)] + [(50, "a farmer sells 12 kg of apples to Mary in March and 12 kg of pears to Peter in April for 30 dollars each"), (51, None), (52, ""), (53, "one two three")]
    docs = [(i, prose(rng, 120)) for i in range(40)]
    docs[3] = (3, docs[3][1] + " " + items[5][1] + " " + docs[3][1])
    docs[4] = (4, " ".join(items[6][1].split()[:12]) + " " + docs[4][1])  # too little of it
    docs[5] = (5, "Some text. " + "a farmer sells 7 kg of apples to Anna in May and 7 kg of pears to Paul in June for 99 dollars each")
    docs[6] = (6, "Some text. " + "a farmer sells 7 kg of apples to Anna in May and 8 kg of pears to Paul in June for 99 dollars each")
    docs += [(90, None), (91, ""), (92, "well one two three go"), (3, docs[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for slab in (1_000_000, 40):
        got = sorted((r.doc_id, r.item_id, r.reparametrised) for r in contaminated(d, b, slab_windows=slab, agreement=0.9).collect())
        assert got == [(3, 5, False), (3, 5, False), (5, 50, True), (92, 53, False)]
    assert contaminated(d, b.limit(0)).count() == 0 and contaminated(d.limit(0), b).count() == 0


def junk(rng):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(["spam" + str(rng.randrange(3))] * 80)
    if kind == 1:
        return " ".join(f"W{rng.randrange(900)}!!" for _ in range(60)).upper()
    return " ".join(f"w{rng.randrange(900)}###" for _ in range(60))


def test_quality_and_toxicity(spark):
    rng = random.Random(2)
    docs, truth = [], {}
    for i in range(900):
        bad, toxic = rng.random() < 0.2, rng.random() < 0.15
        text = junk(rng) if bad else (prose(rng, rng.choice([5, 60, 300])) + ".\n" + prose(rng, 40) + ".")
        if toxic and not bad:
            text += " you vileword" + rng.choice(["", "ish"]) + " " + rng.choice(["nasty1", "nasty2"])
        docs.append((i, text, f"h{i % 7}" if i % 50 else None, "en"))
        truth[i] = (int(not bad), int(toxic and not bad))
    docs += [(2000, None, "h1", "en"), (2001, "", None, None), (0, docs[0][1], "h0", "en")]
    labels = [(i, *truth[i]) for i in range(500)] + [(5000, 1, 0), (None, 0, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(3)
    out = classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs)
    held = [r for r in out if 500 <= r.doc_id < 900]
    right = sum(r.kept == (truth[r.doc_id] == (1, 0)) for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.path_rate <= 1 and 0 <= r.quality <= 1 for r in out)
    none = classify(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(none) == len(docs) and all(r.kept for r in none)
    assert classify(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_posteriors_equal_a_plain_version(spark):
    from landgraph.llm.quality import posteriors

    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), rng.gauss(1 if i % 3 else -1, 2), rng.gauss(-3, 1)) for i in range(300)] + [(900, "lone", "z", 2.0, -3.0)]
    got = {r.id: (r.quality, r.toxic, r.host_rate, r.path_rate) for r in posteriors(spark.createDataFrame(rows, "id long, host string, path string, evidence double, toxic_logit double"), 0.7, Scratch(spark, "p")).collect()}
    p = {r[0]: 1 / (1 + math.exp(-r[3])) for r in rows}

    def shrink(sites, prior):  # site -> [good, n]; prior: site -> rate
        big = {s: v for s, v in sites.items() if v[1] >= 2}
        n = sum(v[1] for v in big.values())
        gap = sum(v[1] * (v[0] / v[1] - prior(s)) ** 2 for s, v in big.items())
        noise = sum(prior(s) * (1 - prior(s)) for s in big)
        inside = sum(v[1] * prior(s) * (1 - prior(s)) for s, v in big.items()) / n
        between = max(0.0, gap - noise) / n
        return min(1e6, max(1.0, inside / between - 1)) if between > 0 else 1e6

    hosts, paths = {}, {}
    for i, h, q, _, _ in rows:
        for sites, key in ((hosts, h), (paths, (h, q))):
            v = sites.setdefault(key, [0.0, 0])
            v[0] += p[i]
            v[1] += 1
    overall = sum(p.values()) / len(rows)
    host_k = shrink(hosts, lambda s: overall)
    rate = {h: (host_k * overall + g) / (host_k + n) for h, (g, n) in hosts.items()}
    k = shrink(paths, lambda s: rate[s[0]])
    for i, h, q, e, t in rows:
        (g, n), (hg, hn) = paths[h, q], hosts[h]
        others = (sum(p.values()) - p[i]) / (len(rows) - 1)
        host = (host_k * others + hg - p[i]) / (host_k + hn - 1)
        own = (k * host + g - p[i]) / (k + n - 1)
        odds = e - math.log(0.7 / 0.3) + math.log(own / (1 - own))
        want = (1 / (1 + math.exp(-odds)), 1 / (1 + math.exp(-t)), host, own)
        assert all(abs(x - y) < 1e-9 for x, y in zip(got[i], want, strict=True))


def test_own_evidence_counts_once(spark):
    """A site of one document has the rate of the others, whatever its own evidence; one document of all has the labels' rate."""
    from landgraph.llm.quality import posteriors

    rng = random.Random(8)
    schema = "id long, host string, path string, evidence double, toxic_logit double"
    crowd = [(i, f"h{i % 5}", "x", rng.gauss(1 if i % 5 else -2, 1), -3.0) for i in range(200)]
    for own in (-6.0, 6.0):
        out = posteriors(spark.createDataFrame([*crowd, (900, "lone", "z", own, -3.0)], schema), 0.5, Scratch(spark, "p"))
        r = out.filter("id = 900").first()
        mean = sum(1 / (1 + math.exp(-c[3])) for c in crowd) / 200
        assert abs(r.host_rate - mean) < 1e-9 and abs(r.path_rate - mean) < 1e-9
    r = posteriors(spark.createDataFrame([(1, "h", "x", 3.0, -3.0)], schema), 0.7, Scratch(spark, "p")).first()
    assert abs(r.path_rate - 0.7) < 1e-9


def test_sparse_sites_shrink(spark):
    from landgraph.llm.quality import shrunk

    rows = [(f"h{i}", float(n * r), n, 0.5) for i, (n, r) in enumerate([(1000, 0.9), (1000, 0.1), (1000, 0.5), (2, 1.0), (2, 0.0)])]
    got = {r.host: r.rate for r in shrunk(spark.createDataFrame(rows, "host string, good double, n long, prior double"), "prior", 1e6).collect()}
    assert abs(got["h0"] - 0.9) < 0.01 and abs(got["h3"] - 0.5) < abs(got["h3"] - 1.0) + 0.2 and got["h3"] < 1 and got["h4"] > 0


def brute(start, a, emit, seq):
    total = 0.0
    for path in itertools.product(range(len(a)), repeat=len(seq) + 1):
        p = start[path[0]]
        for t, s in enumerate(seq):
            p *= a[path[t], path[t + 1]] * emit[s, path[t + 1]]
        total += p
    return math.log(total)


def test_whole_texts_need_no_matrices_and_equal_segments(monkeypatch):
    rng = np.random.default_rng(6)
    lengths = np.array([1, 64, 65, 700, 3, 1024])
    symbols = rng.integers(0, 30, lengths.sum())
    a = rng.random((4, 4)) + 0.1
    a /= a.sum(1, keepdims=True)
    emit, start = rng.random((30, 4)) + 0.01, np.full(4, 0.25)
    monkeypatch.setattr(hidden_markov, "WHOLE", 64)
    cut = Segments(symbols, lengths)
    want = cut.chain(*cut.transfers(a, emit), start)[0], expected_counts(cut, start, a, emit)
    monkeypatch.undo()
    monkeypatch.setattr(Segments, "transfers", None)
    seg = Segments(symbols, lengths)
    assert np.allclose(seg.likelihood(start, a, emit), want[0]) and np.allclose(expected_counts(seg, start, a, emit), want[1])


def test_forward_and_expected_counts_equal_enumeration():
    rng = np.random.default_rng(0)
    a, emit, start = rng.random((2, 2)), rng.random((4, 2)), rng.random(2)
    a, emit, start = a / a.sum(1, keepdims=True), emit / emit.sum(0), start / start.sum()
    docs = [[0, 1, 3], [2], [1, 1, 2, 0, 3, 3]]
    seg = Segments(np.concatenate(docs), np.array([len(x) for x in docs]))
    got, _ = seg.chain(*seg.transfers(a, emit), start)
    assert np.allclose(got, [brute(start, a, emit, x) for x in docs])
    counts = expected_counts(seg, start, a, emit)
    assert np.isclose(counts[:2].sum(), 3) and np.isclose(counts[2:6].sum(), 10)
    assert np.allclose(counts[6:].reshape(4, 2).sum(1), np.bincount(np.concatenate(docs), minlength=4))
    # a long text crosses segments: matrices agree with a plain scaled recursion
    long = rng.integers(0, 4, 1000)
    seg = Segments(long, np.array([1000]))
    v, log = start.copy(), 0.0
    for s in long:
        v = (v @ a) * emit[s]
        log += math.log(v.sum())
        v /= v.sum()
    assert np.isclose(seg.chain(*seg.transfers(a, emit), start)[0][0], log)


def test_scores(spark):
    rng = random.Random(1)
    voices = [[f"{v}{i}" for i in range(120)] for v in ("a", "b", "c")]
    docs = [(i, " ".join(rng.choice(voices[i % 3]) for _ in range(rng.choice([0, 5, 80, 200])))) for i in range(400)]
    docs += [(1000, None), (1001, "Unseen WORDS\x0bhere"), (5, "again"), (None, "null id")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = score_texts(d, symbols=1024, chunk_tokens=3000).collect()
    assert len(rows) == len(docs)
    toks = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), 0]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(x for i, t in docs if not out(i) for x in toks(t))
    n, v = sum(c.values()), len(c)
    texts = dict(docs)
    for r in rows:
        if r.doc_id in (5, None):
            continue
        w = toks(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-6 * len(w)
    held = [r for r in rows if r.held_out and r.n_tokens > 20]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)
    assert score_texts(d.limit(0), symbols=1024).count() == 0


def test_training_iterates_over_all_documents(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, prose(rng, 40)) for i in range(150)]
    sums, models = [], []

    def recorded_sums(*args, add=hidden_markov.sum_vectors):
        sums.append(add(*args))
        return sums[-1]

    def recorded_train(chunks, class_counts, states, symbols, fit=hidden_markov.train):
        models.append((class_counts, fit(chunks, class_counts, states, symbols)))
        return models[-1][1]

    monkeypatch.setattr(hidden_markov, "sum_vectors", recorded_sums)
    monkeypatch.setattr(hidden_markov, "train", recorded_train)
    states, symbols = 3, 64
    score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), states=states, symbols=symbols)
    (class_counts, (start, _, emit)), = models
    parts = [np.split(x[: states + states * states + (symbols + 1) * states], [states, states + states * states]) for x in sums]
    whole = [abs(out.sum() - class_counts.sum()) < 1e-6 * class_counts.sum() for _, _, out in parts]
    assert sum(whole) >= 3 and whole[-1]
    # the last parameters are those of the last iteration's counts alone
    starts, _, out = parts[-1]
    assert abs(starts.sum() - class_counts[symbols]) < 1e-6 * starts.sum()
    assert np.allclose(start, (starts + 0.1) / (starts + 0.1).sum())
    overall = (class_counts + 0.5) / (class_counts + 0.5).sum()
    out = out.reshape(symbols + 1, states) + 500 * overall[:, None]
    assert np.allclose(emit, out / out.sum(0))


def test_saturated_lists_lose_no_links(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=16) * 4 + rng.normal(size=(150, 16)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    leaders = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "v long, x binary")
    got = {(r.u, r.v) for r in descend(leaders, 16, 0.95, Scratch(spark, "saturated"), rounds=1).filter("sim >= 0.95").collect()}
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.95), strict=True) if i != j}
    assert len(want) > 150 * 100 and all((j, i) in got or (i, j) in got for i, j in want)


def test_groups_whose_lists_have_room_lose_no_links(spark):
    rng = np.random.default_rng(8)
    groups = [rng.normal(size=32) * 4 + rng.normal(size=(n, 32)) * 0.3 for n in (90, 60, 40)]
    x = np.concatenate([*groups, rng.normal(size=(600, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    leaders = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "v long, x binary")
    got = {(r.u, r.v) for r in descend(leaders, 32, 0.95, Scratch(spark, "room"), recall=0).filter("sim >= 0.95").collect()}
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.95), strict=True) if i != j}
    assert len(want) > 10_000 and all((j, i) in got or (i, j) in got for i, j in want)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for size in [1] * 60 + [2, 3, 40, 120]:
        base = rng.normal(size=16)
        for _ in range(size):
            rows.append(base + rng.normal(size=16) * (0.06 if size < 100 else 0.09))
    rows += [rows[0].copy(), rows[5] * 3]
    vectors = [(i, x.tolist()) for i, x in enumerate(rows)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, []), (905, [float("inf")] * 16)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    parent = list(range(len(x)))
    for i, j in np.argwhere(link):
        a, b = i, j
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    want = {i: (int(link[i].sum()), find(i), find(i) == i) for i in range(len(x))} | {i: (0, i, True) for i, _ in odd}
    missed = sum(want[i][0] - got[i][0] for i in want)
    assert all(got[i][0] <= want[i][0] for i in want) and missed <= 0.02 * link.sum()
    assert sum(got[i][1] != want[i][1] for i in want) <= 0.02 * len(want)
    assert near_vectors(df.limit(0)).count() == 0


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(260):
        bad = i % 9 == 0
        docs.append((i, junk(rng) if bad else prose(rng, 60) + ".\n" + prose(rng, 30) + ".", "en", f"s{i % 4}", 0))
        labels.append((i, int(not bad), 0))
    leak = prose(rng, 25)
    docs += [(500, docs[1][1], "en", "s1", 0), (501, prose(rng, 40) + " " + leak + " " + prose(rng, 20), "en", "s1", 0)]
    docs += [(510 + k, prose(rng, 50) + "\nthis very line repeats in four documents\n" + prose(rng, 20), "en", "s2", 0) for k in range(4)]
    docs = [(i, t, lang, s, len(t)) for i, t, lang, s, _ in docs]
    path = "file://" + str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    return path


def test_pipeline(spark, corpus):
    import corpus_pipeline

    docs = spark.read.parquet(corpus + "/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = docs.checkpoint() if spark.sparkContext.getCheckpointDir() else spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    clean = {i for i in range(260) if i % 9} | {500, 501, 510, 511, 512, 513}
    assert set(kept["quality"]) == clean
    assert "this very line" in kept["line_dedup"][513].text and "this very line" not in kept["line_dedup"][510].text
    assert kept["line_dedup"][510].n_chars == len(kept["line_dedup"][510].text)
    assert set(kept["near_dedup"]) == clean - {500} and set(kept["decontaminate"]) == clean - {500, 501}
    rows = corpus_pipeline.run(spark, corpus).collect()
    assert {r.doc_id for r in rows} == clean - {500, 501} and all(r.length <= 2048 for r in rows)


def test_stages_of_odd_tables(spark, corpus):
    import corpus_pipeline

    rng = random.Random(3)
    same = prose(rng, 40) + "."
    rows = [(1, prose(rng, 60) + ".", "en", "s0", 0, "a", 7, 0.5), (None, same, "en", "s1", 0, "b", 7, 0.5), (2, same, None, None, 0, None, None, None), (3, same, "en", "s1", 0, "c", 7, 0.5), (4, None, "en", "s1", 0, "d", 1, 0.1), (5, "", "en", "s1", 0, "e", 1, 0.1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_lines int, quality double"
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame(rows, schema).repartition(2)
    for name in ("quality", "line_dedup", "near_dedup", "decontaminate"):
        out = stages[name](spark, docs, corpus)
        assert out.columns == docs.columns
        got = {(r.doc_id, r.kept, r.n_lines, r.quality) for r in out.collect()}
        assert got <= {(r[0], r[5], r[6], r[7]) for r in rows}
        if name == "line_dedup":  # three documents have the same only line, which the largest id keeps
            assert {g[0] for g in got} == {1, 3, 4, 5}
        else:
            assert None in {g[0] for g in got}
        if name == "near_dedup":  # of equal texts the smallest id stays, and the row that no verdict can name
            assert {g[0] for g in got} == {1, 2, None, 4, 5}
        assert stages[name](spark, docs.limit(0), corpus).count() == 0
    assert {r.doc_id for r in stages["packing"](spark, docs, corpus).collect()} == {1, 2, 3, 4, 5, None}
