"""Quality classification with hierarchical empirical Bayes over sites.

A document classifier (logistic regression on text statistics) gives each document the odds of
good quality, a second one those of toxicity from a lexicon of words and word beginnings that
its labelled examples over-represent. Grouped aggregation over hosts and paths of hosts turns
the documents' probabilities into posteriors of each site: a host's rate is shrunk toward the
global rate, a path's toward its host's, by Beta priors whose strength is estimated from the
variance between sites (method of moments), so sparse sites stay near the prior and large
ones speak for themselves. A document's posterior odds are its evidence times its path's odds.
The path's rate, the host's that it is shrunk toward, and the global rate behind that all leave
the document itself out, so its evidence counts once, also where a site has few documents.

Both classifiers are fitted on at most `max_labels` labelled documents, picked by a hash of
their id, whatever the corpus' size; site counts cover all documents.

Null texts are empty. Null hosts and paths are sites of their own. Repeated rows count and
are scored each for itself, a null id like any other. Labels for unknown ids are ignored;
without labels of both classes a classifier says nothing and every document is kept by it.
Texts are read whole, however long; an empty table gives an empty result; other columns,
whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgraph.llm.common import Scratch
from landgraph.llm.hashing import Words, mix, word_slices

FEATURES = 20
_kinds = {
    "upper": list(range(65, 91)),
    "lower": list(range(97, 123)),
    "digit": list(range(48, 58)),
    "stop": [ord(c) for c in ".,;:?"],
    "loud": [ord("!")],
    "bar": [ord("|")],
    "symbol": [ord(c) for c in "#$%&*@^~<>{}[]\\/_=+"],
    "newline": [10],
    "high": list(range(128, 256)),
}
TABLES = {k: np.isin(np.arange(256), v) for k, v in _kinds.items()}


def text_statistics(words: Words) -> np.ndarray:
    """One row of FEATURES statistics for each text of a slice."""
    n, size = words.docs, np.diff(words.ends)
    out = np.zeros((n, FEATURES))
    count = np.diff(words.bounds)
    safe_size, safe = np.maximum(size, 1), np.maximum(count, 1)
    out[:, 0], out[:, 1] = np.log1p(count), np.log1p(size)
    for k, table in enumerate(TABLES.values()):
        sums = np.concatenate([[0], np.cumsum(table[words.data])])
        out[:, 2 + k] = (sums[words.ends[1:]] - sums[words.ends[:-1]]) / safe_size
    length = words.end - words.start
    out[:, 11] = np.bincount(words.doc, length, minlength=n) / safe
    order = np.lexsort((words.hash, words.doc))
    h, doc = words.hash[order], words.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    runs, run_doc = np.diff(np.append(at, len(h))), doc[at]
    most = np.zeros(n)
    np.maximum.at(most, run_doc, runs)
    distinct = np.bincount(run_doc, minlength=n)
    out[:, 12], out[:, 13] = distinct / safe, most / safe
    # distinct words expected of so long a text grow slower than its length
    out[:, 14] = np.log1p(distinct) - 0.8 * np.log1p(count)
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    out[:, 15] = np.bincount(words.doc, same, minlength=n) / safe
    single = length == 1
    out[:, 16] = np.bincount(words.doc, single, minlength=n) / safe
    last = words.data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    out[:, 17] = np.bincount(words.doc, last == ord("."), minlength=n) / safe
    out[:, 18] = np.bincount(words.doc, TABLES["symbol"][last] | TABLES["loud"][last], minlength=n) / safe
    h5, doc5, _ = words.shingles(5)
    order = np.lexsort((h5, doc5))
    h5, doc5 = h5[order], doc5[order]
    again = np.zeros(len(h5), bool)
    again[1:] = (h5[1:] == h5[:-1]) & (doc5[1:] == doc5[:-1])
    out[:, 19] = np.bincount(doc5, again, minlength=n) / np.maximum(np.bincount(doc5, minlength=n), 1)
    return out


def tokens_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of words without edge punctuation, and of their first four and six bytes."""
    hashes, docs = [], []
    end = words.end.copy()
    letters = ~np.isin(np.arange(256), [ord(c) for c in ".,;:!?\"'()"])
    for _ in range(3):
        end -= (words.start < end) & ~letters[words.data[end - 1]]
    for width, salt in ((1 << 20, 0), (4, 4), (6, 6)):
        stop = np.minimum(end, words.start + width)
        full = (stop > words.start) & ((end - words.start > width) if salt else True)
        hashes.append(mix((words.sums[stop] - words.sums[words.start]) * words.down[words.start] + np.uint64(salt))[full])
        docs.append(words.doc[full])
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> dict:
    """Penalised logistic regression on standardised columns, by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    z = np.clip(z, -8, 8)
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z * s[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "scale": scale, "w": w}


def logit(model: dict | None, x: np.ndarray, otherwise: float) -> np.ndarray:
    if model is None:
        return np.full(len(x), otherwise)
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    return np.clip(model["w"][0] + z @ model["w"][1:], -30, 30)


def expanded(x: np.ndarray) -> np.ndarray:
    """Statistics, their squares, and the fractions' square roots, so that both tails count."""
    return np.hstack([x, np.sqrt(np.abs(x[:, 2:])), np.minimum(np.abs(x[:, 2:]), 10) ** 2])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [text_statistics(words) for words in word_slices(b.column(0))]
        x = np.vstack(rows) if rows else np.zeros((0, FEATURES))
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], ["quality", "toxic", "x"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        toxic = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for words in word_slices(b.column(0)):
            doc, h = tokens_of(words)
            keys, inverse = np.unique(h, return_inverse=True)
            bad = np.bincount(inverse, toxic[doc + words.first], minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(bad), pa.array(np.bincount(inverse, minlength=len(keys)).astype(np.int64))], ["h", "bad", "n"])


def lexicon_evidence(words: Words, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each text, (sum, largest weight, number) of the lexicon entries that it holds."""
    out = np.zeros((words.docs, 3))
    if len(keys):
        doc, h = tokens_of(words)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        w = weights[at[hit]]
        out[:, 0] = np.bincount(doc[hit], w, minlength=words.docs)
        np.maximum.at(out[:, 1], doc[hit], w)
        out[:, 2] = np.bincount(doc[hit], minlength=words.docs)
    return out


def _lexicon_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights = shared.value
        for b in batches:
            rows = [lexicon_evidence(words, keys, weights) for words in word_slices(b.column(0))]
            x = np.vstack(rows) if rows else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 3).cast(pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quality, toxic, (keys, weights) = shared.value
        for b in batches:
            good, bad = [np.zeros(0)], [np.zeros(0)]
            for words in word_slices(b.column(0)):
                good.append(logit(quality, expanded(text_statistics(words)), 0.0))
                bad.append(logit(toxic, lexicon_evidence(words, keys, weights), -30.0))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.concatenate(good)), pa.array(np.concatenate(bad))], [*b.schema.names[1:], "evidence", "toxic_logit"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, max_labels: int, lexicon_size: int = 4000) -> tuple:
    """(quality model, toxicity model, lexicon, share of good documents among the labelled)."""
    spark = docs.sparkSession
    picked = labels.select(F.col(id_col).alias("__id"), F.col("quality").cast("int").alias("quality"), F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("toxic"))
    picked = picked.filter("__id is not null and quality is not null").orderBy(F.xxhash64("__id"), "__id").limit(max_labels)
    kind = dict(picked.dtypes)["__id"]
    # at most max_labels rows of three numbers, so a broadcast of a bounded size
    held = spark.createDataFrame([tuple(r) for r in picked.collect()], f"__id {kind}, quality int, toxic int")
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(held), "__id")
    rows = sample.select("text", "quality", "toxic").mapInArrow(_labelled, "quality int, toxic int, x array<double>").toPandas()
    quality = toxic = None
    rate = float(rows.quality.mean()) if len(rows) else 0.5
    if rows.quality.nunique() > 1:
        quality = fit_logistic(expanded(np.vstack(rows.x.to_list())), rows.quality.to_numpy(float))
    lexicon = (np.zeros(0, np.uint64), np.zeros(0))
    if len(rows) and rows.toxic.nunique() > 1:
        n_bad, n = int(rows.toxic.sum()), len(rows)
        counts = sample.select("text", "toxic").mapInArrow(_tokens, "h long, bad long, n long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
        weight = F.log(((F.col("bad") + 0.1) / n_bad) / ((F.col("n") - F.col("bad") + 0.1) / (n - n_bad)))
        top = counts.filter("bad >= 5").withColumn("w", weight).filter("w > 2.5").orderBy(F.desc(F.col("w") * F.sqrt("bad")), "h").limit(lexicon_size).collect()
        keys, weights = np.array([r.h for r in top], np.int64).view(np.uint64), np.array([r.w for r in top])
        order = np.argsort(keys)
        lexicon = (keys[order], weights[order])
        seen = sample.select("text", "toxic").mapInArrow(_lexicon_rows(spark.sparkContext.broadcast(lexicon)), "toxic int, x array<double>").toPandas()
        toxic = fit_logistic(np.vstack(seen.x.to_list()), seen.toxic.to_numpy(float))
    return quality, toxic, lexicon, min(max(rate, 1e-3), 1 - 1e-3)


def shrunk(sites: DataFrame, prior: str, fallback: float) -> DataFrame:
    """Adds `rate`: (k * prior + good) / (k + n), and `k`, from the variance between sites beyond chance."""
    gap = (F.col("good") / F.col("n") - F.col(prior)) ** 2
    chance = F.col(prior) * (1 - F.col(prior))
    s = sites.filter("n >= 2").agg(F.sum(F.col("n") * gap).alias("gap"), F.sum(chance).alias("noise"), F.sum("n").alias("n"), F.sum(F.col("n") * chance).alias("chance")).first()
    between = max(0.0, (s.gap or 0.0) - (s.noise or 0.0)) / max(1, s.n or 0)
    inside = (s.chance or 0.0) / max(1, s.n or 0)
    k = min(1e6, max(1.0, inside / between - 1)) if between > 0 else fallback
    return sites.withColumns({"rate": (F.lit(k) * F.col(prior) + F.col("good")) / (F.lit(k) + F.col("n")), "k": F.lit(float(k))})


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", max_labels: int = 20_000, quality_cut: float = 0.5, toxic_cut: float = 0.5
) -> DataFrame:
    """Rows (id, quality, toxic, host_rate, path_rate, kept) with the columns' posterior probabilities.

    kept: quality >= quality_cut and toxic < toxic_cut.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "quality")
    quality, toxic, lexicon, rate = fit(docs, labels, id_col=id_col, text_col=text_col, max_labels=max_labels)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))
    kind = dict(rows.dtypes)["id"]
    rows = rows.mapInArrow(_score(spark.sparkContext.broadcast((quality, toxic, lexicon))), f"id {kind}, host string, path string, evidence double, toxic_logit double")
    out = posteriors(scratch.save(rows, "scored"), rate, scratch)
    out = out.withColumn("kept", (F.col("quality") >= quality_cut) & (F.col("toxic") < toxic_cut))
    return out.select(F.col("id").alias(id_col), "quality", "toxic", "host_rate", "path_rate", "kept")


def posteriors(rows: DataFrame, rate: float, scratch: Scratch) -> DataFrame:
    """Rows (id, host, path, evidence, toxic_logit) with quality, toxic, host_rate and path_rate; `rate` is the share of good labels.

    A document's host_rate and path_rate are those of its host and path without the document itself:
    it is taken out of the sums of all three levels. The priors' strengths, one number a level, are estimated
    from all sites. The only document of all has `rate` as its global rate.
    """
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = scratch.save(rows.groupBy("host", "path").agg(F.sum(p).alias("good"), F.count(F.lit(1)).alias("n")), "paths")
    total = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    overall = (total.good / total.n) if total.n else rate
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).withColumn("overall", F.lit(float(overall)))
    hosts = shrunk(hosts, "overall", 1e6)
    hosts = hosts.select(F.col("host").alias("__host"), F.col("rate").alias("host_mean"), F.struct("good", "n", "k").alias("h"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("__host"))).drop("__host")
    paths = shrunk(paths, "host_mean", 1e6).select(F.col("host").alias("__host"), F.col("path").alias("__path"), "h", F.struct("good", "n", "k").alias("s"))
    paths = scratch.save(paths, "rates")
    out = rows.join(paths, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path")))
    without = lambda s, prior: (F.col(f"{s}.k") * prior + F.greatest(F.col(f"{s}.good") - p, F.lit(0.0))) / (F.col(f"{s}.k") + F.col(f"{s}.n") - 1)
    others = F.greatest(F.lit(float(total.good or 0.0)) - p, F.lit(0.0)) / F.lit(float(total.n - 1)) if (total.n or 0) > 1 else F.lit(float(rate))
    out = out.withColumn("host_rate", without("h", others))
    out = out.withColumn("path_rate", F.least(F.greatest(without("s", F.col("host_rate")), F.lit(1e-9)), F.lit(1 - 1e-9))).drop("h", "s")
    odds = F.col("evidence") - F.lit(float(np.log(rate / (1 - rate)))) + F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    return out.withColumns({"quality": 1 / (1 + F.exp(-odds)), "toxic": 1 / (1 + F.exp(-F.col("toxic_logit")))})
