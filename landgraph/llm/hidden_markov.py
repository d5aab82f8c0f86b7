"""Language-model scoring with a hidden Markov model.

The model: a chain of `states` latent states emits one symbol for each word, the word's hash
class out of `symbols`, or the end of the text; a class emits its words by their share of the
class' training tokens, with one share left for words never seen. Every word's training count
therefore enters its score, whatever the corpus' size, while the chain's parameters stay
bounded and carry what the surroundings say (language, register). With one state the model is
a unigram model.

Documents are read once into chunks of whole texts: the chunk's distinct words (64-bit hashes)
and its tokens as indices into them. Word counts are summed over chunks by a shuffle of
distinct words only, and each chunk gets back its words' counts. Baum-Welch starts with a few
steps on small disjoint folds of the training documents, whose counts are not kept, and then
iterates over all training documents, every iteration taking its parameters from the whole
sums; each task sums its expected counts over its chunks and the sums are added in slices. Likelihoods are exact over whole texts:
texts of some length are run side by side, a vector each; longer ones are cut into segments, whose transfer
matrices are multiplied with scaling, then chained for each document.

Null texts are empty: one end token. A null id is training. Repeated rows are scored, and
counted, each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgraph.llm.common import Scratch, slices, sum_vectors
from landgraph.llm.hashing import word_slices

PARTS, SEGMENT, FOLDS = 64, 64, 64
WHOLE = 1024  # texts of up to so many tokens are not cut into segments
RESCALE = 4  # steps between two scalings of a vector
WARM = ((0, 1), (1, 2), (2, 4), (4, 6))  # folds of the first steps
ITERATIONS = 5  # over all folds


def _chunks(id_type: pa.DataType, chunk_tokens: int):
    def pack(no: int, held: list[tuple]) -> pa.RecordBatch:
        h = np.concatenate([x[3] for x in held])
        vocabulary, tokens = np.unique(h, return_inverse=True)
        lengths = np.array([len(x[3]) for x in held], np.int32)
        train = np.repeat([not x[1] for x in held], lengths)
        counts = np.bincount(tokens[train], minlength=len(vocabulary)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(TaskContext.get().partitionId() << 32) + no], pa.int64()),
                pa.array([[x[0] for x in held]], pa.list_(id_type)),
                pa.array([[x[1] for x in held]], pa.list_(pa.bool_())),
                pa.array([[x[2] for x in held]], pa.list_(pa.int32())),
                pa.array([lengths.tolist()], pa.list_(pa.int32())),
                pa.array([vocabulary.tobytes()], pa.binary()),
                pa.array([tokens.astype(np.uint32).tobytes()], pa.binary()),
                pa.array([counts.tobytes()], pa.binary()),
            ],
            ["chunk", "ids", "held", "folds", "lengths", "vocabulary", "tokens", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, no = [], 0, 0
        for b in batches:
            ids, out, folds = (b.column(i).to_pylist() for i in (0, 1, 2))
            for words in word_slices(b.column(3)):
                for d in range(words.docs):
                    h = words.hash[words.bounds[d] : words.bounds[d + 1]]
                    k = words.first + d
                    held.append((ids[k], out[k], folds[k], h.copy()))
                    size += len(h) + 1
                    if size >= chunk_tokens:
                        yield pack(no, held)
                        held, size, no = [], 0, no + 1
        if held:
            yield pack(no, held)

    return run


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for chunk, vocabulary, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            h, n = np.frombuffer(vocabulary.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.int32)
            for lo in range(0, len(h), 50_000):
                part = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[part]), chunk)), pa.array(np.arange(lo, lo + len(h[part]), dtype=np.int32)), pa.array(h[part]), pa.array(n[part])], ["chunk", "place", "h", "n"])


class Segments:
    """Symbols of some documents cut into segments, longest first; documents of up to WHOLE symbols are a segment each."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        starts = np.cumsum(lengths) - lengths
        longest = int(lengths.max(initial=1))
        self.steps = longest if longest <= WHOLE else SEGMENT
        per_doc = -(-lengths // self.steps)
        self.n_docs, self.per_doc = len(lengths), per_doc
        doc = np.repeat(np.arange(len(lengths)), per_doc)
        first = np.cumsum(per_doc) - per_doc
        rank = np.arange(len(doc)) - first[doc]
        begin = starts[doc] + rank * self.steps
        size = np.minimum(self.steps, starts[doc] + lengths[doc] - begin)
        self.order = np.argsort(-size, kind="stable")  # place in the sorted order -> segment
        self.back = np.empty_like(self.order)
        self.back[self.order] = np.arange(len(doc))
        self.size, at = size[self.order], begin[self.order]
        self.running = np.searchsorted(-self.size, -np.arange(self.steps + 1), side="left")
        self.symbols = np.zeros((self.steps, len(doc)), np.int64)
        for t in range(self.steps):
            n = self.active(t)
            self.symbols[t, :n] = symbols[at[:n] + t]
        self.first = first
        self.by_segments = np.argsort(-per_doc, kind="stable")

    def active(self, t: int) -> int:
        return int(self.running[t])

    def said(self, t: int) -> np.ndarray:
        """The symbols of step t."""
        return self.symbols[t, : self.active(t)]

    def forward(self, v: np.ndarray, a: np.ndarray, emit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """For each step the scaled forward vectors behind it, of the segments that have it, and the scales, or None where all are 1."""
        ones = np.ones(len(a), a.dtype)
        for t in range(self.steps):
            v, scale = (v[: self.active(t)] @ a) * np.take(emit, self.said(t), axis=0), None
            if t % RESCALE == RESCALE - 1:
                scale = v @ ones
                v /= scale[:, None]
            yield v, scale

    def likelihood(self, start: np.ndarray, a: np.ndarray, emit: np.ndarray) -> np.ndarray:
        """Log likelihood of each document."""
        if self.steps == SEGMENT:
            return self.chain(*self.transfers(a, emit), start)[0]
        logs, last = np.zeros(len(self.size)), np.broadcast_to(start, (len(self.size), len(start))).copy()
        for v, scale in self.forward(last, a, emit):
            last[: len(v)] = v
            if scale is not None:
                logs[: len(v)] += np.log(scale)
        out = np.zeros(self.n_docs)
        out[self.per_doc > 0] = (logs + np.log(last.sum(1)))[self.back[self.first[self.per_doc > 0]]]
        return out

    def transfers(self, a: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled products of A diag(b) over each segment, and the logs of the scales."""
        n, s = len(self.size), len(a)
        # kept transposed, state by state, so that a step is one product with a few long rows
        m = np.broadcast_to(np.eye(s, dtype=a.dtype)[:, None, :], (s, n, s)).copy()
        flat, step, back = m.reshape(s, n * s), np.empty((s, n * s), a.dtype), np.ascontiguousarray(a.T)
        logs = np.zeros(n)
        for t in range(self.steps):
            k = self.active(t)
            if not k:
                break
            np.matmul(back, flat[:, : k * s], out=step[:, : k * s])
            likely = np.ascontiguousarray(emit[self.said(t)].T)
            np.multiply(step.reshape(s, n, s)[:, :k], likely[:, :, None], out=m[:, :k])
            if t % 8 == 7 or t == self.steps - 1:
                top = m[:, :k].max(axis=(0, 2))
                m[:, :k] /= top[None, :, None]
                logs[:k] += np.log(top)
        return np.ascontiguousarray(m.transpose(1, 2, 0)), logs

    def chain(self, m: np.ndarray, logs: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each document, and the scaled forward vector before each segment."""
        v = np.broadcast_to(start, (self.n_docs, len(start))).copy()
        total, before = np.zeros(self.n_docs), np.empty((len(m), len(start)), m.dtype)
        for k in range(int(self.per_doc.max(initial=0))):
            docs = self.by_segments[: np.searchsorted(-self.per_doc[self.by_segments], -k, side="left")]
            at = self.back[self.first[docs] + k]
            before[at] = v[docs]
            nxt = np.einsum("ns,nst->nt", v[docs], m[at])
            scale = nxt.sum(1)
            v[docs] = nxt / scale[:, None]
            total[docs] += np.log(scale) + logs[at]
        return total, before

    def after(self, m: np.ndarray) -> np.ndarray:
        """The scaled backward vector behind each segment."""
        out = np.empty((len(m), m.shape[1]), m.dtype)
        v = np.ones((self.n_docs, m.shape[1]), m.dtype)
        for k in range(int(self.per_doc.max(initial=0)) - 1, -1, -1):
            docs = self.by_segments[: np.searchsorted(-self.per_doc[self.by_segments], -k, side="left")]
            at = self.back[self.first[docs] + k]
            out[at] = v[docs]
            nxt = np.einsum("nst,nt->ns", m[at], v[docs])
            v[docs] = nxt / nxt.max(1, keepdims=True)
        return out


def expected_counts(seg: Segments, start: np.ndarray, a: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Baum-Welch sums: start (S), transitions (S x S), emissions (S x symbols), one vector."""
    s, n_symbols = len(a), len(emit)
    n = len(seg.size)
    if seg.steps == SEGMENT:
        m, logs = seg.transfers(a, emit)
        _, before = seg.chain(m, logs, start)
        beta = seg.after(m)
    else:
        before, beta = np.broadcast_to(start, (n, s)), np.ones((n, s), a.dtype)
    alpha, scales = [before], []
    for v, scale in seg.forward(before, a, emit):
        alpha.append(v)
        scales.append(scale)
    moves, out, ones = np.zeros((s, s)), np.empty((n_symbols, s)), np.ones(s, a.dtype)
    said, share, done = np.empty(int(seg.size.sum()), np.int64), np.empty((int(seg.size.sum()), s), a.dtype), 0
    starts = np.zeros(s)
    is_first = np.zeros(n, bool)
    is_first[seg.back[seg.first[seg.per_doc > 0]]] = True
    for t in range(seg.steps - 1, -1, -1):
        k = seg.active(t)
        if not k:
            continue
        sym = seg.said(t)
        b = beta[:k]
        q = np.take(emit, sym, axis=0) * b
        p = alpha[t][:k]
        back = q @ a.T
        both = alpha[t + 1] * b
        norm = both @ ones
        np.divide(both, norm[:, None], out=share[done : done + k])
        said[done : done + k] = sym
        done += k
        norm = (norm if scales[t] is None else norm * scales[t])[:, None]
        moves += (p / norm).T @ q
        if t == 0:
            first = is_first[:k]
            starts += (p[first] * back[first] / norm[first]).sum(0)
        beta[:k] = back / (back @ ones)[:, None] if t % RESCALE == 0 else back
    for i in range(s):
        out[:, i] = np.bincount(said, share[:, i], minlength=n_symbols)
    return np.concatenate([starts, (moves * a).ravel(), out.ravel()])


def _docs_of(row: dict, wanted: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some documents of a chunk by length, in groups: which they are, their symbols (with the end) and lengths."""
    lengths = np.asarray(row["lengths"], np.int64)
    classes = (np.frombuffer(row["vocabulary"], np.uint64) % np.uint64(symbols)).astype(np.int32)
    said = classes[np.frombuffer(row["tokens"], np.uint32)]
    starts = np.cumsum(lengths) - lengths
    wanted = wanted[np.argsort(lengths[wanted], kind="stable")]
    for part in _groups(lengths[wanted] + 1):
        some = wanted[part]
        full = lengths[some] + 1
        out = np.full(full.sum(), symbols, np.int32)
        ends = np.cumsum(full) - 1
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside] = said[np.repeat(starts[some] - np.cumsum(full - 1) + full - 1, full - 1) + np.arange((full - 1).sum())]
        yield some, out, full


def _groups(lengths: np.ndarray, tokens: int = 160_000) -> Iterator[slice]:
    """Runs of ascending lengths of about so many tokens, whose data stay in a core's cache, parted where segments begin."""
    ends, lo, short = np.cumsum(lengths), 0, int(np.searchsorted(lengths, WHOLE, side="right"))
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + tokens)))
        hi = min(hi, short) if lo < short else hi
        yield slice(lo, hi)
        lo = hi


def _expect(shared, lo: int, hi: int, symbols: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, a, emit = shared.value
        # posteriors do not change with a symbol's scale; relative to its largest, emissions fit single precision
        start, a, emit = (x.astype(np.float32) for x in (start, a, emit / emit.max(1, keepdims=True)))
        sums, some = np.zeros(width), False
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1).to_pylist()[0]
                folds, held = np.asarray(row["folds"]), np.asarray(row["held"])
                wanted = np.flatnonzero((folds >= lo) & (folds < hi) & ~held)
                for _, said, lengths in _docs_of(row, wanted, symbols):
                    got = expected_counts(Segments(said, lengths), start, a, emit)
                    sums[: len(got)] += got
                    some = True
        if some:
            yield slices(sums, PARTS)

    return run


def train(chunks: DataFrame, class_counts: np.ndarray, states: int, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, transitions, emissions) after the warm start and the iterations; class_counts has the end's count last."""
    rng = np.random.default_rng(3)
    overall = (class_counts + 0.5) / (class_counts + 0.5).sum()
    emit = overall[:, None] * np.exp(rng.normal(0, 0.7, (symbols + 1, states)))
    emit /= emit.sum(0)
    a = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    start = np.full(states, 1 / states)
    size = states + states * states + (symbols + 1) * states
    width = -(-size // PARTS) * PARTS
    for lo, hi in (*WARM, *[(0, FOLDS)] * ITERATIONS):
        shared = chunks.sparkSession.sparkContext.broadcast((start, a, emit))
        sums = sum_vectors(chunks.select("folds", "held", "lengths", "vocabulary", "tokens").mapInArrow(_expect(shared, lo, hi, symbols, width), "part int, data binary"), width, "float64")[:size]
        starts, moves, out = np.split(sums, [states, states + states * states])
        start = (starts + 0.1) / (starts + 0.1).sum()
        moves = moves.reshape(states, states) + 0.01 + 1.0 * np.eye(states)
        a = moves / moves.sum(1, keepdims=True)
        out = out.reshape(symbols + 1, states) + 500 * overall[:, None]
        emit = out / out.sum(0)
    return start, a, emit


def _judge(shared, symbols: int, id_type: pa.DataType):
    def run(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        (start, a, emit), class_counts, class_words, n, v, n_docs = shared.value
        row = chunk.to_pylist()[0]
        lengths, tokens = np.asarray(row["lengths"], np.int64), np.frombuffer(row["tokens"], np.uint32)
        vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        c = np.zeros(len(vocabulary))
        c[counts["place"].to_numpy()] = counts["c"].to_numpy()
        classes = (vocabulary % np.uint64(symbols)).astype(np.int64)
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        share = np.log10((c + 0.1) / (class_counts[classes] + 0.1 * (class_words[classes] + 1)))
        end = np.log10((n_docs + 0.1) / (n + 0.1 * (v + 1)))
        doc = np.repeat(np.arange(len(lengths)), lengths)
        by_doc = lambda x: np.bincount(doc, x[tokens], minlength=len(lengths))
        # emissions relative to the symbol's largest, whose log is added back for each token
        top = emit.max(1)
        chain = np.zeros(len(lengths))
        relative = emit / top[:, None]
        for some, said, full in _docs_of(row, np.arange(len(lengths)), symbols):
            chain[some] = Segments(said, full).likelihood(start, a, relative)
        log_top = np.log(top)
        chain += by_doc(log_top[classes]) + log_top[symbols]
        columns = {
            "id": pa.array(row["ids"], id_type),
            "held_out": pa.array(row["held"], pa.bool_()),
            "n_tokens": pa.array(lengths + 1, pa.int64()),
            "n_known": pa.array((by_doc((c > 0).astype(float)) + (n_docs > 0)).astype(np.int64)),
            "base_score": pa.array(by_doc(base) + end),
            "score": pa.array(by_doc(share) + chain / np.log(10)),
        }
        return pa.table(columns)

    return run


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", states: int = 8, symbols: int = 16_384, chunk_tokens: int = 1_600_000) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score); scores are log10 probabilities."""
    scratch = Scratch(docs.sparkSession, "hmm")
    digest = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(digest % 10 == 0, F.lit(False)).alias("held"), F.coalesce((digest / 10).cast("long") % FOLDS, F.lit(0)).cast("int").alias("fold"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    schema = f"chunk long, ids array<{kind}>, held array<boolean>, folds array<int>, lengths array<int>, vocabulary binary, tokens binary, counts binary"
    chunks = scratch.save(rows.mapInArrow(_chunks(id_type, chunk_tokens), schema), "chunks")
    words = chunks.select("chunk", "vocabulary", "counts").mapInArrow(_vocabulary, "chunk long, place int, h long, n int")
    # sums of a word's counts meet its rows in a join, not in a window: a frequent word may be split
    sums = scratch.save(words.groupBy("h").agg(F.sum("n").alias("c")), "sums")
    counts = scratch.save(words.select("chunk", "place", "h").join(sums.filter("c > 0"), "h").select("chunk", "place", "c"), "counts")
    symbol = F.pmod(F.col("h"), F.lit(symbols)).cast("int").alias("symbol")
    per_class = sums.filter("c > 0").groupBy(symbol).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("new")).collect()  # `symbols` rows at most
    class_counts, class_words = np.zeros(symbols + 1), np.zeros(symbols + 1)
    for r in per_class:
        class_counts[r.symbol], class_words[r.symbol] = r.n, r.new
    n_docs = chunks.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    n, v = int(class_counts.sum()) + n_docs, int(class_words.sum()) + (n_docs > 0)
    class_counts[symbols] = n_docs
    model = train(chunks, class_counts, states, symbols)
    shared = docs.sparkSession.sparkContext.broadcast((model, class_counts, class_words, n, v, n_docs))
    out = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = chunks.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_judge(shared, symbols, id_type), out)
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
