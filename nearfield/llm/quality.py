"""Operator 10, quality and toxicity classifier on random-indexing word vectors.

Vectors: a word's index vector has four entries of +1 or -1 at places that its hash names; so has that of its first
five letters. Words in at least ``min_docs`` documents also have a context vector, the sum of the index vectors of their
neighbours, two to either side, over all documents; so the vocabulary grows with the corpus. Sums of all words are added
in a shuffle by word hash; the vectors lie in one file in the shared folder, which workers map and don't load. A word vector is the sum of its index vectors and
its context vector at unit length. A document is pooled three times: evenly, and weighted towards words that speak for
either label; the shapes of its words ("Aa", "A!", "0") and the share of immediate repetitions are pooled beside them.
A network of two layers gives two logits, and a temperature for each makes them calibrated probabilities.

At most ``max_labelled`` labelled documents, those with the least hash of doc_id, are used: half of them to weigh
words, the rest to train the network, but for a part on which temperatures are fitted. This bounds the training only;
context vectors come from all documents, and every text is read as a whole.

Cases: a null, empty or wordless text is pooled to zeros and gets the probabilities of these. A doc_id labelled more
than once has the lower quality and the higher toxicity; labels that are null, or whose doc_id is, are left out.
Without labels, or with all alike, the probability is their share (0.5 without any). Repeated rows are scored alike;
null doc_id passes through. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any, NamedTuple
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIM = 64
WINDOW = (-2, -1, 1, 2)
MIN_DOCS = 5  # a word in fewer documents has no context vector
MAX_LABELLED = 20_000
BUCKETS = 1 << 16
HIDDEN = 24
_BLOCKS = 16, 4096  # ranges of word hashes, least and most; one more for each _BLOCK_BYTES of documents
_BLOCK_BYTES = 8 << 20
_HELD = 150_000  # words whose parts are added up at once
_FLUSH = 400_000  # words a task holds before it passes them on
_ROWS = 10_000
_CHARS = 1_000_000
_SEED = [np.uint64(int(x)) for x in common.mix(np.arange(101, 109, dtype=np.uint64))]


class Vectors:
    """Sorted hashes of words and their context vectors at unit length, mapped from files; pickled by their path."""

    def __init__(self, n: int, path: str, sent: bool) -> None:
        self.n, self.path, self.sent = n, path, sent
        at = SparkFiles.get(os.path.basename(path)) if sent else path
        self.key = np.asarray(np.memmap(f"{at}.key", np.uint64, "r", shape=(n,))) if n else np.empty(0, np.uint64)
        self.context = np.asarray(np.memmap(f"{at}.context", np.float32, "r", shape=(n, DIM))) if n else np.empty((0, DIM), np.float32)

    def __reduce__(self) -> tuple:
        return Vectors, (self.n, self.path, self.sent)


class Model(NamedTuple):
    vectors: Vectors
    weight: np.ndarray  # buckets x 2: how much a word speaks for low quality, and for toxicity
    scale: tuple[np.ndarray, np.ndarray]  # mean and deviation of inputs
    net: list[np.ndarray]
    temperature: np.ndarray
    constant: np.ndarray  # a probability that holds for all, or nan


def _at(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place and sign of each of the four entries of the index vectors of h."""
    for k in range(4):
        x = common.mix(h ^ _SEED[k])
        yield (x % np.uint64(DIM)).astype(np.int64), np.where(x >> np.uint64(63), 1, -1).astype(np.int32)


def index_vectors(h: np.ndarray) -> np.ndarray:
    out = np.zeros((len(h), DIM), np.float32)
    rows = np.arange(len(h))
    for place, sign in _at(h):
        out[rows, place] += sign  # a row occurs once, so this adds up
    return out


def _find(key: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Row of each hash in key, -1 where it isn't there."""
    if not len(key):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(key, h), len(key) - 1)
    return np.where(key[at] == h, at, -1)


def contexts(w: common.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a batch's words, in how many of its texts each is, and the sum of what is around it."""
    h, row = np.unique(w.hash, return_inverse=True)
    total, count = np.zeros(len(h) * DIM, np.int32), np.zeros(len(h), np.int64)
    doc, n = common.of_doc(w.first), len(w.hash)
    order = np.argsort(row, kind="stable")
    r, d = row[order], doc[order]
    count += np.bincount(r[np.concatenate([[True], (r[1:] != r[:-1]) | (d[1:] != d[:-1])])[:n]], minlength=len(h))
    entries = list(_at(h))
    for o in WINDOW:
        lo, hi = max(0, -o), n - max(0, o)
        if hi <= lo:
            continue
        ok = np.flatnonzero(doc[lo:hi] == doc[lo + o : hi + o]) + lo
        near, own = row[ok + o], row[ok] * DIM
        total += np.bincount(np.concatenate([own + place[near] for place, _ in entries]), np.concatenate([sign[near] for _, sign in entries]), len(total)).astype(np.int32)
    return h, count, total.reshape(-1, DIM)


class _Sums:
    """Adds up parts of hashes, counts and vectors; parts wait until they are as many as what is there."""

    def __init__(self, kind: type) -> None:
        self.kind, self.parts, self.rows, self.most = kind, [], 0, _HELD

    def add(self, h: np.ndarray, count: np.ndarray, vec: np.ndarray) -> None:
        self.parts.append((h, count, vec))
        self.rows += len(h)
        if self.rows >= self.most:
            self.rows = len(self.get()[0])
            self.most = max(_HELD, 2 * self.rows)

    def get(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty((0, DIM), self.kind)
        h, count, vec = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        out = h[first], np.zeros(0, np.int64), np.zeros((0, DIM), self.kind)
        if len(h):
            out = h[first], np.add.reduceat(count[order], first), np.add.reduceat(vec[order], first, axis=0, dtype=self.kind)
        self.parts = [out]
        return out


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(blocks) >> np.uint64(24)).astype(np.int64)


def _pack(h: np.ndarray, count: np.ndarray, vec: np.ndarray) -> tuple[int, bytes]:
    """Size and compressed bytes; vectors of small numbers, which are nearly all, take a byte for each."""
    small = (np.abs(vec) < 128).all(1)
    order = np.argsort(~small, kind="stable")
    n = int(small.sum())
    raw = b"".join([np.array([n, len(h) - n]).tobytes(), h[order].tobytes(), count[order].astype(np.int64).tobytes(), vec[small].astype(np.int8).tobytes(), vec[~small].astype(np.int32).tobytes()])
    return len(raw), pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpack(size: int, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.Codec("zstd").decompress(packed, size, asbytes=True)
    a, b = np.frombuffer(raw, np.int64, 2).tolist()
    n, at = a + b, 16 + 16 * (a + b)
    small, large = np.frombuffer(raw, np.int8, a * DIM, at), np.frombuffer(raw, np.int32, b * DIM, at + a * DIM)
    return np.frombuffer(raw, np.uint64, n, 16), np.frombuffer(raw, np.int64, n, 16 + 8 * n), np.concatenate([small.astype(np.int32), large]).reshape(-1, DIM)


def _new_file(spark: SparkSession) -> tuple[str, bool]:
    """A path for the vectors, and whether the file has to be sent to the executors: only if the shared folder can't be mapped."""
    at = urlparse(common.shared_folder(spark))
    kind = at.scheme or urlparse(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")).scheme
    folder = f"{at.path}/nearfield-{spark.sparkContext.applicationId}" if kind == "file" else tempfile.mkdtemp(prefix="nearfield-")
    os.makedirs(folder, exist_ok=True)
    return f"{folder}/vectors-{uuid.uuid4().hex}", kind != "file"


def learn_vectors(docs: DataFrame, min_docs: float = MIN_DOCS) -> Vectors:
    """Context vectors of all words that are in at least min_docs documents, from all documents."""
    d = common.project(docs, ["text"])
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    grow = size // _BLOCK_BYTES if size < 1 << 55 else int(spark.conf.get("spark.sql.shuffle.partitions"))  # where the size isn't known
    blocks = min(max(_BLOCKS[0], grow), _BLOCKS[1])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            h, count, vec = sums.get()
            at = np.searchsorted(_block(h, blocks), np.arange(blocks + 1)).tolist()
            own = [(k, *_pack(h[lo:hi], count[lo:hi], vec[lo:hi])) for k, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if lo < hi]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["block", "size", "part"])

        sums = _Sums(np.int32)
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in common.slices(texts):
                sums.add(*contexts(common.words(texts[lo:hi])))
                if sums.rows >= _FLUSH and len(sums.get()[0]) >= _FLUSH:
                    yield packed()
                    sums = _Sums(np.int32)
        yield packed()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # parts are added as they come, so a task holds one sum, however many parts there are
        sums = _Sums(np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                sums.add(*_unpack(r["size"], r["part"]))
        h, count, vec = sums.get()
        keep = count >= min_docs
        h, vec = h[keep], vec[keep]
        # a piece lies within one block, so pieces don't overlap
        cuts = np.searchsorted(_block(h, blocks), np.arange(blocks + 1)).tolist()
        for lo, hi in ((i, min(i + _ROWS, e)) for s, e in zip(cuts[:-1], cuts[1:], strict=True) for i in range(s, e, _ROWS)):
            v = vec[lo:hi].astype(np.float32)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1)
            yield pa.RecordBatch.from_arrays([pa.array([int(h[lo] >> np.uint64(1))]), pa.array([hi - lo]), pa.array([h[lo:hi].tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["first", "n", "h", "v"])

    parts = d.mapInArrow(local, "block int, size bigint, part binary").repartitionById(blocks, "block")  # by hash, some tasks would get several ranges
    pieces = common.materialise(parts.mapInArrow(add, "first bigint, n bigint, h binary, v binary"), "contexts")
    path, sent = _new_file(spark)
    groups: list[list[int]] = []
    n = held = 0
    for r in pieces.select("first", "n").orderBy("first").collect():
        if not groups or held + r["n"] > _HELD:
            groups.append([r["first"], r["first"]])
            held = 0
        groups[-1][1], held, n = r["first"], held + r["n"], n + r["n"]
    with open(f"{path}.key", "wb") as key, open(f"{path}.context", "wb") as context:
        for lo, hi in groups:  # the driver holds one group at a time
            for r in sorted(pieces.filter(F.col("first").between(lo, hi)).collect(), key=lambda r: r["first"]):
                key.write(r["h"])
                context.write(r["v"])
    common.drop_table(pieces)
    if sent:
        spark.sparkContext.addFile(f"{path}.key")
        spark.sparkContext.addFile(f"{path}.context")
    return Vectors(n, path, sent)


def _shapes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shape of each word between blanks, and its text: runs of capitals, letters, digits and signs."""
    table = _shape_table()
    cps, begin = common.code_points(texts)
    cls = table[cps]
    cls = np.where(cls == 4, cps + np.uint32(16), cls)
    keep = np.concatenate([[True], cls[1:] != cls[:-1]]) if len(cls) else np.empty(0, bool)
    where = np.flatnonzero(keep)
    short = cls[where]
    inside = short != 0
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    after_end = np.append(np.flatnonzero(before & ~inside), [len(inside)] if len(inside) and inside[-1] else []).astype(np.int64)
    w = common._spans(short, np.searchsorted(where, begin), np.flatnonzero(inside & ~before), after_end)
    return w.hash, common.of_doc(w.first)


def _shape_table() -> np.ndarray:
    if not _TABLE:
        t = np.full(common._TOP, 4, np.uint32)  # 0 blank, 1 capital, 2 other letter, 3 digit, 4 itself
        for c in common.assigned():
            ch = chr(c)
            if ch.isspace():
                t[c] = 0
            elif ch.isupper():
                t[c] = 1
            elif ch.isalpha():
                t[c] = 2
            elif ch.isdigit():
                t[c] = 3
        _TABLE.append(t)
    return _TABLE[0]


_TABLE: list[np.ndarray] = []


def _words_and_stems(texts: list[str | None]) -> tuple[common.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their distinct hashes, the row of each word in these, and the hash of each distinct one's first five letters."""
    w = common.words(texts)
    unique, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    doc = common.of_doc(w.first)[at]
    cps, begin = common.code_points(texts)
    fold, _ = common._tables()
    start = begin[doc] + w.start[at]
    order = np.argsort(start, kind="stable")
    stem = np.empty(len(unique), np.uint64)
    if len(unique):
        ends = start + np.minimum((w.end - w.start)[at], 5)
        stem[order] = common._spans(fold[cps], begin, start[order], ends[order]).hash
    return w, unique, inverse, common.mix(stem + np.uint64(77))


def buckets(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct buckets of each text's words and stems."""
    w, unique, inverse, stem = _words_and_stems(texts)
    a, b = (unique % np.uint64(BUCKETS)).astype(np.int64)[inverse], (stem % np.uint64(BUCKETS)).astype(np.int64)[inverse]
    return [np.unique(np.concatenate([a[s:e], b[s:e]])) for s, e in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]


def pool(texts: list[str | None], v: Vectors, weight: np.ndarray) -> np.ndarray:
    """Inputs of the network, a row for each text."""
    w, unique, inverse, stem = _words_and_stems(texts)
    n, doc = len(texts), common.of_doc(w.first)
    vec = index_vectors(unique) + index_vectors(stem)
    row = _find(v.key, unique)
    vec[row >= 0] += v.context[row[row >= 0]]
    speaks = np.maximum(weight[(unique % np.uint64(BUCKETS)).astype(np.int64)], weight[(stem % np.uint64(BUCKETS)).astype(np.int64)])
    some = np.flatnonzero(np.diff(w.first))
    out = np.zeros((n, 4 * DIM + 7), np.float32)
    if len(some):
        at, size = w.first[some], np.diff(w.first)[some]
        weigh = np.stack([np.ones(len(unique)), *np.exp(np.minimum(speaks.T, 12.0))]).astype(np.float32)
        for i in some.tolist():  # a small matrix product for each text: far faster than summing along the long axis
            own = inverse[w.first[i] : w.first[i + 1]]
            a = weigh[:, own]
            out[i, : 3 * DIM] = ((a @ vec[own]) / a.sum(1, keepdims=True)).ravel()
        for k in range(2):
            out[some, 4 * DIM + k] = np.maximum.reduceat(speaks[inverse, k], at)
            out[some, 4 * DIM + 2 + k] = np.add.reduceat(speaks[inverse, k], at) / size
        same = np.concatenate([[False], (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])])
        out[some, 4 * DIM + 4] = np.add.reduceat(same.astype(np.float32), at) / size
        out[some, 4 * DIM + 5] = np.log1p(size)
    sh, sd = _shapes(texts)
    if len(sh):
        kinds, which = np.unique(sh, return_inverse=True)
        number = np.bincount(sd, minlength=n)
        has = np.flatnonzero(number)
        shape, ends = index_vectors(kinds), np.cumsum(number)
        for i in has.tolist():
            out[i, 3 * DIM : 4 * DIM] = shape[which[ends[i] - number[i] : ends[i]]].mean(0)
        out[has, 4 * DIM + 6] = number[has] / np.maximum(np.diff(w.first)[has], 1)
    return out


def fit_network(x: np.ndarray, y: np.ndarray, rounds: int = 250, seed: int = 9) -> list[np.ndarray]:
    """Two layers, by Adam on the whole batch; labels are not weighted."""
    rng = np.random.default_rng(seed)
    net = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 2)), np.zeros(2)]
    m, v = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
    for t in range(1, rounds + 1):
        h = np.maximum(x @ net[0] + net[1], 0)
        g = (1 / (1 + np.exp(-np.clip(h @ net[2] + net[3], -30, 30))) - y) / len(x)
        gh = (g @ net[2].T) * (h > 0)
        grads = [x.T @ gh + 1e-4 * net[0], gh.sum(0), h.T @ g + 1e-4 * net[2], g.sum(0)]
        for k, gr in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * gr, 0.999 * v[k] + 0.001 * gr * gr
            net[k] = net[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def logits(x: np.ndarray, net: list[np.ndarray]) -> np.ndarray:
    return np.maximum(x @ net[0] + net[1], 0) @ net[2] + net[3]


def temperatures(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each label the temperature with the least log loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = np.stack([np.logaddexp(0, np.where(y > 0, -z, z) / t).mean(0) for t in grid])
    return grid[loss.argmin(0)] if len(z) else np.ones(z.shape[1])


def score(texts: list[str | None], m: Model) -> np.ndarray:
    """Probability of good quality and of toxicity of each text."""
    x = (pool(texts, m.vectors, m.weight) - m.scale[0]) / m.scale[1]
    p = 1 / (1 + np.exp(-np.clip(logits(x, m.net) / m.temperature, -30, 30)))
    return np.where(np.isnan(m.constant), p, m.constant)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, min_docs: float = MIN_DOCS) -> Model:
    vectors = learn_vectors(docs, min_docs)
    spark = docs.sparkSession
    lab = common.project(labels, ["doc_id", "quality", "toxic"], {"doc_id": "bigint", "quality": "int", "toxic": "int"}).dropna()
    lab = lab.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_labelled)
    d = common.project(docs, ["doc_id", "text"], {"doc_id": "bigint"})
    # the least row of those that share a doc_id; 20,000 ids at most are broadcast
    sample = common.materialise(d.join(F.broadcast(lab), "doc_id").groupBy("doc_id", "q", "t", "h").agg(F.min("text").alias("text")), "labelled")
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(20))
    sample = sample.withColumn("part", F.when(part < 10, 0).when(part < 17, 1).otherwise(2))

    def to_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            lists = [x for lo, hi in common.slices(texts, _CHARS) for x in buckets(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))], names=["q", "t", "b"])

    def run_buckets() -> np.ndarray:
        rows = sample.filter("part = 0").select("text", "q", "t").mapInArrow(to_buckets, "q int, t int, b array<bigint>")
        both = rows.groupBy("q", "t").count().collect()
        n = sum(r["count"] for r in both)
        seen = np.zeros((BUCKETS, 3))
        for r in rows.select(F.explode("b").alias("b"), "q", "t").groupBy("b").agg(F.count("*").alias("n"), F.sum(1 - F.col("q")).alias("low"), F.sum("t").alias("tox")).collect():
            seen[r["b"]] = r["n"], r["low"], r["tox"]
        share = np.array([sum(r["count"] * (1 - r["q"]) for r in both), sum(r["count"] * r["t"] for r in both)]) / max(n, 1)
        expected = seen[:, :1] * share
        return np.maximum((seen[:, 1:] - expected) / np.sqrt(expected + 1.0), 0).astype(np.float32)

    weight = run_buckets()
    shared = spark.sparkContext.broadcast((vectors, weight))

    def to_inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            x = [r.tobytes() for lo, hi in common.slices(texts, _CHARS) for r in pool(texts[lo:hi], *shared.value)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(x, pa.binary())], names=["h", "part", "q", "t", "x"])

    rows = sorted(sample.filter("part > 0").select("text", "h", "part", "q", "t").mapInArrow(to_inputs, "h bigint, part int, q int, t int, x binary").collect())
    width = 4 * DIM + 7
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(float) if rows else np.zeros((0, width))
    y = np.array([(r["q"], r["t"]) for r in rows], float).reshape(-1, 2)
    held = np.array([r["part"] == 2 for r in rows], bool)
    constant = np.full(2, np.nan)
    for k in range(2):
        if len(set(y[~held, k])) < 2:
            constant[k] = y[:, k].mean() if len(y) else 0.5
    if (~held).any():
        scale = x[~held].mean(0), x[~held].std(0) + 1e-3
        net = fit_network((x[~held] - scale[0]) / scale[1], y[~held])
        temperature = temperatures(logits((x[held] - scale[0]) / scale[1], net), y[held])
    else:
        scale, temperature = (np.zeros(width), np.ones(width)), np.ones(2)
        net = [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 2)), np.zeros(2)]
    return Model(vectors, weight, scale, net, temperature, constant)


def classify(docs: DataFrame, model: Model, low: float = 0.5, toxic: float = 0.5) -> DataFrame:
    """doc_id, p_quality, p_toxic, toxic and keep of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            p = np.concatenate([score(texts[lo:hi], shared.value) for lo, hi in common.slices(texts, _CHARS)]) if texts else np.zeros((0, 2))
            p = np.round(p, 6)
            bad = p[:, 1] >= toxic
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(bad), pa.array((p[:, 0] >= low) & ~bad)], names=["doc_id", "p_quality", "p_toxic", "toxic", "keep"])

    return common.project(docs, ["doc_id", "text"], {"doc_id": "bigint"}).mapInArrow(run, "doc_id bigint, p_quality double, p_toxic double, toxic boolean, keep boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model: Any = train(docs, common.table(spark, sf_dir, "labels"))
    return classify(docs, model)
