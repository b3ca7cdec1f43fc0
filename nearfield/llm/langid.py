"""Operator 9, language identification with error-correcting output codes.

Every language has a codeword of bits. A bit is predicted by a binary classifier (logistic regression, trained here)
over hashed letter n-grams of 1 to 3 within words. A text's margins are compared with every codeword by logistic loss,
each bit weighted by how well it did on held-out rows; the least loss wins, and a text whose second-best is nearly as
good is flagged as ambiguous. Codes are exhaustive up to six languages and the best of seeded random codes beyond.

Training uses at most ``max_per_lang`` labelled rows of each language (those with the least hash of doc_id and text) and
is the only thing that is bounded; every text is classified as a whole. Executors count the n-grams of these rows; the
driver holds the counts that aren't 0 and spreads out ``BATCH`` rows of them at a time.

Cases: null, empty and letterless texts have no prediction and are flagged. Null and empty languages don't train. With
one language in the labels it is always predicted; with none nothing is. Repeated rows are classified alike; null
doc_id passes through. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MAX_PER_LANG = 250
BUCKETS = 1 << 13
AMBIGUOUS = 0.15  # share of the weights by which the best has to lead
HELD_OUT = 0.2
BATCH = 2_048
MAX_BROADCAST = 100_000


class Model(NamedTuple):
    langs: list[str]
    code: np.ndarray  # langs x bits, 1 or -1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # by bit


def code_for(n: int, seed: int = 5) -> np.ndarray:
    """n codewords, as far apart as can be."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        cols = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, np.int8).reshape(-1, n).T
    rng, bits, best = np.random.default_rng(seed), max(15, 10 * int(np.ceil(np.log2(n)))), None
    for _ in range(200):
        c = rng.choice(np.array([1, -1], np.int8), (n, bits))
        c = c[:, np.abs(c.sum(0, dtype=int)) < n]
        apart = ((c.shape[1] - (c.astype(int) @ c.T))[~np.eye(n, dtype=bool)] // 2).min()
        if best is None or apart > best[0]:
            best = (apart, c)
    return best[1]


def grams(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: bucket of each n-gram and where each word's begin; of all words: their distinct word and text."""
    w = common.words(texts)
    unique, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    doc = common.of_doc(w.first)
    cps, begin = common.code_points(texts)
    fold, _ = common._tables()
    size = (w.end - w.start)[at] + 2  # with a mark on either side
    first = np.cumsum(size) - size
    flat = np.ones(int(size.sum()), np.uint64)
    inner = np.repeat(begin[doc[at]] + w.start[at] - first - 1, size) + np.arange(len(flat))
    mark = np.zeros(len(flat), bool)
    mark[first], mark[first + size - 1] = True, True
    flat[~mark] = fold[cps[inner[~mark]]]
    word = np.repeat(np.arange(len(unique)), size)
    ids, owner = [], []
    for n in (1, 2, 3):
        if len(flat) >= n:
            h = common.grams(flat, n)
            ok = word[n - 1 :] == word[: len(word) - n + 1]
            if n == 1:
                ok = ok & ~mark
            ids.append((h[ok] % np.uint64(buckets)).astype(np.int64))
            owner.append(word[: len(h)][ok])
    ids, owner = (np.concatenate(ids), np.concatenate(owner)) if ids else (np.empty(0, np.int64), np.empty(0, np.int64))
    by = np.argsort(owner, kind="stable")
    return ids[by], np.searchsorted(owner[by], np.arange(len(unique) + 1)), inverse, doc


class Counts(NamedTuple):
    """Rows of shares of buckets: those of row i are bucket[first[i]:first[i+1]] and share likewise."""

    bucket: np.ndarray
    share: np.ndarray
    first: np.ndarray
    buckets: int

    def spread(self, lo: int, hi: int) -> np.ndarray:
        out = np.zeros((hi - lo, self.buckets), np.float32)
        at = slice(int(self.first[lo]), int(self.first[hi]))
        out[np.repeat(np.arange(hi - lo), np.diff(self.first[lo : hi + 1])), self.bucket[at]] = self.share[at]
        return out


def counts(texts: list[str | None], buckets: int = BUCKETS) -> Counts:
    """Share of each bucket among a text's n-grams."""
    cols, shares = [], []
    for t in texts:
        ids, begin, inverse, _ = grams([t], buckets)
        times = np.bincount(inverse, minlength=len(begin) - 1)
        c = np.bincount(ids, np.repeat(times, np.diff(begin)), buckets)
        cols.append(np.flatnonzero(c))
        shares.append((c[cols[-1]] / max(c.sum(), 1)).astype(np.float32))
    return gather(cols, shares, buckets)


def gather(cols: list[np.ndarray], shares: list[np.ndarray], buckets: int = BUCKETS) -> Counts:
    first = np.concatenate([[0], np.cumsum([len(c) for c in cols])]).astype(np.int64)
    return Counts(np.concatenate([*cols, np.empty(0, np.int64)]).astype(np.int32), np.concatenate([*shares, np.empty(0, np.float32)]), first, buckets)


def fit(x: Counts, langs: list[str], rounds: int = 80, seed: int = 3) -> Model | None:
    names, buckets, n = sorted(set(langs)), x.buckets, len(langs)
    if not names:
        return None
    code = code_for(len(names))
    if len(names) == 1:
        return Model(names, code, np.zeros((buckets, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), np.ones(code.shape[1], np.float32))
    number = {a: k for k, a in enumerate(names)}
    y = code[[number[a] for a in langs]].astype(np.float32)
    held = np.random.default_rng(seed).random(n) < HELD_OUT
    if held.all() or not held.any():
        held = np.arange(n) % 5 == 4
    use = (~held).astype(np.float32)
    scale = (1 / np.sqrt(np.bincount(x.bucket, x.share, buckets) / n + 1e-6)).astype(np.float32)
    x = x._replace(share=x.share * scale[x.bucket])
    only = x.spread(0, n) if n <= BATCH else None
    batch = lambda lo, hi: x.spread(lo, hi) if only is None else only
    parts = [(lo, min(lo + BATCH, n)) for lo in range(0, n, BATCH)]
    trained = max(float(use.sum()), 1.0)
    share = (((y > 0) * use[:, None]).sum(0) / trained).clip(0.02), (((y < 0) * use[:, None]).sum(0) / trained).clip(0.02)
    balance = (np.where(y > 0, 0.5 / share[0], 0.5 / share[1]) * use[:, None] / trained).astype(np.float32)
    w, b = np.zeros((buckets, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    squares = float((np.add.reduceat(np.append(x.share * x.share, 0), x.first[:-1]) * (np.diff(x.first) > 0) * use).sum()) / trained
    step, vw, vb = 4.0 / max(squares, 1e-6), np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        gw, gb = 1e-5 * w, np.zeros_like(b)
        for lo, hi in parts:
            xs, ys = batch(lo, hi), y[lo:hi]
            g = -ys * balance[lo:hi] / (1 + np.exp(np.clip(ys * (xs @ w + b), -30, 30)))
            gw += xs.T @ g
            gb += g.sum(0)
        vw, vb = 0.9 * vw - 0.1 * step * gw, 0.9 * vb - 0.1 * step * gb
        w, b = w + vw, b + vb
    wrong, asked = np.zeros(code.shape[1]), int(held.sum())
    for lo, hi in parts:
        wrong += ((np.sign(batch(lo, hi) @ w + b) != y[lo:hi]) & held[lo:hi, None]).sum(0)
    wrong /= max(asked, 1)
    w *= scale[:, None]
    wrong = np.clip(wrong, 0.01, 0.49)
    return Model(names, code, w.astype(np.float32), b, np.log((1 - wrong) / wrong).astype(np.float32))


def predict(texts: list[str | None], m: Model | None) -> list[tuple[str | None, bool, float, int]]:
    """(language, ambiguous, lead over the second, n-grams) of each text."""
    if m is None or not texts:
        return [(None, True, 0.0, 0)] * len(texts)
    ids, begin, inverse, doc = grams(texts, len(m.weights))
    n, bits = len(texts), m.weights.shape[1]
    size = np.diff(begin)
    of_word = np.zeros((len(size), bits))
    some = np.flatnonzero(size)
    for lo in range(0, len(some), 50_000):
        part = some[lo : lo + 50_000]
        s, e = begin[part[0]], begin[part[-1] + 1]
        of_word[part] = np.add.reduceat(m.weights[ids[s:e]].astype(np.float64), begin[part] - s, axis=0)
    total = np.bincount(doc, size[inverse], n)
    margin = np.stack([np.bincount(doc, of_word[inverse, b], n) for b in range(bits)], 1) / np.maximum(total, 1)[:, None] + m.bias
    loss = (np.logaddexp(0, -margin[:, None, :] * m.code[None]) * m.trust).sum(2) / m.trust.sum()
    order = np.argsort(loss, axis=1, kind="stable")
    at = np.arange(n)
    lead = loss[at, order[:, 1]] - loss[at, order[:, 0]] if len(m.langs) > 1 else np.full(n, np.inf)
    return [(m.langs[k], bool(x < AMBIGUOUS), round(float(min(x, 99.0)), 6), int(t)) if t else (None, True, 0.0, 0) for k, x, t in zip(order[:, 0].tolist(), lead.tolist(), total.tolist(), strict=True)]


def train(docs: DataFrame, max_per_lang: int = MAX_PER_LANG) -> Model | None:
    """A model of the languages in docs, from at most max_per_lang rows of each."""
    d = common.project(docs, ["doc_id", "text", "lang"]).filter("lang is not null and lang <> '' and text is not null and text <> ''")
    n = common.materialise(d.groupBy("lang").count(), "languages")
    if n.count() <= MAX_BROADCAST:
        n = F.broadcast(n)
    h = F.xxhash64("doc_id", "text")  # the text counts, so that rows without an id aren't taken or left together
    # a sample by hash first, so that only a few rows of each language are ranked
    near = d.withColumn("h", F.pmod(h, F.lit(1 << 30))).join(n, "lang").filter(F.col("h") < F.least(F.lit(1.0), 2.0 * max_per_lang / F.col("count") + 20.0 / F.col("count")) * (1 << 30))
    least = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))).filter(F.col("r") <= max_per_lang)

    def to_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counts([t]) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.bucket.tobytes() for c in rows], pa.binary()), pa.array([c.share.tobytes() for c in rows], pa.binary())], names=["lang", "h", "bucket", "share"])

    rows = sorted(least.select("lang", "h", "text").mapInArrow(to_counts, "lang string, h bigint, bucket binary, share binary").collect())
    return fit(gather([np.frombuffer(r["bucket"], np.int32) for r in rows], [np.frombuffer(r["share"], np.float32) for r in rows]), [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang as given, predicted, ambiguous, lead and n_grams of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            rows: list[tuple[Any, ...]] = [r for lo, hi in common.slices(texts) for r in predict(texts[lo:hi], shared.value)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.float64(), pa.int64()), strict=True))], names=["doc_id", "lang", "predicted", "ambiguous", "lead", "n_grams"])

    d = common.project(docs, ["doc_id", "lang", "text"], {"doc_id": "bigint"})
    return d.mapInArrow(run, "doc_id bigint, lang string, predicted string, ambiguous boolean, lead double, n_grams bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
