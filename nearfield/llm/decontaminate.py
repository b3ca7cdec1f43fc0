"""Operator 1, benchmark decontamination with a generalised suffix automaton.

The test items, normalised to folded words, are put into one generalised suffix automaton (more than one where they
exceed ``max_automaton_tokens`` together; each is broadcast on its own and its size is bounded by that). Every text is
streamed through it, giving at each word the length of the longest run ending there that some item contains. A run is
contaminated when it has ``min_tokens`` words, or makes up ``min_item_share`` of an item that contains it and has
``short_tokens`` words. Contaminated words are cut from the text, from the first character of the first to the last
character of the last; a text of which they make up more than ``max_doc_share`` is dropped.

Only stretches in which each pair of neighbours occurs in some item are walked through the automaton; a match of two
words or more lies within one, so the lengths are exact.

Cases: items of fewer than ``short_tokens`` words aren't searched for. A null, empty or wordless text is kept as it is with length 0. Null, empty or wordless items are left out; with
no items every text is kept. Repeated items count once; repeated rows are judged alike; null doc_id passes through.
Extra columns are ignored by :func:`decontaminate` and kept, whatever their names, by :func:`strip_benchmark`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_TOKENS = 13
SHORT_TOKENS = 6
MIN_ITEM_SHARE = 0.5
MAX_DOC_SHARE = 0.5
MAX_AUTOMATON_TOKENS = 500_000

_TYPE = "action string, longest int, spans int, removed_tokens int, tokens int, clean string"


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word hashes.

    ``least[v]`` is the length of the shortest item that contains the words of state v.
    """

    def __init__(self, items: list[np.ndarray]) -> None:
        self.vocabulary = np.unique(np.concatenate(items)) if items else np.empty(0, np.uint64)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 30]
        pairs = [common.grams(h, 2) for h in items if len(h) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.uint64)
        for h in items:
            self._add(np.searchsorted(self.vocabulary, h).tolist())
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            p = self.link[v]
            self.least[p] = min(self.least[p], self.least[v])
        for keys, name in ((self.vocabulary, "_in_vocabulary"), (self.pairs, "_in_pairs")):
            maybe = np.zeros(1 << 20, bool)
            maybe[(keys >> np.uint64(44)).astype(np.int64)] = True
            setattr(self, name, maybe)

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.least.append(1 << 30)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _add(self, item: list[int]) -> None:
        last = 0
        for c in item:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
                last = new
            self.least[last] = min(self.least[last], len(item))

    def walk(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """At each id, the longest match that ends there, and the least length of an item with it."""
        v = n = 0
        lengths, least = [], []
        for c in ids:
            to = self.next[v].get(c)
            while to is None and v:
                v = self.link[v]
                n = self.length[v]
                to = self.next[v].get(c)
            if to is None:
                v = n = 0
            else:
                v, n = to, n + 1
            lengths.append(n)
            least.append(self.least[v] if n else 1 << 30)
        return lengths, least

    @staticmethod
    def _known(h: np.ndarray, maybe: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = maybe[(h >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        where = np.minimum(np.searchsorted(keys, h[at]), max(len(keys) - 1, 0))
        out[at] = keys[where] == h[at] if len(keys) else False
        return out

    def stretches(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal stretches of words whose neighbours all form known pairs, or of one known word."""
        if not len(h):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        one = self._known(h, self._in_vocabulary, self.vocabulary)
        two = np.zeros(len(h), bool)  # with the word before
        if len(h) > 1:
            two[1:] = self._known(common.grams(h, 2), self._in_pairs, self.pairs) & one[1:] & one[:-1] & (doc[1:] == doc[:-1])
        starts = np.flatnonzero(one & ~two)
        ends = np.flatnonzero(one & ~np.append(two[1:], False)) + 1
        return starts, ends


def build(items: list[str | None], max_tokens: int = MAX_AUTOMATON_TOKENS) -> list[SuffixAutomaton]:
    """Automata over the distinct items, each of up to max_tokens words (a longer item is alone in its own)."""
    w = common.words(items)
    seen: dict[bytes, np.ndarray] = {}
    for i in range(len(items)):
        h = w.hash[w.first[i] : w.first[i + 1]]
        if len(h):
            seen.setdefault(h.tobytes(), h)
    out, now, total = [], [], 0
    for h in seen.values():
        if now and total + len(h) > max_tokens:
            out.append(SuffixAutomaton(now))
            now, total = [], 0
        now.append(h)
        total += len(h)
    return out + ([SuffixAutomaton(now)] if now else [])


def judge(texts: list[str | None], automata: list[SuffixAutomaton], p: dict[str, Any]) -> list[tuple]:
    """(action, longest, spans, removed_tokens, tokens, text if changed) of each text."""
    w = common.words(texts)
    doc, n = common.of_doc(w.first), len(w.hash)
    longest = np.zeros(len(texts), np.int64)
    cover = np.zeros(n + 1, np.int64)
    for a in automata:
        starts, ends = a.stretches(w.hash, doc)
        size = ends - starts
        np.maximum.at(longest, doc[starts], np.minimum(size, 2))
        least_that_counts = min(p["short_tokens"], p["min_tokens"])
        walked = np.flatnonzero(size > 2 if least_that_counts > 2 else size > 0)
        for k in walked[np.argsort(-size[walked], kind="stable")].tolist():
            s, e = int(starts[k]), int(ends[k])
            d = doc[s]
            if e - s < least_that_counts and e - s <= longest[d]:
                continue
            lengths, least = a.walk(np.searchsorted(a.vocabulary, w.hash[s:e]).tolist())
            longest[d] = max(longest[d], max(lengths))
            for i, (m, item) in enumerate(zip(lengths, least, strict=True)):
                if m >= p["min_tokens"] or m >= p["short_tokens"] and m >= p["min_item_share"] * item:
                    cover[s + i - m + 1] += 1
                    cover[s + i + 1] -= 1
    covered = np.cumsum(cover[:-1]) > 0
    out = []
    for i, text in enumerate(texts):
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        c = covered[lo:hi]
        removed = int(c.sum())
        if not removed:
            out.append(("keep", int(longest[i]), 0, 0, hi - lo, None))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], c, [False]])))
        pieces, at = [], 0
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            pieces.append(text[at : w.start[lo + s]])
            at = int(w.end[lo + e - 1])
        pieces.append(text[at:])
        drop = removed > p["max_doc_share"] * (hi - lo)
        out.append(("drop" if drop else "trim", int(longest[i]), len(edge) // 2, removed, hi - lo, "" if drop else "".join(pieces)))
    return out


def _verdict(spark: SparkSession, benchmark: DataFrame, text: Column, params: dict[str, Any]) -> Column:
    items = [r[0] for r in common.project(benchmark, ["text"]).distinct().collect()]
    shared = [spark.sparkContext.broadcast(a) for a in build(sorted(x for x in items if x), params.get("max_automaton_tokens", MAX_AUTOMATON_TOKENS))]
    p = {"min_tokens": MIN_TOKENS, "short_tokens": SHORT_TOKENS, "min_item_share": MIN_ITEM_SHARE, "max_doc_share": MAX_DOC_SHARE} | params
    kind = pa.struct([("action", pa.string()), ("longest", pa.int32()), ("spans", pa.int32()), ("removed_tokens", pa.int32()), ("tokens", pa.int32()), ("clean", pa.string())])

    @F.arrow_udf(_TYPE)
    def verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automata = [b.value for b in shared]
        for batch in batches:
            texts = batch.to_pylist()
            rows = [r for lo, hi in common.slices(texts) for r in judge(texts[lo:hi], automata, p)]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kind]
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], fields=list(kind))

    return verdict.asNondeterministic()(text)  # so that no filter is moved below it and runs it twice


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params: Any) -> DataFrame:
    """One row for each document: doc_id, action (keep, trim or drop), contaminated, longest_match, n_spans,
    removed_tokens, n_tokens, and text as it may be trained on (empty where the document is dropped)."""
    d = common.project(docs, ["doc_id", "text"])
    d = d.withColumn("v", _verdict(docs.sparkSession, benchmark, F.col("text"), params))
    return d.select(
        "doc_id", F.col("v.action").alias("action"), (F.col("v.removed_tokens") > 0).alias("contaminated"),
        F.col("v.longest").alias("longest_match"), F.col("v.spans").alias("n_spans"), F.col("v.removed_tokens").alias("removed_tokens"),
        F.col("v.tokens").alias("n_tokens"), F.coalesce("v.clean", "text").alias("text"),
    )


def strip_benchmark(docs: DataFrame, benchmark: DataFrame, **params: Any) -> DataFrame:
    """docs with all its columns: contaminated spans are cut from text (n_chars, where there is one, follows), and
    dropped documents are gone."""
    d, cols, at = common.positional(docs)
    t = F.col(at["text"])
    d = d.withColumn("v", _verdict(docs.sparkSession, benchmark, t, params)).filter("v.action <> 'drop'")
    new = {at["text"]: F.coalesce("v.clean", t)}
    if "n_chars" in at:
        n = at["n_chars"]
        new[n] = F.when(F.col("v.clean").isNull(), F.col(n)).otherwise(F.length("v.clean").cast(dict(d.dtypes)[n]))
    return d.select(*[new.get(c, F.col(c)).alias(c) for c in d.columns if c != "v"]).toDF(*cols)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
