"""Operator 4, quality rules on tokeniser fertility.

Two public vocabularies measure every text, its white space taken as single blanks: a multilingual byte-level BPE gives
characters per token and the entropy of the text's tokens (over the largest that so many tokens, or 1024, could have),
a piece BPE gives the share of its tokens that are byte fallback. Both are exact: neither vocabulary joins characters
across a blank, so each word is encoded once with its blank and counted wherever it occurs.

A text is rejected when a figure lies outside the band of its language (of its script, where the language has fewer
than ``min_docs`` texts; an absolute band, where that has too few as well). Bands come from all documents: the median
and the distance to a quartile, times a factor. Short texts get a margin of ``z`` standard errors.

Cases: null, empty and blank texts have no tokens; their figures are null and they are rejected as "empty". A null or
rare language falls back to the script, "none" where there is no letter. Repeated rows count each; null doc_id passes
through. An empty table gives an empty one. Extra columns are ignored by :func:`measure` and :func:`judge` and kept,
whatever their names, by :func:`keep_good`.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MIN_DOCS = 50
BAND_FACTOR = {"chars_per_token": 6.0, "byte_share": 6.0, "entropy": 4.5}
ABSOLUTE = {"chars_per_token": (1.0, 12.0), "byte_share": (0.0, 0.3), "entropy": (0.6, 1.0)}
Z = 2.0
MAX_BROADCAST = 10_000
_TYPE = "n_tokens int, chars_per_token double, byte_share double, entropy double, script string"
_SCRIPTS = [(0x41, 0x250, "latin"), (0x1E00, 0x1F00, "latin"), (0x370, 0x400, "greek"), (0x1F00, 0x2000, "greek"), (0x400, 0x530, "cyrillic"), (0x530, 0x590, "armenian"), (0x590, 0x600, "hebrew"), (0x600, 0x780, "arabic"), (0x8A0, 0x900, "arabic"), (0x900, 0x980, "devanagari"), (0x980, 0xE00, "indic"), (0xE00, 0xE80, "thai"), (0x10A0, 0x1100, "georgian"), (0x1100, 0x1200, "hangul"), (0xAC00, 0xD7B0, "hangul"), (0x3040, 0x3100, "kana"), (0x3400, 0xA000, "han"), (0xF900, 0xFB00, "han"), (0x20000, 0x33480, "han")]
_CACHE_WORDS = 400_000


@lru_cache(1)
def _script_table() -> tuple[np.ndarray, list[str]]:
    names = ["none", *dict.fromkeys(s for _, _, s in _SCRIPTS), "other"]
    fold, _ = common._tables()
    out = np.where(fold != 0, len(names) - 1, 0).astype(np.uint8)
    out[0x30:0x3A] = 0
    for lo, hi, s in _SCRIPTS:
        out[lo:hi] = np.where(fold[lo:hi] != 0, names.index(s), 0)
    return out, names


class WordTokens:
    """Token counts by word, kept from batch to batch (and dropped when there are too many: only speed hangs on it)."""

    def __init__(self, folder: str) -> None:
        import sentencepiece
        import tiktoken

        with open(f"{folder}/byte_bpe_multi_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        self.is_byte = np.fromiter((self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())), bool)
        self._forget()

    def _forget(self) -> None:
        self.key = np.empty(0, np.uint64)
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.n_pieces, self.n_bytes = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def rows(self, texts: list[str | None], w: common.Words) -> np.ndarray:
        """For each word its row in size, begin, n_pieces and n_bytes."""
        unique, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.key) + len(unique) > _CACHE_WORDS:
            self._forget()
        where = np.searchsorted(self.key, unique)
        known = (self.key[np.minimum(where, len(self.key) - 1)] == unique) if len(self.key) else np.zeros(len(unique), bool)
        new = np.flatnonzero(~known)
        if len(new):
            doc = common.of_doc(w.first)[at[new]]
            spelled = [texts[d][s:e] for d, s, e in zip(doc.tolist(), w.start[at[new]].tolist(), w.end[at[new]].tolist(), strict=True)]
            bpe = [self.bpe.encode_ordinary(" " + x) for x in spelled]
            pieces = self.pieces.encode(spelled, num_threads=1)
            size = np.fromiter(map(len, bpe), np.int64, len(bpe))
            n_pieces = np.fromiter(map(len, pieces), np.int64, len(pieces))
            flat = self.is_byte[np.fromiter((i for p in pieces for i in p), np.int64, int(n_pieces.sum()))]
            n_bytes = np.add.reduceat(np.append(flat, False).astype(np.int64), np.cumsum(n_pieces) - n_pieces) * (n_pieces > 0)
            order = np.argsort(np.concatenate([self.key, unique[new]]), kind="stable")
            join = lambda a, b: np.concatenate([a, b])[order]
            self.begin = join(self.begin, len(self.ids) + np.cumsum(size) - size)
            self.size, self.n_pieces, self.n_bytes = join(self.size, size), join(self.n_pieces, n_pieces), join(self.n_bytes, n_bytes)
            self.ids = np.concatenate([self.ids, np.fromiter((i for b in bpe for i in b), np.uint32, int(size.sum()))])
            self.key = join(self.key, unique[new])
            where = np.searchsorted(self.key, unique)
        return where[inverse]


@lru_cache(1)
def _tokens(folder: str) -> WordTokens:
    return WordTokens(folder)


def figures(texts: list[str | None], folder: str = TOKENIZERS) -> dict[str, np.ndarray]:
    """n_tokens, chars_per_token, byte_share, entropy and script of each text (nan where it has no tokens)."""
    wt, w, n = _tokens(folder), common.chunks(texts), len(texts)
    row, doc = wt.rows(texts, w), common.of_doc(w.first)
    by_doc = lambda x: np.bincount(doc, x, n)
    size = wt.size[row]
    tokens = by_doc(size).astype(np.int64)
    chars, pieces, fallback = by_doc(w.end - w.start + 1), by_doc(wt.n_pieces[row]), by_doc(wt.n_bytes[row])
    at = np.repeat(wt.begin[row] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    key = np.sort((np.repeat(doc, size).astype(np.uint64) << np.uint64(32)) | wt.ids[at].astype(np.uint64))
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.append(begin, len(key))).astype(np.float64)
    of = (key[begin] >> np.uint64(32)).astype(np.int64)
    table, names = _script_table()
    cps, start = common.code_points(texts)
    script = table[cps]
    kinds = np.bincount(np.repeat(np.arange(n), np.diff(start)) * len(names) + script, minlength=n * len(names)).reshape(n, len(names)) if n else np.zeros((0, len(names)))
    kinds[:, 0] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.log2(tokens) - np.bincount(of, count * np.log2(count), n) / tokens
        entropy = np.where(tokens > 1, bits / np.log2(np.clip(tokens, 2, 1024)), np.where(tokens == 1, 1.0, np.nan))
        return {"n_tokens": tokens, "chars_per_token": chars / np.where(tokens, tokens, np.nan), "byte_share": fallback / np.where(pieces, pieces, np.nan), "entropy": entropy, "script": np.array(names, object)[kinds.argmax(1)]}


def _measured(text: Column, folder: str) -> Column:
    @F.arrow_udf(_TYPE)
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            parts = [figures(texts[lo:hi], folder) for lo, hi in common.slices(texts)]
            cols = {k: np.concatenate([p[k] for p in parts]) if parts else np.empty(0) for k in ("n_tokens", "chars_per_token", "byte_share", "entropy", "script")}
            arrays = [pa.array(cols["n_tokens"].astype(np.int32), pa.int32()), *(pa.array(cols[k], pa.float64(), from_pandas=True) for k in ("chars_per_token", "byte_share", "entropy")), pa.array(cols["script"].tolist(), pa.string())]
            yield pa.StructArray.from_arrays(arrays, names=["n_tokens", "chars_per_token", "byte_share", "entropy", "script"])

    return measured.asNondeterministic()(text)


def measure(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, lang and the figures of every document."""
    d = common.project(docs, ["doc_id", "text", "lang"])
    return d.withColumn("m", _measured(F.col("text"), folder)).select("doc_id", "lang", "m.*")


def bands(measured: DataFrame, lang: str, min_docs: int = MIN_DOCS) -> DataFrame:
    """kind ("lang" or "script"), name, and lo and hi of each figure, of every language and script with min_docs texts.

    Figures are counted in steps of 0.001 first; quartiles are exact for these counts, whatever the partitions.
    """
    some = measured.filter("n_tokens > 0")
    named = some.select(F.explode(F.array(F.struct(F.lit("lang").alias("kind"), F.col(lang).alias("name")), F.struct(F.lit("script").alias("kind"), F.col("script").alias("name")))).alias("g"), *ABSOLUTE)
    steps = named.select("g.kind", "g.name", F.explode(F.array(*[F.struct(F.lit(f).alias("figure"), F.round(F.col(f), 3).alias("x")) for f in ABSOLUTE])).alias("s")).filter("name is not null")
    counted = steps.groupBy("kind", "name", "s.figure", "s.x").agg(F.count("*").alias("n"))
    q = counted.groupBy("kind", "name", "figure").agg(F.expr("percentile(x, array(0.25, 0.5, 0.75), n)").alias("q"), F.sum("n").alias("docs")).filter(F.col("docs") >= min_docs)
    factor = F.element_at(F.create_map(*[F.lit(x) for kv in BAND_FACTOR.items() for x in kv]), F.col("figure"))
    # a step of slack, where a quartile equals the median
    lo = F.col("q")[1] - factor * F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(0.002))
    hi = F.col("q")[1] + factor * F.greatest(F.col("q")[2] - F.col("q")[1], F.lit(0.002))
    return q.groupBy("kind", "name").agg(*[F.max(F.when(F.col("figure") == f, F.struct(lo.alias("lo"), hi.alias("hi")))).alias(f) for f in ABSOLUTE])


def _verdict(measured: DataFrame, lang: str, found: DataFrame, z: float) -> DataFrame:
    """measured and column reason (null: keep)."""
    found = common.materialise(found, "bands")  # a row for each language and script, used three times
    small = found.count() <= MAX_BROADCAST
    for kind, key in (("lang", lang), ("script", "script")):
        of = found.filter(F.col("kind") == kind).select(F.col("name").alias(f"nf_{kind}"), F.struct(*ABSOLUTE).alias(f"nf_band_{kind}"))
        measured = measured.join(F.broadcast(of) if small else of, F.col(key) == F.col(f"nf_{kind}"), "left").drop(f"nf_{kind}")
    fixed = F.struct(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")).alias(f) for f, (a, b) in ABSOLUTE.items()])
    d = measured.withColumn("nf_band", F.coalesce("nf_band_lang", "nf_band_script", fixed))
    band = lambda f, side: F.col(f"nf_band.{f}.{side}")
    root = F.sqrt(F.col("n_tokens"))
    cpt, share = F.col("chars_per_token"), F.col("byte_share")
    top = F.least(F.greatest(band("byte_share", "hi"), F.lit(0.01)), F.lit(1.0))
    reason = (
        F.when(F.col("n_tokens") == 0, "empty")
        .when(cpt + 1.5 * z / root < band("chars_per_token", "lo"), "few characters per token")
        .when(cpt - 1.5 * z / root > band("chars_per_token", "hi"), "many characters per token")
        .when(share > top + z * F.sqrt(top * (1 - top)) / root, "byte fallback")
        .when(F.col("entropy") < band("entropy", "lo"), "low entropy")
    )
    return d.withColumn("nf_reason", reason)


def judge(docs: DataFrame, folder: str = TOKENIZERS, min_docs: int = MIN_DOCS, z: float = Z) -> DataFrame:
    """doc_id, lang, the figures, keep and reason of every document."""
    m = common.materialise(measure(docs, folder), "fertility")
    out = _verdict(m, "lang", bands(m, "lang", min_docs), z)
    figs = ["n_tokens", *[F.round(f, 6).alias(f) for f in ABSOLUTE], "script"]
    return out.select("doc_id", "lang", *figs, F.col("nf_reason").isNull().alias("keep"), F.col("nf_reason").alias("reason"))


def keep_good(docs: DataFrame, folder: str = TOKENIZERS, min_docs: int = MIN_DOCS, z: float = Z) -> DataFrame:
    """docs with all its columns, without the documents that are rejected."""
    d, cols, at = common.positional(docs)
    m = common.materialise(d.withColumn("nf_m", _measured(F.col(at["text"]), folder)).select(*d.columns, "nf_m.*"), "measured")
    lang = at["lang"]
    return _verdict(m, lang, bands(m, lang, min_docs), z).filter("nf_reason is null").select(*d.columns).toDF(*cols)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))
