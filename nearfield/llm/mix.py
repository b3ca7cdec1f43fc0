"""Operator 5, mixing sources to target weights by the cube method.

Every source gets an inclusion probability: its target share of the token budget over the tokens it has, 1 where it has
too few (what it lacks goes to the others in proportion). Target weights are given, or are token totals to the power
``alpha``. ``budget`` is the most that is taken: where small sources are taken whole, it shrinks until no source has more
than ``over`` times its target share of the sample, so what all whole sources together lack is at most ``over - 1`` of it,
and a tiny source can't shrink the sample to its own size. The sample is then drawn balanced on each source's documents and tokens. Flight: three documents with
fractional probabilities at a time, which move along the vector that leaves both totals unchanged until one reaches 0
or 1. It runs in parallel over pieces of a source; the two documents or fewer that each piece leaves fly again, in pieces
as long as they are many, then together. Pieces and order follow a hash of doc_id and text, so the sample doesn't depend
on how the table is laid out in files or partitions.
Landing: the two or fewer of a source that are left give up first the token total, then chance decides on the last.
So a source's documents are within 1 of what is expected, and its tokens within the size of about a document or two.

Cases: null sources form one source of their own. Target shares are those among sources that have tokens. Null, empty and blank texts have 0 tokens and are drawn as others. A
source without tokens is kept whole if its weight is above 0. Repeated rows are drawn each on its own; null doc_id
passes through. An empty table gives an empty one. Extra columns are ignored by :func:`sample` and kept, whatever
their names, by :func:`mixed`.
"""

from __future__ import annotations

import hashlib
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ALPHA = 0.5
BUDGET = 0.7  # share of all tokens to keep, at most
OVER = 1.05  # times its target share of the sample that a source may have, at most
SEED = "mix-1"
ROWS_PER_PIECE = 20_000
MAX_BROADCAST = 100_000
_EPS = 1e-9
_STATE = "row bigint, key bigint, source string, n_tokens bigint, pi double, p double"


def _most(totals: dict[Any, int], w: dict[Any, float], over: float) -> float:
    """Tokens that can be taken before a source has more than over times its target share of them."""
    whole, rest = 0.0, sum(w.values())
    every = rest
    for s in sorted(totals, key=lambda s: totals[s] / w[s]):
        rate = totals[s] / w[s]  # at which s is whole
        if rate * every > over * (whole + rate * rest):
            return whole + rest * over * whole / (every - over * rest)
        whole, rest = whole + totals[s], rest - w[s]
    return whole


def probabilities(totals: dict[Any, int], weights: dict[Any, float] | None = None, alpha: float = ALPHA, budget: float = BUDGET, over: float = float("inf")) -> dict[Any, float]:
    """Inclusion probability of each source by its tokens."""
    w = {s: max(0.0, weights.get(s, 0.0)) if weights is not None else max(t, 1) ** alpha for s, t in totals.items()}
    out = {s: 0.0 for s in totals} | {s: 1.0 for s, t in totals.items() if not t and w[s] > 0}
    left, open_ = budget * sum(totals.values()), [s for s, t in totals.items() if t and w[s] > 0]
    if over < float("inf"):
        left = min(left, _most({s: totals[s] for s in open_}, {s: w[s] for s in open_}, over))
    while open_:
        rate = left / sum(w[s] for s in open_)
        full = [s for s in open_ if rate * w[s] >= totals[s]]
        if not full:
            return out | {s: rate * w[s] / totals[s] for s in open_}
        out |= {s: 1.0 for s in full}
        left -= sum(totals[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def _move(p: list[float], u: list[float], r: float) -> None:
    up = down = float("inf")
    for x, d in zip(p, u, strict=True):
        if d > 0:
            up, down = min(up, (1 - x) / d), min(down, x / d)
        elif d < 0:
            up, down = min(up, -x / d), min(down, (x - 1) / d)
    step = up if r * (up + down) < down else -down
    for k, d in enumerate(u):
        x = p[k] + step * d
        p[k] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x


def _null(a: float, b: float, c: float) -> list[float]:
    """The vector that changes neither the sum nor the token total of three documents of a, b and c tokens."""
    return [c - b, a - c, b - a] if a != b or b != c else [1.0, -1.0, 0.0]


def flight(p: np.ndarray, tokens: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after the flight: all but two at most are 0 or 1, sums of p and of p * tokens are as before."""
    out, t = p.astype(float).tolist(), (tokens / max(float(tokens.mean()) if len(tokens) else 1.0, 1e-12)).tolist()
    draws = iter(np.random.default_rng(seed).random(len(out) + 4).tolist())
    pool: list[int] = []
    for i, x in enumerate(out):
        if not _EPS <= x <= 1 - _EPS:
            out[i] = 0.0 if x < 0.5 else 1.0
            continue
        pool.append(i)
        if len(pool) == 3:
            u = _null(*(t[k] for k in pool))
            now = [out[k] for k in pool]
            _move(now, u, next(draws))
            for k, x in zip(pool, now, strict=True):
                out[k] = x
            pool = [k for k in pool if 0 < out[k] < 1]
    return np.array(out)


def land(p: np.ndarray, seed: int) -> np.ndarray:
    """0 or 1 for each: the sum of p is kept until one is left."""
    out, rng = p.astype(float).tolist(), np.random.default_rng(seed)
    while len(open_ := [i for i, x in enumerate(out) if 0 < x < 1]) > 1:
        now = [out[i] for i in open_[:2]]
        _move(now, [1.0, -1.0], float(rng.random()))
        out[open_[0]], out[open_[1]] = now
    for i in open_:
        out[i] = float(rng.random() < out[i])
    return np.array(out)


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "little")


def _flights(seed: str, level: int, last: bool):  # noqa: ANN202
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["key", "n_tokens", "row"], kind="stable")
        own = _seed(seed, level, *(None if pd.isna(k) else k if isinstance(k, str) else int(k) for k in key))
        p = flight(df["p"].to_numpy(), df["n_tokens"].to_numpy(), own)
        return df.assign(p=land(p, own + 1) if last else p)[["row", "key", "source", "n_tokens", "pi", "p"]]

    return run


def _tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def _drawn(rows: DataFrame, weights: dict[Any, float] | None, alpha: float, budget: float, seed: str, over: float) -> DataFrame:
    """row, source, n_tokens, pi and p (0 or 1) of every row. rows must be a written table of row, key, source, n_tokens."""
    got = rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()
    pi = probabilities({r["source"]: r["t"] for r in got}, weights, alpha, budget, over)
    held = {r["source"]: r["n"] for r in got}
    rates = rows.sparkSession.createDataFrame([(k, v, -(-held[k] // ROWS_PER_PIECE)) for k, v in pi.items()], "s string, pi double, pieces bigint")
    if len(pi) <= MAX_BROADCAST:
        rates = F.broadcast(rates)
    d = rows.join(rates, F.col("source").eqNullSafe(F.col("s"))).select("row", "key", "source", "n_tokens", "pi", F.col("pi").alias("p"), "pieces")
    out = d.filter("pi = 0 or pi = 1").drop("pieces")
    open_, level = d.filter("pi > 0 and pi < 1"), 0
    pieces, most = F.col("pieces"), max(held.values(), default=0)
    while True:
        flown = common.materialise(open_.groupBy("source", F.pmod(F.xxhash64("key", F.lit(level)), pieces).alias("piece")).applyInPandas(_flights(seed, level, False), _STATE), "flight")
        out, open_, level = out.unionByName(flown.filter("p = 0 or p = 1")), flown.filter("p > 0 and p < 1"), level + 1
        most = 2 * -(-most // ROWS_PER_PIECE)  # a piece leaves two at most
        if most <= ROWS_PER_PIECE:
            break
        pieces = F.lit(-(-most // ROWS_PER_PIECE))
    return out.unionByName(open_.groupBy("source").applyInPandas(_flights(seed, level, True), _STATE))


def _key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def sample(docs: DataFrame, weights: dict[Any, float] | None = None, alpha: float = ALPHA, budget: float = BUDGET, seed: str = SEED, over: float = OVER) -> DataFrame:
    """doc_id, source, n_tokens, pi and selected of every document."""
    d = common.project(docs, ["doc_id", "text", "source"], {"source": "string"})
    rows = common.materialise(d.select(F.monotonically_increasing_id().alias("row"), _key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "source", _tokens(F.col("text")).alias("n_tokens")), "tokens")
    out = _drawn(rows.drop("doc_id"), weights, alpha, budget, seed, over).select("row", "pi", (F.col("p") == 1).alias("selected"))
    return rows.join(out, "row").select("doc_id", "source", "n_tokens", "pi", "selected")


def mixed(docs: DataFrame, weights: dict[Any, float] | None = None, alpha: float = ALPHA, budget: float = BUDGET, seed: str = SEED, over: float = OVER) -> DataFrame:
    """docs with all its columns, the documents that are drawn."""
    d, cols, at = common.positional(docs)
    rows = common.materialise(d.withColumn(common.ROW_ID, F.monotonically_increasing_id()).withColumn("nf_tokens", _tokens(F.col(at["text"]))).withColumn("nf_key", _key(F.col(at["doc_id"]), F.col(at["text"]))), "rows")
    slim = rows.select(F.col(common.ROW_ID).alias("row"), F.col("nf_key").alias("key"), F.col(at["source"]).cast("string").alias("source"), F.col("nf_tokens").alias("n_tokens"))
    drawn = _drawn(slim, weights, alpha, budget, seed, over).filter("p = 1").select(F.col("row").alias(common.ROW_ID)).hint("shuffle_hash")  # grows with the input, however well sorted numbers compress
    return rows.join(drawn, common.ROW_ID, "left_semi").select(*d.columns).toDF(*cols)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(common.table(spark, sf_dir, "documents"))
