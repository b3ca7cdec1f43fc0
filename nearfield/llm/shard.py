"""Operator 3, sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is (rank - 1/2) / rows of its
source. In the order of (fractional rank, source), any stretch holds each source in its share, so cutting that order
into equal pieces gives shards that match the mixture: row number p, from 0, of N goes to shard floor(p * n_shards / N).

Nothing is ordered as a whole. A rank is the number of rows in lower buckets of the hash (a small table of counts)
plus the rank within the bucket, so a source that holds most rows is still spread over as many tasks as it has
buckets. The cuts follow from the sources' sizes alone: they are found by bisection on the driver, and a row is
compared only with those that its fractional rank allows.

Cases: null sources form one source of their own, sorted first. A null doc_id is hashed as the empty text. Rows that
tie (the same source and doc_id) take neighbouring ranks, in either order; each gets one. An empty table gives an
empty one. Extra columns are ignored by :func:`assign` and kept by :func:`interleave`, which adds ``shard`` and
``shard_order`` (input columns of these names give way).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

N_SHARDS = 64
SEED = "interleave-1"
ROWS_PER_BUCKET = 20_000
BROADCAST_BUCKETS = 100_000  # the table of counts by source and bucket is broadcast up to so many rows, else joined by a shuffle


def _key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _before(t: float, n: np.ndarray) -> np.ndarray:
    """Of sources with n rows, how many rows have a fractional rank, as a double, below t."""
    value = lambda r: (2.0 * r - 1.0) / (2.0 * n)
    r = np.clip(np.floor(t * n + 0.5), 0, n)
    for _ in range(3):
        r = np.where((r > 0) & (value(r) >= t), r - 1, r)
        r = np.where((r < n) & (value(r + 1) < t), r + 1, r)
    return r.astype(np.int64)


def cuts(sizes: list[int], n_shards: int) -> list[tuple[float, int]]:
    """For each shard but the first, the (fractional rank, number of the source from 0) of its first row."""
    n = np.asarray(sizes, np.float64)
    total = sum(sizes)
    out = []
    for k in range(1, n_shards):
        p = -(-k * total // n_shards)
        if p >= total:
            out.append((math.inf, 0))
            continue
        lo, hi = 0, int(np.float64(1.0).view(np.int64))  # doubles from 0 to 1 are ordered as their bits are
        while hi - lo > 1:  # the largest t with at most p rows below it
            mid = (lo + hi) // 2
            if _before(float(np.int64(mid).view(np.float64)), n).sum() <= p:
                lo = mid
            else:
                hi = mid
        t = float(np.int64(lo).view(np.float64))
        below = _before(t, n)
        nxt = np.minimum(below + 1, n)
        tied = np.flatnonzero((below < n) & ((2.0 * nxt - 1.0) / (2.0 * n) == t))
        out.append((t, int(tied[p - below.sum()])))
    return out


def _place(df: DataFrame, doc_id: str, source: str, n_shards: int, seed: str) -> tuple[DataFrame, Column, Column]:
    """df with working columns (all named nf_...), and the columns of shard and fractional rank."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    slim = df.select(F.col(doc_id).alias("d"), F.col(source).cast("string").alias("s"))
    counted = slim.groupBy("s").count().orderBy(F.col("s").asc_nulls_first()).collect()
    total, n_sources = sum(r["count"] for r in counted), len(counted)
    buckets = max(1, -(-total // ROWS_PER_BUCKET))
    spark = df.sparkSession

    def bucket(key: Column) -> Column:
        return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * F.lit(buckets) / F.lit(1 << 32)).cast("int")

    sources = spark.createDataFrame([(r["s"], r["count"], k) for k, r in enumerate(counted)], "nf_s string, nf_n bigint, nf_k int")
    lower = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    below = (
        slim.groupBy("s", bucket(_key(F.col("d"), seed)).alias("b")).count()
        .select("s", "b", F.coalesce(F.sum("count").over(lower), F.lit(0)).alias("nf_below"))
        .join(F.broadcast(sources) if n_sources <= BROADCAST_BUCKETS else sources, F.col("s").eqNullSafe(F.col("nf_s")))
        .select("nf_s", F.col("b").alias("nf_b2"), "nf_below", "nf_n", "nf_k")
    )
    if n_sources * buckets <= BROADCAST_BUCKETS:
        below = F.broadcast(below)
    work = df.withColumn("nf_key", _key(F.col(doc_id), seed)).withColumn("nf_b", bucket(F.col("nf_key"))).withColumn("nf_src", F.col(source).cast("string"))
    work = work.withColumn("nf_local", F.row_number().over(Window.partitionBy("nf_src", "nf_b").orderBy("nf_key", doc_id)))
    work = work.join(below, F.col("nf_src").eqNullSafe(F.col("nf_s")) & (F.col("nf_b") == F.col("nf_b2")))
    rank = (F.col("nf_below") + F.col("nf_local")).cast("double")
    work = work.withColumn("nf_f", (2.0 * rank - 1.0) / (2.0 * F.col("nf_n").cast("double")))
    if not total or n_shards == 1:
        return work, F.lit(0), F.col("nf_f")
    # cut i stands between shards i and i+1; by proportion a row's place is within n_sources of f * total
    edge = cuts([r["count"] for r in counted], n_shards)
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, k in edge])
    slack = math.ceil(n_sources * n_shards / total) + 1
    first = F.greatest(F.floor(F.col("nf_f") * n_shards).cast("int") - slack, F.lit(0))
    near = F.slice(table, first + 1, F.lit(2 * slack + 2))
    passed = F.filter(near, lambda c: (c["t"] < F.col("nf_f")) | (c["t"] == F.col("nf_f")) & (c["k"] <= F.col("nf_k")))
    return work, F.least(first, F.lit(n_shards - 1)) + F.size(passed), F.col("nf_f")


def assign(docs: DataFrame, n_shards: int = N_SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, shard and shard_order (the fractional rank, by which a shard is to be read) of every row."""
    work, shard, order = _place(common.project(docs, ["doc_id", "source"]), "doc_id", "source", n_shards, seed)
    return work.select("doc_id", "source", shard.cast("int").alias("shard"), order.alias("shard_order"))


def interleave(docs: DataFrame, n_shards: int = N_SHARDS, seed: str = SEED) -> DataFrame:
    """docs with all its columns, and shard and shard_order."""
    d, cols, at = common.positional(docs)
    work, shard, order = _place(d, at["doc_id"], at["source"], n_shards, seed)
    kept = [(f"c{i}", c) for i, c in enumerate(cols) if c.lower() not in ("shard", "shard_order")]
    return work.select(*[F.col(a) for a, _ in kept], shard.cast("int"), order).toDF(*[c for _, c in kept], "shard", "shard_order")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(common.table(spark, sf_dir, "documents"))


SQL = f"""
WITH ranked AS (
  SELECT doc_id, source,
         (2.0::DOUBLE * row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), doc_id) - 1.0)
           / (2.0::DOUBLE * count(*) OVER (PARTITION BY source)) AS shard_order
  FROM documents)
SELECT doc_id, source, (((row_number() OVER (ORDER BY shard_order, source NULLS FIRST) - 1) * {N_SHARDS}) // count(*) OVER ())::INT AS shard, shard_order
FROM ranked
"""
