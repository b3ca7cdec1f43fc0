"""Exact and Hamming joins, evidence, decisions and their explanation."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions import bits, scores
from nearfield.operators import tiles
from nearfield.plans.policy import Policy, Threshold

#: A side is broadcast for a nested loop only up to so many rows; beyond, segments are joined by a shuffle.
MAX_BROADCAST_ROWS = 200_000


def exact_pairs(items: DataFrame, key: Column, id_: str) -> DataFrame:
    """Each later copy with the least id of its content: candidate, specimen, score 10000.

    One aggregation and one equi-join on the content key, so copies of one content meet in one task only.
    """
    keyed = items.select(F.col(id_).alias("candidate"), key.alias("k")).filter("k is not null")
    first = keyed.groupBy("k").agg(F.min("candidate").alias("specimen"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(first, "k").filter("candidate <> specimen").select("candidate", "specimen", F.lit(10000.0).cast("float").alias("score"))


def all_pairs(spec: DataFrame, cand: DataFrame) -> DataFrame:
    """Every candidate with every specimen and both distances. The specimens are broadcast, their number is checked."""
    s = spec.select(*[F.col(c).alias(f"s_{c}") for c in spec.columns])
    if spec.count() <= MAX_BROADCAST_ROWS:
        s = F.broadcast(s)
    return cand.crossJoin(s).withColumns({"pd": bits.hamming(F.col("ph"), F.col("s_ph")), "dd": bits.hamming(F.col("dh"), F.col("s_dh"))})


def _masks(bits_: int, most: int) -> list[int]:
    return [sum(1 << i for i in c) for k in range(most + 1) for c in itertools.combinations(range(bits_), k)]


#: What a pair of a tile costs, of what a row of a join costs.
TILE_COST = 0.02


def _work(n_spec: int, n_cand: int, most: int) -> dict[tuple[int, int], float]:
    work = {}
    for width in (4, 8, 16):
        flips = most // (64 // width)
        probes = 64 // width * len(_masks(width, flips)) if flips < 4 else 1 << 40
        work[width, flips] = n_cand * probes + n_spec * n_cand * probes / 2.0**width + n_spec * 64 // width
    return work


def in_tiles(n_spec: int, n_cand: int, most: int) -> bool:
    """Whether comparing all pairs in tiles is less work than joining by segments that prune little."""
    return n_spec * n_cand * TILE_COST < min(_work(n_spec, n_cand, most).values())


def plan_segments(n_spec: int, n_cand: int, most: int) -> tuple[int, int]:
    """(bits of a segment, bits that may differ in it) with the least work: probes of the candidates and pairs to compare.

    Of 64 / b segments one differs in most // (64 / b) bits at most, where hashes differ in most bits.
    """
    work = _work(n_spec, n_cand, most)
    return min(work, key=work.get)


def segment_pairs(spec: DataFrame, cand: DataFrame, hash_: str, most: int, seg_bits: int | None = None) -> DataFrame:
    """Pairs within most bits by hash_, found by segments that differ in few bits: complete for any ``most`` up to 63.

    Specimens are looked up by their segments, candidates by theirs with up to so many bits flipped; only ids and hashes
    are exploded and shuffled. A pair is kept at the first of its segments that fits, so nothing has to be made distinct.
    Where segments prune too little (:func:`in_tiles`), all are compared in tiles, unless seg_bits are given.
    """
    n = (0, 0) if seg_bits else (spec.count(), cand.count())
    if not seg_bits and in_tiles(*n, most):
        cols = [F.col("id"), F.col(hash_).alias("h")]
        return tiles.near(cand.select(*cols), spec.select(*cols), [(most,)], ("h",), ("distance",)).select("id", "s_id", "distance")
    width, flips = (seg_bits, most // (64 // seg_bits)) if seg_bits else plan_segments(*n, most)
    slots = bits.segments(F.col(hash_), width)
    near = F.flatten(F.transform(slots, lambda s: F.transform(F.array(*[F.lit(m) for m in _masks(width, flips)]), lambda m: s.bitwiseXOR(m))))
    side = lambda d, p, at: d.select(F.col("id").alias(f"{p}id"), F.col(hash_).alias(f"{p}h"), F.explode(at).alias("slot"))
    hit = side(spec, "s_", slots).join(side(cand, "c_", near if flips else slots), "slot")
    x, own = F.col("c_h").bitwiseXOR(F.col("s_h")), F.shiftright("slot", width)
    first = F.lit(True)
    for k in range(64 // width):
        fits = F.bit_count(F.call_function("shiftrightunsigned", x, F.lit(64 - width * (k + 1))).bitwiseAND(F.lit((1 << width) - 1))) <= flips
        first = first & ~((own > k) & fits)
    d = F.bit_count(x)
    return hit.filter((d <= most) & first).select(F.col("c_id").alias("id"), F.col("s_id"), d.alias("distance"))


def near_pairs(fp: DataFrame, most_ph: int = 4, most_dh: int = 4, content: str | None = None) -> DataFrame:
    """Unordered pairs within both distances whose content differs (no cap on comparisons)."""
    hash_, most = ("ph", most_ph) if most_ph <= most_dh else ("dh", most_dh)
    fp = fp.select("id", "ph", "dh", (F.col(content) if content else F.lit(None)).alias("content"))
    n = fp.count()
    if most >= 16 or in_tiles(n, n, most):
        d = tiles.near(fp, None, [(most_ph, most_dh)])
    else:
        pairs = segment_pairs(fp, fp, hash_, most).filter("s_id < id").select("id", "s_id")
        left = fp.select(F.col("id").alias("s_id"), F.col("ph").alias("s_ph"), F.col("dh").alias("s_dh"), F.col("content").alias("s_content"))
        d = pairs.join(fp, "id").join(left, "s_id").withColumns({"pd": bits.hamming(F.col("ph"), F.col("s_ph")), "dd": bits.hamming(F.col("dh"), F.col("s_dh"))})
    other = ~F.coalesce(F.col("content") == F.col("s_content"), F.lit(False))
    return d.filter((F.col("pd") <= most_ph) & (F.col("dd") <= most_dh) & other).select(F.col("s_id").alias("id_a"), F.col("id").alias("id_b"), "pd", "dd")


def perceptual_evidence(pairs: DataFrame, t: Threshold, slack: int = 0) -> DataFrame:
    """Pairs that pass the hashes' limits (with slack) and the size's, with stage score and weighted score."""
    fits = scores.compatible(F.col("pd"), F.col("dd"), t, slack) & scores.geometry_compatible(F.col("s_width"), F.col("s_height"), F.col("width"), F.col("height"), t)
    stage = scores.perceptual(F.col("pd") + F.col("dd"), t)
    return pairs.filter(fits).select("id", "s_id", "pd", "dd", stage.alias("stage_score"), (stage * scores.f32(t.perceptual_weight)).cast("float").alias("score"))


def best(evidence: DataFrame) -> DataFrame:
    """Of each candidate the highest score; among equals the last specimen."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("s_id"))
    return evidence.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def top_specimens(evidence: DataFrame, k: int) -> DataFrame:
    """Of each candidate the k best specimens by hits, votes and quality."""
    w = Window.partitionBy("id").orderBy(F.desc("hits"), F.desc("votes"), "quality", "s_id")
    return evidence.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cascade(pairs: DataFrame, policy: Policy) -> DataFrame:
    """One decision for each candidate that matches: confirmed first, suspicious (near misses too) for what is left.

    Confirmed candidates leave before the second level is scored (left anti join).
    """
    yes = best(perceptual_evidence(pairs, policy.confirmed)).filter(F.col("score") >= scores.f32(policy.confirmed.score))
    yes = yes.withColumn("decision", F.lit("confirmed"))
    rest = pairs.join(yes.select("id"), "id", "left_anti")
    maybe = best(perceptual_evidence(rest, policy.suspicious, policy.suspicious.near_miss_slack)).filter(F.col("score") >= scores.f32(policy.suspicious.score))
    return yes.unionByName(maybe.withColumn("decision", F.lit("suspicious")))


def limits(t: Threshold, slack: int = 0) -> tuple[int, int, int]:
    """The hashes' limits, as :mod:`nearfield.operators.tiles` takes them."""
    return t.phash_max + slack, t.dhash_max + slack, t.total_max + slack


def nearest_for_levels(spec: DataFrame, cand: DataFrame, policy: Policy, last: bool) -> DataFrame:
    """Of each candidate the pairs that can be its best at either level: the nearest within its limits, of every block
    of specimens. Where the score doesn't fall any more (beyond the total) all are equally near for the last one to win."""
    out = None
    for t, slack in ((policy.confirmed, 0), (policy.suspicious, policy.suspicious.near_miss_slack)):
        total = np.add.outer(np.arange(65), np.arange(65))
        d = tiles.nearest(cand, spec, last=last, limits=[limits(t, slack)], sizes=t, rank=np.minimum(total, t.total_max) if last else total)
        out = d if out is None else out.unionByName(d)
    return out


def ranks(spark: SparkSession, score: Callable[[], Column]) -> np.ndarray:
    """[pd, dd]: the place of score among all values it can have, the highest first."""
    d = spark.range(65 * 65).select("id", F.floor(F.col("id") / 65).cast("int").alias("pd"), (F.col("id") % 65).cast("int").alias("dd")).select("id", score())
    v = np.array([r[1] for r in sorted(d.collect())])
    return np.unique(-v, return_inverse=True)[1].reshape(65, 65)


def explain(spec: DataFrame, cand: DataFrame, policy: Policy) -> DataFrame:
    """For each candidate and level the nearest specimen, whether it passed, and why not.

    The nearest that passes and the nearest of all are found in tiles; what is left are a few pairs of each candidate.
    """
    pairs = tiles.nearest(cand, spec).unionByName(nearest_for_levels(spec, cand, policy, last=False))
    best = []
    for name, t, slack in (("confirmed", policy.confirmed, 0), ("suspicious", policy.suspicious, policy.suspicious.near_miss_slack)):
        near = scores.compatible(F.col("pd"), F.col("dd"), t, slack)
        size = scores.geometry_compatible(F.col("s_width"), F.col("s_height"), F.col("width"), F.col("height"), t)
        reason = F.when(near & size, F.when(scores.compatible(F.col("pd"), F.col("dd"), t), "within limits").otherwise("near miss")).when(near, "size").when(size, "distance").otherwise("distance and size")
        best.append(F.min_by(F.struct(F.lit(name).alias("level"), "s_id", "pd", "dd", reason.alias("reason")), F.struct((~(near & size)).cast("int"), F.col("pd") + F.col("dd"), "s_id")).alias(name))
    rows = pairs.groupBy("id").agg(*best).select("id", F.explode(F.array("confirmed", "suspicious")).alias("b"))
    return rows.select("id", "b.level", F.lit(spec.count()).cast("bigint").alias("considered"), "b.s_id", "b.pd", "b.dd", "b.reason", F.col("b.reason").isin("within limits", "near miss").alias("passed"))
