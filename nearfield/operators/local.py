"""Joins and windows on local features (anchors and dense hashes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions import bits, scores, stats
from nearfield.plans.policy import Threshold


def occupancy(fp: DataFrame, hash_: str) -> DataFrame:
    """Buckets of a segment index: number, entries, least, most, mean and percentiles (rank rounded up)."""
    n = fp.select(F.explode(bits.segments(F.col(hash_))).alias("slot")).groupBy("slot").count()
    v = F.sort_array(F.collect_list("count")).alias("v")
    d = n.agg(v)
    total = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.select(F.size("v").cast("bigint").alias("buckets"), total.alias("entries"), F.col("v")[0].alias("least"), F.element_at("v", -1).alias("most"), F.round(total / F.size("v"), 6).alias("mean"), *[stats.rank_ceil(F.col("v"), p).alias(f"p{p}") for p in (50, 90, 95, 99)])


def bucket_hits(spec: DataFrame, cand: DataFrame, t: Threshold, most: int, seg_bits: int = 4, positions: bool = True, both_words: bool = True) -> DataFrame:
    """Feature pairs that share a segment of their first word, are within most bits and have like features.

    s_id, s_ord, id, ord, distance, quality, s_region. Anchors compare positions and both words, dense hashes neither.
    """
    side = lambda d, p: d.withColumn("slot", F.explode(bits.segments(F.col("hash"), seg_bits))).select(*[F.col(c).alias(f"{p}{c}") for c in d.columns], "slot")
    j = side(spec, "s_").join(side(cand, ""), "slot")
    if both_words:
        dist = bits.descriptor_distance(F.col("hash"), F.col("hash2"), F.col("s_hash"), F.col("s_hash2"))
    else:
        dist = bits.hamming(F.col("hash"), F.col("s_hash"))
    delta = lambda c: F.abs(F.col(c) - F.col(f"s_{c}"))
    ok = (delta("luma") <= t.luma_delta) & (delta("contrast") <= t.contrast_delta) & (delta("edge") <= t.edge_delta)
    if positions:
        ok = ok & (delta("pos_x") <= t.position_delta) & (delta("pos_y") <= t.position_delta)
    place = F.greatest(delta("pos_x"), delta("pos_y")) if positions else None
    quality = scores.hit_quality(dist, [delta("luma"), delta("contrast"), delta("edge")], place)
    return j.filter(ok & (dist <= most)).select("s_id", "s_ord", "id", "ord", dist.alias("distance"), quality.alias("quality"), F.col("s_region")).distinct()


def best_hits(hits: DataFrame) -> DataFrame:
    """The best hit of every reference feature in every candidate."""
    w = Window.partitionBy("id", "s_id", "s_ord").orderBy("quality", "distance", "ord")
    return hits.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def candidate_ranking(hits: DataFrame, k: int) -> DataFrame:
    """Of each candidate the k best specimens: hits, votes (distinct candidate features), quality."""
    g = best_hits(hits).groupBy("id", "s_id").agg(F.count("*").alias("hits"), F.countDistinct("ord").alias("votes"), F.sum("quality").alias("quality"))
    w = Window.partitionBy("id").orderBy(F.desc("hits"), F.desc("votes"), "quality", "s_id")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_distinct(hits: DataFrame, k: int = 3) -> DataFrame:
    """For each reference feature its k best distinct candidate features, and for each the least distance among the others."""
    w = Window.partitionBy("id", "s_id", "s_ord").orderBy("quality", "distance", "ord")
    before, behind = (F.min("distance").over(w.rowsBetween(*r)) for r in ((Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)))
    d = hits.withColumns({"rank": F.row_number().over(w), "second": F.least(before, behind)})
    return d.filter(F.col("rank") <= k)


def mutual_best(hits: DataFrame) -> DataFrame:
    """One correspondence for each candidate feature: the least distance, the first among equals."""
    w = Window.partitionBy("id", "s_id", "ord").orderBy("distance", "s_ord")
    return hits.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def unverified_support(hits: DataFrame, margin: int = 2) -> DataFrame:
    """raw_hits (reference features with a hit), hits (those with one that is margin nearer than the runner-up, of the
    three best the nearest), regions, mean distance, spread (the lesser side of their box in the candidate) and retention
    in permille of each pair that has any. hits needs pos_x and pos_y of the candidate's feature."""
    kept = F.col("second").isNull() | (F.col("second") - F.col("distance") >= margin)
    nearest = F.min(F.when(kept, F.struct("distance", "quality", "ord", "s_region", "pos_x", "pos_y"))).alias("b")
    t = top_distinct(hits, 3).groupBy("id", "s_id", "s_ord").agg(nearest)
    side = lambda c: F.max(f"b.{c}") - F.min(f"b.{c}")
    g = t.groupBy("id", "s_id").agg(F.count("*").alias("raw_hits"), F.count("b").alias("hits"), F.countDistinct("b.s_region").alias("regions"), F.round(F.avg("b.distance"), 6).alias("mean_distance"), F.least(side("pos_x"), side("pos_y")).cast("int").alias("spread"))
    return g.filter("hits > 0").withColumn("permille", F.floor(F.col("hits") * 1000 / F.col("raw_hits")).cast("int"))


def region_rounds(features: DataFrame, limit: int) -> DataFrame:
    """Selection in two rounds: first the best feature of each region, then all again in order, up to limit rows.

    The second round takes the first round's once more, as the original does.
    """
    first = features.withColumn("rn", F.row_number().over(Window.partitionBy("id", "region").orderBy(F.desc("score"), "ord"))).filter("rn = 1").drop("rn").withColumn("round", F.lit(0))
    both = first.unionByName(features.withColumn("round", F.lit(1)))
    w = Window.partitionBy("id").orderBy("round", F.desc("score"), "ord")
    return both.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def stride(rows: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """Where a group has more than cap rows, every ceil(n / cap)-th."""
    n = F.count("*").over(Window.partitionBy(group))
    d = rows.withColumns({"n": n, "rn": F.row_number().over(Window.partitionBy(group).orderBy(order))})
    step = F.when(F.col("n") > cap, F.ceil(F.col("n") / cap)).otherwise(1)
    return d.filter((F.col("rn") - 1) % step == 0)


def budget(rows: DataFrame, group: str, size: str, order: list[str], most: int) -> DataFrame:
    """The first most rows of each group, rare buckets first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(size, *order))).filter(F.col("place") <= most)
