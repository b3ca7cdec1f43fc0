"""Queries on local features, geometry and pixels, and SQL where it can express them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from nearfield.operators import cascade, features, fingerprints, graph, local, matching, pixels, tiles
from nearfield.plans.policy import Shape, Threshold

from . import matching as plans
from .tables import load

T = replace(Threshold(), luma_delta=90, contrast_delta=90, edge_delta=90, position_delta=120)
MOST, DENSE_MOST = 23, 20


def _sides(spark, sf):
    return fingerprints.split(fingerprints.local_features(load(spark, sf, "embeddings")))


def anchor_bucket_join(spark, sf):
    return features.hits(*_sides(spark, sf), T, MOST)


def dense_bucket_join(spark, sf):
    return features.hits(*_sides(spark, sf), T, DENSE_MOST, 8, positions=False, both_words=False).drop("s_region")


def anchor_ranking(spark, sf):
    return features.ranking(*_sides(spark, sf), T, MOST, 32)


def anchor_runner_up(spark, sf):
    return features.top_distinct(*_sides(spark, sf), T, MOST)


def mutual_best(spark, sf):
    return features.mutual_best(*_sides(spark, sf), T, MOST)


def unverified_support(spark, sf):
    return features.unverified_support(*_sides(spark, sf), T, MOST)


_W = plans.WIDE
FULL = replace(
    _W, confirmed=replace(_W.confirmed, score=66.0, min_hits=4, min_regions=2, max_mean_distance=23.0, full_hits=8, full_regions=8, full_spread=200.0),
    suspicious=replace(_W.suspicious, score=45.0, min_hits=3, min_regions=2, max_mean_distance=23.0, full_hits=8, full_regions=8, full_spread=200.0, support_hits=2, support_regions=2, support_mean=22.0, support_total=64),
    cluster_member=72, cluster_coherence=70, shape=Shape(min_luma=60, max_luma=150, min_std=100, max_std=200, min_text=24, max_text=170, max_rgb_spread=70, min_local=1, min_signals=3, full=20_000.0),
)


def _cascade(spark, sf, verified):
    """Exact pairs, all pairs that can count, edges of specimens, verified geometry (anchors, dense) and support."""
    fp = plans.fps(spark, sf).withColumn("n_local", F.lit(fingerprints.HOTS))
    spec, cand = fingerprints.split(fp)
    cols = ["id", "ph", "dh", "width", "height"]
    spec, cand = spec.select(*cols), cascade.with_shape(cand, FULL.shape, FULL.suspicious).select(*cols, "bonus")
    # every fifth candidate is a copy of the specimen behind it
    key = F.md5(F.when(F.col("id") % 25 == 0, F.col("id") + 1).otherwise(F.col("id")).cast("string"))
    exact = cand.select(F.col("id").alias("candidate"), key.alias("k")).join(spec.select(F.col("id").alias("specimen"), key.alias("k")), "k")
    # each is read several times, and costs a comparison of all pairs
    shaped = cand.filter("bonus is not null").select("id")
    support = graph.cut(cascade.worth(unverified_support(spark, sf), FULL.suspicious).join(shaped, "id", "left_semi"))
    anchors, dense = (graph.cut(geometry_verify(spark, sf)), graph.cut(_dense_verified(spark, sf))) if verified else (None, None)
    found = [support, *(cascade.accepted(v, t) for v in (anchors, dense) if v is not None for t in (FULL.confirmed, FULL.suspicious))]
    pairs = graph.cut(cascade.evidence_pairs(spec, cand, FULL, *found))
    return exact, pairs, graph.coherence_edges(spec, plans._COH, max(42, FULL.cluster_coherence)), anchors, dense, support


def cascade_full(spark, sf):
    """All stages, local anchors and dense hashes with verified geometry."""
    exact, pairs, edges, anchors, dense, support = _cascade(spark, sf, True)
    d = cascade.decide(exact, pairs, FULL, edges, anchors, dense, support)
    return d.withColumn("score", F.round(F.col("score").cast("double"), 2))


def cascade_unverified(spark, sf):
    """All stages but verified geometry, which SQL can't express: exact, hashes, unverified support, shape and clusters."""
    exact, pairs, edges, _, _, support = _cascade(spark, sf, False)
    d = cascade.decide(exact, pairs, FULL, edges, None, None, support)
    return d.withColumn("score", F.round(F.col("score").cast("double"), 2))


def cascade_full_explain(spark, sf):
    """Best specimen and score of every candidate after each stage of the confirmed level, and at the suspicious one."""
    _, pairs, _, anchors, dense, support = _cascade(spark, sf, True)
    steps = cascade.confirmed_steps(pairs, anchors, dense, FULL.confirmed).select("id", F.lit("confirmed").alias("level"), "step", "stage", "s_id", "score", "passed")
    maybe = cascade.suspicious_scores(pairs, anchors, dense, support, FULL.suspicious).groupBy("id").agg(F.max(F.struct("score", "s_id", "top")).alias("b"))
    maybe = maybe.select("id", F.lit("suspicious").alias("level"), F.lit(1).alias("step"), F.col("b.top").alias("stage"), "b.s_id", "b.score", (F.col("b.score") >= F.lit(FULL.suspicious.score).cast("float")).alias("passed"))
    return steps.unionByName(maybe).withColumn("score", F.round(F.col("score").cast("double"), 2))


def visual_shape(spark, sf):
    d = cascade.with_shape(plans.fps(spark, sf).withColumn("n_local", F.lit(fingerprints.HOTS)), FULL.shape, FULL.suspicious)
    return d.select("id", F.round(F.col("bonus").cast("double"), 3).alias("bonus"), cascade.text_stats(F.col("grid")).alias("t")).select("id", "bonus", "t.*")


def ring_region_select(spark, sf):
    f = fingerprints.local_features(load(spark, sf, "embeddings")).select("id", "ord", "region", F.col("edge").alias("score"))
    return local.region_rounds(f, 10).select("id", "ord", "region", "round", "place")


def geometry_verify(spark, sf):
    return features.verified(*_sides(spark, sf), T, MOST)


def _dense_verified(spark, sf):
    return features.verified(*_sides(spark, sf), T, DENSE_MOST, 8, positions=False, both_words=False, single=True)


def phash_dhash(spark, sf):
    return pixels.image_hashes(plans.fps(spark, sf))


def orb_features(spark, sf):
    return pixels.image_features(plans.fps(spark, sf))


def cluster_promotion(spark, sf):
    """Members from a score of 42 (100 less both distances), links of 50 or more."""
    spec, cand = plans.sides(spark, sf)
    return tiles.promotion(cand, spec, 100 - 42, graph.farthest(spec, plans._COH, 50), 2)


QUERIES = {f.__name__: f for f in (cascade_full, cascade_unverified, cascade_full_explain, visual_shape, anchor_bucket_join, dense_bucket_join, anchor_ranking, anchor_runner_up, mutual_best, unverified_support, ring_region_select, geometry_verify, phash_dhash, orb_features, cluster_promotion)}


def _bits(k: int, s: int, h: int) -> str:
    return plans._half(f"embedding[(i + {8 * k + s}) % 64 + 1] > embedding[i + 1]", h)


_LOCAL = "lf AS (" + " UNION ALL ".join(
    f"SELECT id, {k} AS ord, {_bits(k, 3, 0)} AS a0, {_bits(k, 3, 1)} AS a1, {_bits(k, 5, 0)} AS b0, {_bits(k, 5, 1)} AS b1, grid[{k + 1}] AS x, grid[{k + 9}] AS y, grid[{k + 17}] AS luma, grid[{k + 25}] AS contrast, grid[{k + 33}] AS edge, grid[{k + 41}] % 64 AS region FROM g" for k in range(8)
) + ")"
_G = "g AS (SELECT vec_id AS id, embedding, list_transform(embedding, lambda e: least(255, greatest(0, floor(e::DOUBLE * 40.0 + 128.0)))::INT) AS grid FROM embeddings)"
_D = lambda c: f"abs(s.{c} - c.{c})"
_SHARE4 = " OR ".join(f"((s.a{h} >> {28 - 4 * k}) & 15) = ((c.a{h} >> {28 - 4 * k}) & 15)" for h in (0, 1) for k in range(8))
_SHARE8 = " OR ".join(f"((s.a{h} >> {24 - 8 * k}) & 255) = ((c.a{h} >> {24 - 8 * k}) & 255)" for h in (0, 1) for k in range(4))
_H1 = "(bit_count(xor(s.a0, c.a0)) + bit_count(xor(s.a1, c.a1)))"
_H2 = "(bit_count(xor(s.b0, c.b0)) + bit_count(xor(s.b1, c.b1)))"
_FEAT = f"least(255, {_D('luma')} + {_D('contrast')} + {_D('edge')}) // 8"
_LIKE = f"{_D('luma')} <= {T.luma_delta} AND {_D('contrast')} <= {T.contrast_delta} AND {_D('edge')} <= {T.edge_delta}"
_HITS = f"""WITH {_G}, {_LOCAL}, hits AS (SELECT s.id AS s_id, s.ord AS s_ord, c.id, c.ord, (({_H1} + {_H2} + 1) // 2)::INT AS distance,
  ((({_H1} + {_H2} + 1) // 2) * 4 + {_FEAT} + greatest({_D('x')}, {_D('y')}))::INT AS quality, s.region AS s_region FROM lf s, lf c
  WHERE s.id % 5 <> 0 AND c.id % 5 = 0 AND ({_SHARE4}) AND ({_H1} + {_H2} + 1) // 2 <= {MOST} AND {_LIKE} AND {_D('x')} <= {T.position_delta} AND {_D('y')} <= {T.position_delta})"""
_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY id, s_id, s_ord ORDER BY quality, distance, ord) AS rank FROM hits), t AS (SELECT r.*, (SELECT min(o.distance) FROM hits o WHERE o.id = r.id AND o.s_id = r.s_id AND o.s_ord = r.s_ord AND o.ord <> r.ord) AS second FROM r)"
_SUPPORT = """k AS (SELECT * FROM t WHERE rank <= 3), raw AS (SELECT id, s_id, count(DISTINCT s_ord) AS raw_hits FROM k GROUP BY ALL),
  kept AS (SELECT k.*, lf.x, lf.y FROM k JOIN lf ON lf.id = k.id AND lf.ord = k.ord WHERE second IS NULL OR second - distance >= 2 QUALIFY row_number() OVER (PARTITION BY k.id, s_id, s_ord ORDER BY distance, quality, k.ord) = 1),
  sup AS (SELECT id, s_id, raw_hits, count(*) AS hits, count(DISTINCT s_region) AS regions, round(avg(distance), 6) AS mean_distance, least(max(x) - min(x), max(y) - min(y))::INT AS spread, (count(*) * 1000 // raw_hits)::INT AS permille FROM kept JOIN raw USING (id, s_id) GROUP BY id, s_id, raw_hits)"""

ORACLE_SQL = {
    "anchor_bucket_join": f"{_HITS} SELECT * FROM hits",
    "dense_bucket_join": f"WITH {_G}, {_LOCAL} SELECT s.id AS s_id, s.ord AS s_ord, c.id, c.ord, {_H1}::INT AS distance, ({_H1} * 4 + {_FEAT})::INT AS quality FROM lf s, lf c WHERE s.id % 5 <> 0 AND c.id % 5 = 0 AND ({_SHARE8}) AND {_H1} <= {DENSE_MOST} AND {_LIKE}",
    "anchor_ranking": f"{_HITS}, b AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY id, s_id, s_ord ORDER BY quality, distance, ord) = 1), q AS (SELECT id, s_id, count(*) AS hits, count(DISTINCT ord) AS votes, sum(quality)::BIGINT AS quality FROM b GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, votes DESC, quality, s_id) AS rank FROM q QUALIFY rank <= 32",
    "anchor_runner_up": f"{_HITS}, {_RANKED} SELECT id, s_id, s_ord, ord, rank, second FROM t WHERE rank <= 3",
    "mutual_best": f"{_HITS} SELECT id, s_id, ord, s_ord, distance FROM hits QUALIFY row_number() OVER (PARTITION BY id, s_id, ord ORDER BY distance, s_ord) = 1",
    "unverified_support": f"{_HITS}, {_RANKED}, {_SUPPORT} SELECT * FROM sup",
    "ring_region_select": f"WITH {_G}, {_LOCAL}, f AS (SELECT id, ord, region, edge AS score FROM lf), a AS (SELECT *, 0 AS round FROM f QUALIFY row_number() OVER (PARTITION BY id, region ORDER BY score DESC, ord) = 1), u AS (SELECT * FROM a UNION ALL SELECT *, 1 FROM f) SELECT id, ord, region, round, row_number() OVER (PARTITION BY id ORDER BY round, score DESC, ord) AS place FROM u QUALIFY place <= 10",
}
ORACLE_SQL["cluster_promotion"] = f"""WITH RECURSIVE {plans.FP}, {plans.PAIRS}, m AS (SELECT id, s_id FROM pairs WHERE 100 - pd - dd >= 42), e0 AS (SELECT a, b FROM ({plans.ORACLE_SQL['coherence_edges']}) WHERE weight >= 50), e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
  r AS (SELECT id, s_id AS node, s_id AS root FROM m UNION SELECT r.id, x.s_id, r.root FROM r JOIN e ON r.node = e.a JOIN m x ON x.id = r.id AND x.s_id = e.b),
  c AS (SELECT id, root, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT id, count(*)::INT AS members FROM m GROUP BY id) SELECT k.id, members, max(n)::INT AS largest, max(n) >= 2 AS promoted FROM k JOIN c USING (id) GROUP BY k.id, members"""

_SH, _FS, _FC = FULL.shape, FULL.suspicious, FULL.confirmed
_SHAPE = f"""tx AS (SELECT *, list_sum(grid)::BIGINT AS every, len(list_filter(grid, lambda v: v >= 64)) AS regions, list_sum(grid[17:48])::BIGINT AS mid,
    list_sum(list_transform(range(64), lambda i: CASE WHEN i % 8 >= 2 AND i % 8 < 6 THEN grid[i + 1] ELSE 0 END))::BIGINT AS cen, list_sum(list_transform(range(64), lambda i: CASE WHEN i % 8 < 2 THEN grid[i + 1] ELSE 0 END))::BIGINT AS lef,
    list_sum(list_transform(range(64), lambda i: CASE WHEN i % 8 >= 6 THEN grid[i + 1] ELSE 0 END))::BIGINT AS rig, grid[4] AS luma, grid[5] AS std, greatest(grid[1], grid[2], grid[3]) - least(grid[1], grid[2], grid[3]) AS rgb FROM fx),
  ts AS (SELECT *, (every // 64)::INT AS mean, (mid * 100 // greatest(every, 1))::INT AS middle, (cen * 100 // greatest(every, 1))::INT AS center, (greatest(lef, rig) * 100 // greatest(every, 1))::INT AS edge FROM tx),
  sg AS (SELECT *, regions >= {_SH.min_regions} AND mean >= {_SH.min_text} AS g1, std BETWEEN {_SH.min_std} AND {_SH.max_std} AS g2, luma BETWEEN {_SH.min_luma} AND {_SH.max_luma} AS g3, 8 >= {_SH.min_local} AS g4, luma <= {_SH.sparse_luma} AND mean <= {_SH.sparse_text} AND 8 >= {_SH.sparse_local} AS g5,
    least(width, height) >= {_FS.min_short_edge} AND width * height >= {_FS.min_area} AND greatest(width, height)::FLOAT / least(width, height)::FLOAT <= {_FS.max_aspect}::FLOAT AND luma <= {_SH.max_luma} AND std <= {_SH.max_std} AND mean <= {_SH.max_text}
      AND middle >= {_SH.min_middle} AND center BETWEEN {_SH.min_center} AND {_SH.max_center} AND edge <= {_SH.max_edge} AND rgb <= {_SH.max_rgb_spread} AS base FROM ts),
  sp AS (SELECT id, mean, regions, middle, center, edge, CASE WHEN base AND (g1 OR g5) AND (g1::INT + g2::INT + g3::INT + g4::INT + g5::INT >= {_SH.min_signals} OR g5) THEN
    least((least(greatest((CASE WHEN g1 THEN mean + regions * 8 ELSE 0 END + CASE WHEN g2 THEN std ELSE 0 END + CASE WHEN g3 THEN 40 ELSE 0 END + CASE WHEN g4 THEN 8 ELSE 0 END + CASE WHEN g5 THEN 128 ELSE 0 END)::FLOAT / {_SH.full}::FLOAT, 0::FLOAT), 1::FLOAT) * 100::FLOAT)::FLOAT, {_SH.cap}::FLOAT) END AS bonus FROM sg)"""
ORACLE_SQL["visual_shape"] = f"WITH {plans.FP}, {_SHAPE} SELECT id, round(bonus::DOUBLE, 3) AS bonus, mean, regions::INT AS regions, middle, center, edge FROM sp"
_up = lambda v, full: f"(least(greatest(({v})::FLOAT / {full}::FLOAT, 0::FLOAT), 1::FLOAT) * 100::FLOAT)::FLOAT"
_LSCORE = f"((({_up('hits', _FS.full_hits)} * 0.5::FLOAT)::FLOAT + ({_up('regions', _FS.full_regions)} * 0.18::FLOAT)::FLOAT)::FLOAT + ({_up('spread', _FS.full_spread)} * 0.14::FLOAT)::FLOAT + (((1::FLOAT - least(greatest(mean_distance::FLOAT / {_FS.max_mean_distance}::FLOAT, 0::FLOAT), 1::FLOAT)) * 100::FLOAT) * 0.1::FLOAT)::FLOAT)::FLOAT"
_asp = lambda p: f"(greatest({p}width, {p}height)::FLOAT / least({p}width, {p}height)::FLOAT)"
ORACLE_SQL["cascade_unverified"] = f"""WITH RECURSIVE {plans.FP}, {plans.PAIRS}, {_HITS[5:]}, {_RANKED}, {_SUPPORT}, {_SHAPE},
  ex AS (SELECT id, id + 1 AS s_id FROM fp WHERE id % 25 = 0 AND id + 1 IN (SELECT id FROM fp)), r1 AS (SELECT * FROM pairs WHERE id NOT IN (SELECT id FROM ex)),
  e1 AS ({plans.sql_evidence(_FC, 0, 'r1')}), b1 AS ({plans.sql_best('e1')}), yes AS (SELECT id, s_id, score FROM b1 WHERE score >= {_FC.score}::FLOAT),
  r2 AS (SELECT r1.*, bonus FROM r1 JOIN sp USING (id) WHERE id NOT IN (SELECT id FROM yes)),
  pe AS (SELECT id, s_id, bonus, {plans.sql_stage(_FS)} AS st, ({plans.sql_stage(_FS)} * {_FS.perceptual_weight}::FLOAT)::FLOAT AS p FROM r2 WHERE ({plans.sql_near(_FS)} OR bonus IS NOT NULL AND {plans.sql_near(_FS, _FS.near_miss_slack)}) AND {plans.sql_geometry(_FS)}),
  ae AS (SELECT id, s_id, bonus, {_LSCORE} AS st, ({_LSCORE} * {_FS.anchor_weight}::FLOAT)::FLOAT AS a FROM r2 JOIN sup USING (id, s_id) WHERE bonus IS NOT NULL AND hits >= {_FS.support_hits} AND regions >= {_FS.support_regions} AND mean_distance <= {_FS.support_mean} AND hits * 1000 >= {_FS.support_permille} * raw_hits AND pd + dd <= {_FS.support_total}
    AND least(width, height) >= {_FS.min_short_edge} AND width * height >= {_FS.min_area} AND {_asp('')} <= {_FS.max_aspect}::FLOAT AND abs({_asp('s_')} - {_asp('')}) <= {_FS.support_aspect}::FLOAT AND abs(width::FLOAT / s_width::FLOAT - 1::FLOAT) <= {_FS.support_dimension}::FLOAT AND abs(height::FLOAT / s_height::FLOAT - 1::FLOAT) <= {_FS.support_dimension}::FLOAT),
  sc AS (SELECT coalesce(pe.id, ae.id) AS id, coalesce(pe.s_id, ae.s_id) AS s_id, ((coalesce(pe.bonus, ae.bonus, 0::FLOAT) + coalesce(p, 0::FLOAT))::FLOAT + coalesce(a, 0::FLOAT))::FLOAT AS score, CASE WHEN ae.st IS NULL OR pe.st >= ae.st THEN 'perceptual' ELSE 'anchors' END AS top FROM pe FULL JOIN ae ON pe.id = ae.id AND pe.s_id = ae.s_id),
  b2 AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, s_id DESC) = 1), m AS (SELECT id, s_id FROM sc WHERE round(score::DOUBLE) >= {FULL.cluster_member}),
  e0 AS (SELECT a, b FROM ({plans.ORACLE_SQL['coherence_edges']}) WHERE weight >= {FULL.cluster_coherence} AND a % 5 <> 0 AND b % 5 <> 0), e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
  cl AS (SELECT DISTINCT m.id FROM m JOIN e ON m.s_id = e.a JOIN m n ON n.id = m.id AND n.s_id = e.b)
  SELECT id, s_id, 'confirmed' AS decision, 'exact' AS stage, 10000.0::DOUBLE AS score FROM ex UNION ALL SELECT id, s_id, 'confirmed', 'perceptual', round(score::DOUBLE, 2) FROM yes
  UNION ALL SELECT id, s_id, 'suspicious', CASE WHEN id IN (SELECT id FROM cl) THEN 'cluster' ELSE top END, round(CASE WHEN id IN (SELECT id FROM cl) THEN greatest(score, {FULL.cluster_hard}::FLOAT) ELSE score END::DOUBLE, 2) FROM b2 WHERE score >= {_FS.score}::FLOAT OR id IN (SELECT id FROM cl)"""
