"""Queries on fingerprints, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions import scores
from nearfield.operators import audit, fingerprints, graph, local, matching, tiles
from nearfield.plans.policy import WIDE, Threshold

from .tables import load, rounded

def _half(cond: str, h: int) -> str:
    return f"list_sum(list_transform(range({32 * h}, {32 * h + 32}), lambda i: CASE WHEN {cond} THEN (1::BIGINT << ({31 + 32 * h} - i)::INT) ELSE 0::BIGINT END))::BIGINT"


FP = f"""fp AS (
  SELECT vec_id AS id, label, {_half("embedding[i + 1] > 0", 0)} AS p0, {_half("embedding[i + 1] > 0", 1)} AS p1,
         {_half("embedding[(i + 1) % 64 + 1] > embedding[i + 1]", 0)} AS d0, {_half("embedding[(i + 1) % 64 + 1] > embedding[i + 1]", 1)} AS d1,
         list_transform(embedding, lambda e: least(255, greatest(0, floor(e::DOUBLE * 40.0 + 128.0)))::INT) AS grid FROM embeddings),
fx AS (SELECT *, 640 + grid[6] * 4 AS width, 640 + grid[7] * 4 AS height FROM fp)"""
HAM = "(bit_count(xor({0}.p0, {1}.p0)) + bit_count(xor({0}.p1, {1}.p1)))::INT AS pd, (bit_count(xor({0}.d0, {1}.d0)) + bit_count(xor({0}.d1, {1}.d1)))::INT AS dd"
PAIRS = f"""pairs AS (
  SELECT c.id, s.id AS s_id, {HAM.format("c", "s")}, c.width, c.height, s.width AS s_width, s.height AS s_height, c.label, s.label AS s_label, c.grid, s.grid AS s_grid
  FROM fx c, fx s WHERE c.id % 5 = 0 AND s.id % 5 <> 0)"""


def sql_geometry(t: Threshold, s: str = "s_", c: str = "") -> str:
    asp = lambda p: f"(greatest({p}width, {p}height)::FLOAT / greatest(least({p}width, {p}height), 1)::FLOAT)"
    return f"""least({c}width, {c}height) >= {t.min_short_edge} AND {c}width * {c}height >= {t.min_area} AND {asp(c)} <= {t.max_aspect}::FLOAT
      AND abs({asp(s)} - {asp(c)}) <= {t.aspect_delta}::FLOAT AND abs({c}width::FLOAT / {s}width::FLOAT - 1::FLOAT) <= {t.width_delta}::FLOAT
      AND abs({c}height::FLOAT / {s}height::FLOAT - 1::FLOAT) <= {t.height_delta}::FLOAT"""


def sql_near(t: Threshold, slack: int = 0) -> str:
    return f"pd <= {t.phash_max + slack} AND dd <= {t.dhash_max + slack} AND pd + dd <= {t.total_max + slack}"


def sql_stage(t: Threshold) -> str:
    f = t.perceptual_floor
    return f"({f}::FLOAT + (1::FLOAT - least(greatest((pd + dd)::FLOAT / {max(t.total_max, 1)}::FLOAT, 0::FLOAT), 1::FLOAT)) * (100::FLOAT - {f}::FLOAT))::FLOAT"


def sql_evidence(t: Threshold, slack: int = 0, of: str = "pairs") -> str:
    return f"SELECT id, s_id, pd, dd, {sql_stage(t)} AS stage_score, ({sql_stage(t)} * {t.perceptual_weight}::FLOAT)::FLOAT AS score FROM {of} WHERE {sql_near(t, slack)} AND {sql_geometry(t)}"


def sql_best(of: str) -> str:
    return f"SELECT * FROM {of} QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, s_id DESC) = 1"


def fps(spark, sf):
    return fingerprints.fingerprints(load(spark, sf, "embeddings"))


def sides(spark, sf):
    return fingerprints.split(fps(spark, sf).select("id", "label", "ph", "dh", "width", "height"))


def pairs(spark, sf):
    return matching.all_pairs(*sides(spark, sf))


def near(spark, sf, *limits):
    spec, cand = sides(spark, sf)
    return tiles.near(cand, spec, list(limits))


C, S = WIDE.confirmed, WIDE.suspicious
_COH = replace(C, phash_max=64, dhash_max=64, total_max=80)


def exact_match(spark, sf):
    return matching.exact_pairs(load(spark, sf, "documents"), F.md5("text"), "doc_id")


def exact_dup_groups(spark, sf):
    return audit.duplicate_groups(load(spark, sf, "documents"), F.md5("text"), "doc_id")


def import_anti(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("k"))
    return audit.importable(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), "k", "doc_id").select("doc_id", "k")


def zero_hit_anti(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("k"))
    hits = matching.exact_pairs(d, F.col("k"), "doc_id")
    return audit.never_hit(d.groupBy("k").agg(F.min("doc_id").alias("specimen")).select("specimen"), hits)


def hit_counters(spark, sf):
    d = load(spark, sf, "documents")
    return matching.exact_pairs(d, F.md5("text"), "doc_id").groupBy("specimen").agg(F.count("*").alias("hits"))


def hamming_all_pairs(spark, sf):
    return near(spark, sf, (20, 64), (64, 18)).select("id", "s_id", "pd", "dd")


#: Bits in which the four variants of a fingerprint differ from it: none, 5, 10 and 16 of them.
NOISE = (0, 0x0001_0010_0100_1001, 0x0421_1042_1084_2000, 0x1111_1111_1111_1111)


def variants(spark, sf):
    """Four variants of every fingerprint, with known numbers of flipped bits: id * 4 + k."""
    d = fps(spark, sf).select("id", "label", "ph", "dh", F.posexplode(F.array(*[F.lit(m).cast("bigint") for m in NOISE])).alias("k", "m"))
    return d.select((F.col("id") * 4 + F.col("k")).alias("id"), F.col("ph").bitwiseXOR(F.col("m")).alias("ph"), F.col("dh").bitwiseXOR(F.col("m")).alias("dh"), "label")


def hamming_segment_join(spark, sf):
    return matching.segment_pairs(fps(spark, sf), variants(spark, sf), "ph", 15).select("id", "s_id", "distance")


def near_dup_pairs(spark, sf):
    """Among the variants; those of one content (an original and its first variant share it) are no pairs."""
    d = variants(spark, sf).withColumn("content", F.md5(F.floor(F.col("id") / 2).cast("string")))
    return matching.near_pairs(d, 15, 15, "content")


def perceptual_match(spark, sf):
    return rounded(matching.best(matching.perceptual_evidence(near(spark, sf, matching.limits(C)), C)).filter(F.col("score") >= scores.f32(C.score)), "stage_score", "score")


def suspicious_near_miss(spark, sf):
    d = matching.perceptual_evidence(near(spark, sf, matching.limits(S, S.near_miss_slack)), S, S.near_miss_slack)
    return rounded(d.filter(~scores.compatible(F.col("pd"), F.col("dd"), S)), "stage_score", "score")


def cascade_decision(spark, sf):
    return rounded(matching.cascade(matching.nearest_for_levels(*sides(spark, sf), WIDE, last=True).distinct(), WIDE), "stage_score", "score")


def cascade_explain(spark, sf):
    return matching.explain(*sides(spark, sf), WIDE)


def geometry_compatible(spark, sf):
    d = pairs(spark, sf)
    ok = scores.geometry_compatible(F.col("s_width"), F.col("s_height"), F.col("width"), F.col("height"), C)
    return d.groupBy("id").agg(F.count_if(ok).alias("fits"), F.count("*").alias("pairs"))


def visual_similarity_score(spark, sf):
    spec, cand = fingerprints.split(fps(spark, sf).select("id", "grid", "luma", "rgb", "blocks"))
    d, kinds = tiles.looks(cand, spec), ("luma_delta", "rgb_delta", "grid_delta", "text_delta")
    v = scores.visual_signature(*map(F.col, kinds), (80, 70, 70, 90)).cast("double")
    return d.withColumn("visual", F.round(v, 2))


def _second():
    return scores.inverse(F.col("dd"), 64.0)


def _both_kinds():
    """The total of a pair with the first kind of evidence, and the second where it has that."""
    first = (scores.perceptual(F.col("pd") + F.col("dd"), S) * scores.f32(S.perceptual_weight)).cast("float")
    two = F.when(F.col("dd") <= 26, F.round((_second() * scores.f32(1.4)).cast("float").cast("double"), 2)).otherwise(0.0)
    return F.round(F.round(first.cast("double"), 2) + two, 2)


def weighted_best(d):
    """Both kinds of evidence of every pair, summed by weight; the best specimen of each candidate."""
    a = matching.perceptual_evidence(d, S).select("id", "s_id", F.lit(1).alias("seq"), "stage_score", "score")
    b = d.filter("dd <= 26").select("id", "s_id", F.lit(2).alias("seq"), _second().alias("stage_score"), (_second() * scores.f32(1.4)).cast("float").alias("score"))
    total = a.unionByName(b).groupBy("id", "s_id").agg(F.sum(F.round(F.col("score").cast("double"), 2)).alias("total"), F.max_by("seq", F.struct("stage_score", "seq")).alias("best_stage"), F.count("*").alias("n"))
    w = Window.partitionBy("id").orderBy(F.desc(F.round("total", 2)), F.desc("s_id"))
    return total.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("id", "s_id", F.round("total", 2).alias("total"), "best_stage", "n")


def weighted_evidence_argmax(spark, sf):
    """Only these pairs can be the best: the best of those with both kinds of evidence, and the nearest by the second alone."""
    spec, cand = sides(spark, sf)
    both = tiles.nearest(cand, spec, last=True, limits=[matching.limits(S)], sizes=S, rank=matching.ranks(spark, _both_kinds))
    return weighted_best(both.unionByName(tiles.nearest(cand, spec, "dd", last=True)).distinct())


def best_per_candidate(spark, sf):
    spec, cand = sides(spark, sf)
    d = tiles.nearest(cand, spec)
    return d.groupBy("id").agg(F.min_by("s_id", F.struct(F.col("pd") + F.col("dd"), "s_id")).alias("s_id"), F.min(F.col("pd") + F.col("dd")).alias("total"))


def top_k_specimens(spark, sf):
    d = pairs(spark, sf).filter("pd <= 30").groupBy("id", F.col("s_label").alias("s_id")).agg(F.count("*").alias("hits"), F.countDistinct("pd").alias("votes"), F.sum("dd").alias("quality"))
    return matching.top_specimens(d, 3).select("id", "s_id", "hits", "votes", "quality", "rank")


def compare_sets(spark, sf):
    """Every candidate with its best specimen of another label, misses kept."""
    d = near(spark, sf, (64, 64, 48)).filter("label <> s_label")
    w = Window.partitionBy("id").orderBy(F.col("pd") + F.col("dd"), "s_id")
    hit = d.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("id", "s_id", "pd", "dd")
    return fps(spark, sf).filter("id % 5 = 0").select("id").join(hit, "id", "left").withColumn("matched", F.col("s_id").isNotNull())


def variant_join(spark, sf):
    """Matches against either stored representation: as it is, or its preview (the gradient hash alone)."""
    d = near(spark, sf, (20, 64), (64, 18))
    full = d.filter("pd <= 20").select("id", "s_id", F.lit("original").alias("variant"), F.col("pd").alias("distance"))
    return full.unionByName(d.filter("dd <= 18").select("id", "s_id", F.lit("preview").alias("variant"), F.col("dd").alias("distance")))


def distinct_hash_dictionary(spark, sf):
    """Distinct hash values and how many documents share each: what a join has to look at."""
    d = load(spark, sf, "documents").select(F.substring(F.md5("text"), 1, 4).alias("value"))
    return d.groupBy("value").agg(F.count("*").alias("members")).filter("members > 1")


def index_occupancy(spark, sf):
    return local.occupancy(fps(spark, sf), "ph")


def edges_of(fp):
    return graph.coherence_edges(fp, _COH, 42)


def coherence_edges(spark, sf):
    return edges_of(fps(spark, sf))


def coherence_clusters(spark, sf):
    return graph.clusters(graph.coherence_links(fps(spark, sf), _COH, 60), 60, 2)


def reference_outliers(spark, sf):
    return audit.size_outliers(fps(spark, sf), 1.02, 1_700_000)


_MASKS = ", ".join(f"({k}, {m >> 32}::BIGINT, {m & 0xFFFFFFFF}::BIGINT)" for k, m in enumerate(NOISE))
VARIANTS = f"mk(k, m0, m1) AS (VALUES {_MASKS}), vr AS (SELECT id * 4 + k AS id, xor(p0, m0) AS p0, xor(p1, m1) AS p1, xor(d0, m0) AS d0, xor(d1, m1) AS d1 FROM fp, mk)"
_SEG = " UNION ALL ".join(f"SELECT id, {16 * k} + ((p{k // 8} >> {28 - 4 * (k % 8)}) & 15) AS slot FROM fp" for k in range(16))
QUERIES = {f.__name__: f for f in (exact_match, exact_dup_groups, import_anti, zero_hit_anti, hit_counters, hamming_all_pairs, hamming_segment_join, near_dup_pairs, perceptual_match, suspicious_near_miss, cascade_decision, cascade_explain, geometry_compatible, visual_similarity_score, weighted_evidence_argmax, best_per_candidate, top_k_specimens, compare_sets, variant_join, distinct_hash_dictionary, index_occupancy, coherence_edges, coherence_clusters, reference_outliers)}

_EXACT = "WITH k AS (SELECT doc_id AS candidate, md5(text) AS k FROM documents), f AS (SELECT k, min(candidate) AS specimen FROM k GROUP BY k HAVING count(*) > 1), m AS (SELECT candidate, specimen FROM k JOIN f USING (k) WHERE candidate <> specimen) "
_ROUND = "id, s_id, pd, dd, round(stage_score::DOUBLE, 3) AS stage_score, round(score::DOUBLE, 3) AS score"


def _explain_sql(level: str, t: Threshold, slack: int) -> str:
    near, size = f"({sql_near(t, slack)})", f"({sql_geometry(t)})"
    return f"""SELECT id, '{level}' AS level, count(*) OVER (PARTITION BY id) AS considered, s_id, pd, dd,
      CASE WHEN {near} AND {size} THEN CASE WHEN {sql_near(t)} THEN 'within limits' ELSE 'near miss' END WHEN {near} THEN 'size' WHEN {size} THEN 'distance' ELSE 'distance and size' END AS reason,
      ({near} AND {size}) AS passed
      FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY ({near} AND {size}) DESC, pd + dd, s_id) = 1"""


ORACLE_SQL = {
    "exact_match": _EXACT + "SELECT candidate, specimen, 10000::FLOAT AS score FROM m",
    "exact_dup_groups": "SELECT md5(text) AS content, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1 HAVING count(*) > 1",
    "import_anti": "WITH d AS (SELECT doc_id, md5(text) AS k FROM documents) SELECT min(doc_id) AS doc_id, k FROM d WHERE doc_id % 2 = 1 AND k NOT IN (SELECT k FROM d WHERE doc_id % 2 = 0) GROUP BY k",
    "zero_hit_anti": _EXACT + ", s AS (SELECT min(candidate) AS specimen FROM k GROUP BY k) SELECT specimen FROM s WHERE specimen NOT IN (SELECT specimen FROM m)",
    "hit_counters": _EXACT + "SELECT specimen, count(*) AS hits FROM m GROUP BY specimen",
    "hamming_all_pairs": f"WITH {FP}, {PAIRS} SELECT id, s_id, pd, dd FROM pairs WHERE pd <= 20 OR dd <= 18",
    "hamming_segment_join": f"WITH {FP}, {VARIANTS}, q AS (SELECT c.id, s.id AS s_id, (bit_count(xor(c.p0, s.p0)) + bit_count(xor(c.p1, s.p1)))::INT AS distance FROM vr c, fp s) SELECT * FROM q WHERE distance <= 15",
    "near_dup_pairs": f"WITH {FP}, {VARIANTS}, q AS (SELECT a.id AS id_a, b.id AS id_b, {HAM.format('a', 'b')} FROM vr a JOIN vr b ON a.id < b.id AND a.id // 2 <> b.id // 2) SELECT * FROM q WHERE pd <= 15 AND dd <= 15",
    "perceptual_match": f"WITH {FP}, {PAIRS}, e AS ({sql_evidence(C)}), b AS ({sql_best('e')}) SELECT {_ROUND} FROM b WHERE score >= {C.score}::FLOAT",
    "suspicious_near_miss": f"WITH {FP}, {PAIRS}, e AS ({sql_evidence(S, S.near_miss_slack)}) SELECT {_ROUND} FROM e WHERE NOT ({sql_near(S)})",
    "cascade_decision": f"""WITH {FP}, {PAIRS}, e AS ({sql_evidence(C)}), b AS ({sql_best('e')}), yes AS (SELECT * FROM b WHERE score >= {C.score}::FLOAT),
      rest AS (SELECT * FROM pairs WHERE id NOT IN (SELECT id FROM yes)), e2 AS ({sql_evidence(S, S.near_miss_slack, 'rest')}), b2 AS ({sql_best('e2')})
      SELECT {_ROUND}, 'confirmed' AS decision FROM yes UNION ALL SELECT {_ROUND}, 'suspicious' AS decision FROM b2 WHERE score >= {S.score}::FLOAT""",
    "cascade_explain": f"WITH {FP}, {PAIRS} {_explain_sql('confirmed', C, 0)} UNION ALL {_explain_sql('suspicious', S, S.near_miss_slack)}".replace(") SELECT id, 'confirmed'", "), x AS (SELECT 1) SELECT * FROM (SELECT id, 'confirmed'").replace(" UNION ALL SELECT id, 'suspicious'", ") UNION ALL SELECT * FROM (SELECT id, 'suspicious'") + ")",
    "geometry_compatible": f"WITH {FP}, {PAIRS} SELECT id, count(*) FILTER (WHERE {sql_geometry(C)}) AS fits, count(*) AS pairs FROM pairs GROUP BY id",
    "visual_similarity_score": f"""WITH {FP}, q AS (SELECT c.id, s.id AS s_id, abs(c.grid[4] - s.grid[4]) AS luma_delta,
      least(255, list_sum(list_transform(range(1, 4), lambda i: abs(c.grid[i] - s.grid[i]))) // 3)::INT AS rgb_delta,
      least(255, list_sum(list_transform(range(1, 17), lambda i: abs(c.grid[i] - s.grid[i]))) // 16)::INT AS grid_delta,
      least(255, list_sum(list_transform(range(1, 65), lambda i: abs(c.grid[i] - s.grid[i]))) // 64)::INT AS text_delta
      FROM fp c, fp s WHERE c.id % 5 = 0 AND s.id % 5 <> 0)
      SELECT *, round({' + '.join(f"((1::FLOAT - least(greatest({d}::FLOAT / {z}::FLOAT, 0::FLOAT), 1::FLOAT)) * 100::FLOAT)::DOUBLE * {w}" for d, z, w in (('luma_delta', 80, .25), ('rgb_delta', 70, .2), ('grid_delta', 70, .25), ('text_delta', 90, .3)))}, 2) AS visual FROM q""",
    "weighted_evidence_argmax": f"""WITH {FP}, {PAIRS}, a AS ({sql_evidence(S)}), st AS (SELECT *, ((1::FLOAT - least(greatest(dd::FLOAT / 64::FLOAT, 0::FLOAT), 1::FLOAT)) * 100::FLOAT)::FLOAT AS st FROM pairs WHERE dd <= 26),
      u AS (SELECT id, s_id, 1 AS seq, stage_score, score FROM a UNION ALL SELECT id, s_id, 2, st, (st * 1.4::FLOAT)::FLOAT FROM st),
      t AS (SELECT id, s_id, sum(round(score::DOUBLE, 2)) AS total, arg_max(seq, (stage_score, seq)) AS best_stage, count(*) AS n FROM u GROUP BY id, s_id)
      SELECT id, s_id, round(total, 2) AS total, best_stage, n FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(total, 2) DESC, s_id DESC) = 1""",
    "best_per_candidate": f"WITH {FP}, {PAIRS} SELECT id, s_id, pd + dd AS total FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY pd + dd, s_id) = 1",
    "top_k_specimens": f"WITH {FP}, {PAIRS}, g AS (SELECT id, s_label AS s_id, count(*) AS hits, count(DISTINCT pd) AS votes, sum(dd)::BIGINT AS quality FROM pairs WHERE pd <= 30 GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, votes DESC, quality, s_id) AS rank FROM g QUALIFY rank <= 3",
    "compare_sets": f"WITH {FP}, {PAIRS}, h AS (SELECT id, s_id, pd, dd FROM pairs WHERE label <> s_label AND pd + dd <= 48 QUALIFY row_number() OVER (PARTITION BY id ORDER BY pd + dd, s_id) = 1) SELECT f.id, s_id, pd, dd, s_id IS NOT NULL AS matched FROM fp f LEFT JOIN h USING (id) WHERE f.id % 5 = 0",
    "variant_join": f"WITH {FP}, {PAIRS} SELECT id, s_id, 'original' AS variant, pd AS distance FROM pairs WHERE pd <= 20 UNION ALL SELECT id, s_id, 'preview', dd FROM pairs WHERE dd <= 18",
    "distinct_hash_dictionary": "SELECT substr(md5(text), 1, 4) AS value, count(*) AS members FROM documents GROUP BY 1 HAVING count(*) > 1",
    "index_occupancy": f"WITH {FP}, s AS ({_SEG}), c AS (SELECT slot, count(*) AS n FROM s GROUP BY slot), v AS (SELECT list_sort(list(n)) AS v FROM c) SELECT len(v)::BIGINT AS buckets, list_sum(v)::BIGINT AS entries, v[1]::BIGINT AS least, v[len(v)]::BIGINT AS most, round(list_sum(v) / len(v), 6) AS mean, {', '.join(f'v[ceil((len(v) - 1) * {p} / 100.0)::INT + 1]::BIGINT AS p{p}' for p in (50, 90, 95, 99))} FROM v",
    "coherence_edges": f"WITH {FP}, q AS (SELECT a.id AS a, b.id AS b, {HAM.format('a', 'b')} FROM fx a JOIN fx b ON a.id < b.id), w AS (SELECT a, b, least(1000, greatest(0, round({sql_stage(_COH)}::DOUBLE)))::INT AS weight FROM q WHERE pd + dd <= {_COH.total_max}) SELECT * FROM w WHERE weight >= 42",
    "reference_outliers": f"WITH {FP}, q AS (SELECT id, width, height, width * height > 1360000 AS large, (width / height > {1.02 * 1.2} OR width / height < 1 / {1.02 * 1.2}) AS odd FROM fx) SELECT * FROM q WHERE large OR odd",
}
ORACLE_SQL["coherence_clusters"] = f"""WITH RECURSIVE edges AS ({ORACLE_SQL['coherence_edges']}), e AS (SELECT a, b FROM edges WHERE weight >= 60 UNION ALL SELECT b, a FROM edges WHERE weight >= 60),
  r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a), c AS (SELECT node, min(root) AS cluster FROM r GROUP BY node)
  SELECT node, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM c"""
