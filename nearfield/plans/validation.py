"""Queries on matching quality, and their SQL. Specimens are the vectors of labels below 5, negatives the others."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from nearfield.functions import scores, stats
from nearfield.operators import fingerprints, matching, validation
from nearfield.plans.policy import WIDE, Policy, as_rows

from . import matching as plans
from .tables import load

MOST = 46
SEED = 7


def _fp(spark, sf):
    return fingerprints.fingerprints(load(spark, sf, "embeddings")).select("id", "label", "ph", "dh")


def _sides(spark, sf):
    d = _fp(spark, sf)
    return validation.folds(d.filter("label < 5"), "id", 5, SEED), d.filter("label >= 5")


def _hits(spark, sf, most=MOST):
    pos, neg = _sides(spark, sf)
    cand = pos.unionByName(neg.withColumn("fold", F.lit(None).cast("int")))
    p = matching.all_pairs(pos, cand).filter((F.col("pd") + F.col("dd") <= most) & (F.col("id") != F.col("s_id")))
    return p.select("id", F.col("fold").alias("id_fold"), "s_id", "s_fold", (F.col("label") >= 5).alias("negative"), (F.col("pd") + F.col("dd")).alias("total"))


def kfold_confusion(spark, sf):
    pos, neg = _sides(spark, sf)
    return validation.with_metrics(validation.kfold(_hits(spark, sf), pos, neg))


def leave_one_out(spark, sf):
    pos, neg = _sides(spark, sf)
    return validation.with_metrics(validation.leave_one_out(_hits(spark, sf), pos, neg))


def _sweep(spark, sf):
    pos, neg = _sides(spark, sf)
    table = as_rows(spark, {f"total_{k}": replace(WIDE.confirmed, total_max=k) for k in (40, 42, 44, 46, 48)}).select("policy", "total_max")
    best = _hits(spark, sf, 64).groupBy("id", "negative").agg(F.min("total").alias("best"))
    n = pos.agg(F.count("*").alias("p")).crossJoin(neg.agg(F.count("*").alias("q")))
    hit = F.broadcast(table).crossJoin(best).groupBy("policy", "total_max").agg(F.count_if(~F.col("negative") & (F.col("best") <= F.col("total_max"))).alias("tp"), F.count_if(F.col("negative") & (F.col("best") <= F.col("total_max"))).alias("fp"))
    return validation.with_metrics(hit.crossJoin(n).select("policy", "tp", "fp", (F.col("q") - F.col("fp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fn")))


def threshold_sweep(spark, sf):
    return _sweep(spark, sf)


def quality_gates(spark, sf):
    return validation.gates(_sweep(spark, sf), 5, 0.6, 0.9).select("policy", "no_misses", "few_false", "precise", "specific", "passed")


def tier1_subset(spark, sf):
    pairs = plans.pairs(spark, sf)
    confirmed = lambda p: matching.cascade(pairs, p).filter("decision = 'confirmed'").select("id")
    # the first tier's hashes allow as much as those of the full policy, whose score asks for more
    t1 = confirmed(replace(WIDE, confirmed=replace(WIDE.confirmed, score=63.0)))
    full = confirmed(replace(WIDE, confirmed=replace(WIDE.confirmed, score=66.0)))
    bad = validation.subset_violations(t1, full, "id")
    return t1.agg(F.count("*").alias("tier1")).crossJoin(full.agg(F.count("*").alias("full"))).crossJoin(bad.agg(F.count("*").alias("violations")))


def prediction_sets(spark, sf):
    """Predicted sources by mode: matched, suspicious only, either, neither."""
    c = matching.cascade(plans.pairs(spark, sf), WIDE).select("id", "decision")
    yes, maybe = c.filter("decision = 'confirmed'").select("id"), c.filter("decision = 'suspicious'").select("id")
    every = _fp(spark, sf).filter("id % 5 = 0").select("id")
    both = yes.unionByName(maybe).distinct()
    rows = [("matched", yes.intersect(every)), ("suspicious_only", maybe.subtract(yes)), ("either", both), ("unmatched", every.subtract(both))]
    out = None
    for name, d in rows:
        d = d.select(F.lit(name).alias("category"), "id")
        out = d if out is None else out.unionByName(d)
    return out


def transform_coverage(spark, sf):
    """By label: how many candidates are confirmed, suspicious and unmatched."""
    c = matching.cascade(plans.pairs(spark, sf), WIDE).select("id", "decision")
    d = _fp(spark, sf).filter("id % 5 = 0").join(c, "id", "left")
    return d.groupBy("label").agg(F.count_if(F.col("decision") == "confirmed").alias("hard"), F.count_if(F.col("decision") == "suspicious").alias("soft"), F.count_if(F.col("decision").isNull()).alias("unmatched"))


def variant_coverage(spark, sf):
    """By variant (what follows "__" in a source's name, "original" without): how many are hard, soft and unmatched."""
    c = matching.cascade(plans.pairs(spark, sf), WIDE).select("id", "decision")
    kind = F.element_at(F.array(*map(F.lit, ("", "__rotate-5", "__crop-90", "__jpeg-40"))), (F.col("id") % 4 + 1).cast("int"))
    d = _fp(spark, sf).filter("id % 5 = 0").select("id", F.concat(F.lit("img"), F.col("id").cast("string"), kind, F.lit(".png")).alias("source"))
    return validation.variant_coverage(d.join(c, "id", "left"), "source", "decision")


def gate_results(spark, sf):
    """The gates of folds and of leaving one out: metric, value, limit and whether it passed."""
    fold = _confusion_sum(kfold_confusion(spark, sf))
    return validation.metric_gates(fold, "kfold", 0.6, 0.9).unionByName(validation.metric_gates(leave_one_out(spark, sf), "leave_one_out", 0.6, 0.9))


def _confusion_sum(d):
    return validation.with_metrics(d.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")]))


def case_features(spark, sf):
    """By label: quartiles of the distance to the nearest specimen."""
    d = plans.pairs(spark, sf).groupBy("id", "label").agg(F.min(F.col("pd") + F.col("dd")).alias("t"))
    return stats.counted_ranks(d, ["label"], "t", {f"q{k}": (lambda n, k=k: F.floor(n * k / 4)) for k in (1, 2, 3)})


def score_table(spark, sf):
    """Single-precision scores at every total distance; the last is exactly at the threshold."""
    t = Policy().confirmed
    d = spark.range(0, 27).select(F.col("id").alias("total"))
    s = (scores.perceptual(F.col("total"), t) * scores.f32(t.perceptual_weight)).cast("float")
    return d.select("total", F.round(s.cast("double"), 3).alias("score"), (s >= scores.f32(t.score)).alias("confirmed"))


QUERIES = {f.__name__: f for f in (kfold_confusion, leave_one_out, threshold_sweep, quality_gates, tier1_subset, prediction_sets, transform_coverage, variant_coverage, gate_results, case_features, score_table)}

_HITS = f"""{plans.FP}, pos AS (SELECT *, ((row_number() OVER (ORDER BY md5('{SEED}:' || id), id) - 1) % 5)::INT AS fold FROM fx WHERE label < 5), neg AS (SELECT *, NULL::INT AS fold FROM fx WHERE label >= 5),
  cand AS (SELECT * FROM pos UNION ALL SELECT * FROM neg), h0 AS (SELECT c.id, c.fold AS id_fold, s.id AS s_id, s.fold AS s_fold, c.label >= 5 AS negative, {plans.HAM.format('c', 's')} FROM cand c JOIN pos s ON c.id <> s.id),
  hits AS (SELECT *, pd + dd AS total FROM h0)"""
_METRICS = "tp, fp, tn, fn, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision_, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(fn / nullif(fn + tp, 0), 6) AS fnr"
_CASCADE = plans.ORACLE_SQL["cascade_decision"]
_SWEEP = f"""WITH {_HITS}, b AS (SELECT id, negative, min(total) AS best FROM hits WHERE total <= 64 GROUP BY ALL), p AS (SELECT unnest([40, 42, 44, 46, 48]) AS k),
  c AS (SELECT 'total_' || k AS policy, count(*) FILTER (WHERE NOT negative AND best <= k) AS tp, count(*) FILTER (WHERE negative AND best <= k) AS fp FROM p, b GROUP BY k),
  m AS (SELECT policy, tp, fp, (SELECT count(*) FROM neg) - fp AS tn, (SELECT count(*) FROM pos) - tp AS fn FROM c), r AS (SELECT policy, {_METRICS} FROM m)"""

ORACLE_SQL = {
    "kfold_confusion": f"""WITH {_HITS}, f AS (SELECT DISTINCT fold FROM pos), x AS (SELECT * FROM hits WHERE total <= {MOST}),
      m AS (SELECT fold, (SELECT count(DISTINCT id) FROM x WHERE id_fold = f.fold AND s_fold <> f.fold) AS tp, (SELECT count(DISTINCT id) FROM x WHERE negative AND s_fold <> f.fold) AS fp,
        (SELECT count(*) FROM neg) AS q, (SELECT count(*) FROM pos WHERE pos.fold = f.fold) AS p FROM f),
      c AS (SELECT fold, tp, fp, q - fp AS tn, p - tp AS fn FROM m) SELECT fold, {_METRICS} FROM c""",
    "leave_one_out": f"""WITH {_HITS}, x AS (SELECT * FROM hits WHERE total <= {MOST}),
      n AS (SELECT count(*) AS fp FROM (SELECT p.id AS held, g.id FROM pos p, neg g) z WHERE EXISTS (SELECT 1 FROM x WHERE x.id = z.id AND x.s_id <> z.held)),
      c AS (SELECT (SELECT count(DISTINCT id) FROM x WHERE NOT negative) AS tp, fp, (SELECT count(*) FROM pos) * (SELECT count(*) FROM neg) - fp AS tn, (SELECT count(*) FROM pos) - (SELECT count(DISTINCT id) FROM x WHERE NOT negative) AS fn FROM n)
      SELECT {_METRICS} FROM c""",
    "threshold_sweep": f"{_SWEEP} SELECT * FROM r",
    "quality_gates": f"{_SWEEP} SELECT policy, fn = 0 AS no_misses, fp <= 5 AS few_false, coalesce(precision_ >= 0.6, false) AS precise, coalesce(specificity >= 0.9, false) AS specific, fn = 0 AND fp <= 5 AND coalesce(precision_ >= 0.6, false) AND coalesce(specificity >= 0.9, false) AS passed FROM r",
    "tier1_subset": f"WITH {plans.FP}, {plans.PAIRS}, s AS (SELECT id, max(score) AS top FROM ({plans.sql_evidence(WIDE.confirmed)}) GROUP BY id), t AS (SELECT id FROM s WHERE top >= 63::FLOAT), full_ AS (SELECT id FROM s WHERE top >= 66::FLOAT) SELECT (SELECT count(*) FROM t) AS tier1, (SELECT count(*) FROM full_) AS full, (SELECT count(*) FROM t WHERE id NOT IN (SELECT id FROM full_)) AS violations",
    "prediction_sets": f"WITH c AS ({_CASCADE}) SELECT CASE decision WHEN 'confirmed' THEN 'matched' ELSE 'suspicious_only' END AS category, id FROM c UNION ALL SELECT 'either', id FROM c UNION ALL SELECT 'unmatched', vec_id FROM embeddings WHERE vec_id % 5 = 0 AND vec_id NOT IN (SELECT id FROM c)",
    "transform_coverage": f"WITH c AS ({_CASCADE}) SELECT label, count(*) FILTER (WHERE decision = 'confirmed') AS hard, count(*) FILTER (WHERE decision = 'suspicious') AS soft, count(*) FILTER (WHERE decision IS NULL) AS unmatched FROM embeddings e LEFT JOIN c ON c.id = e.vec_id WHERE vec_id % 5 = 0 GROUP BY label",
    "case_features": f"WITH {plans.FP}, {plans.PAIRS}, t AS (SELECT id, label, min(pd + dd) AS t FROM pairs GROUP BY ALL), v AS (SELECT label, list_sort(list(t)) AS v FROM t GROUP BY label) SELECT label, {', '.join(f'v[least(len(v) * {k} // 4, len(v) - 1) + 1] AS q{k}' for k in (1, 2, 3))} FROM v",
    "score_table": "WITH t AS (SELECT unnest(range(0, 27)) AS total), s AS (SELECT total, ((35::FLOAT + (1::FLOAT - least(greatest(total::FLOAT / 26::FLOAT, 0::FLOAT), 1::FLOAT)) * (100::FLOAT - 35::FLOAT))::FLOAT * 1.8::FLOAT)::FLOAT AS s FROM t) SELECT total, round(s::DOUBLE, 3) AS score, s >= 63::FLOAT AS confirmed FROM s",
}
ORACLE_SQL["variant_coverage"] = f"WITH c AS ({_CASCADE}), v AS (SELECT vec_id AS id, CASE vec_id % 4 WHEN 0 THEN 'original' WHEN 1 THEN 'rotate-5' WHEN 2 THEN 'crop-90' ELSE 'jpeg-40' END AS variant FROM embeddings WHERE vec_id % 5 = 0) SELECT variant, count(*) FILTER (WHERE decision = 'confirmed') AS hard, count(*) FILTER (WHERE decision = 'suspicious') AS soft, count(*) FILTER (WHERE decision IS NULL) AS unmatched, count(*) AS n FROM v LEFT JOIN c USING (id) GROUP BY variant"
ORACLE_SQL["gate_results"] = f"""WITH k AS ({ORACLE_SQL["kfold_confusion"]}), s AS (SELECT 'kfold' AS run, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn FROM k UNION ALL SELECT 'leave_one_out', tp, fp, tn FROM ({ORACLE_SQL["leave_one_out"]})),
  m AS (SELECT run || '_precision' AS gate, round(tp / nullif(tp + fp, 0), 6) AS value, 0.6::DOUBLE AS least FROM s UNION ALL SELECT run || '_specificity', round(tn / nullif(tn + fp, 0), 6), 0.9::DOUBLE FROM s) SELECT *, coalesce(value >= least, false) AS passed FROM m"""
