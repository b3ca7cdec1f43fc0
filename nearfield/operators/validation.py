"""Quality of matching: folds, leave-one-out, sweeps, gates and sets of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions import stats


def folds(d: DataFrame, id_: str, n: int, seed: int) -> DataFrame:
    """A fold from 0 for every row: its place in a seeded shuffle, modulo n."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")))
    # places from counts of 4,096 ranges of the key, so that no task sees all rows
    d = d.withColumns({"nf_key": key, "nf_range": F.conv(F.substring(key, 1, 3), 16, 10).cast("int")})
    count = d.groupBy("nf_range").agg(F.count("*").alias("nf_n"))
    before = count.withColumn("nf_before", F.coalesce(F.sum("nf_n").over(Window.orderBy("nf_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("nf_n")
    within = F.row_number().over(Window.partitionBy("nf_range").orderBy("nf_key", id_))
    placed = d.join(F.broadcast(before), "nf_range")  # 4,096 rows at most
    return placed.withColumn("fold", ((F.col("nf_before") + within - 1) % n).cast("int")).drop("nf_key", "nf_range", "nf_before")


def splitmix_shuffle(n: int, seed: int) -> list[int]:
    """Fisher-Yates shuffle of 0 .. n-1 by splitmix64, on the driver; for small sets that have to be reproduced."""
    mask = (1 << 64) - 1
    state, out = (seed ^ 0xA0761D6478BD642F) & mask, list(range(n))
    for i in range(n - 1, 0, -1):
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = state
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & mask
        z ^= z >> 31
        j = z % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def kfold(hits: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Confusion of each fold. hits: id, id_fold (null: a negative), s_fold; a specimen serves all folds but its own.

    One pass for all folds: a candidate is found in fold f if some hit comes from another fold.
    """
    fold = positives.select("fold").distinct()
    own = hits.filter("id_fold is not null and id_fold <> s_fold")
    tp = own.groupBy(F.col("id_fold").alias("fold")).agg(F.countDistinct("id").alias("tp"))
    fp = hits.filter("id_fold is null").join(F.broadcast(fold), F.col("s_fold") != F.col("fold")).groupBy("fold").agg(F.countDistinct("id").alias("fp"))
    n = positives.groupBy("fold").agg(F.count("*").alias("p"))
    d = n.join(tp, "fold", "left").join(fp, "fold", "left").crossJoin(negatives.agg(F.count("*").alias("q"))).na.fill(0)
    return d.select("fold", "tp", "fp", (F.col("q") - F.col("fp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fn"))


def leave_one_out(hits: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Each positive against all others; every negative is scored once for each held-out positive, in closed form: with
    m matching specimens it is a false positive in all runs if m > 1, and in all but one if m = 1."""
    tp = hits.filter("not negative and id <> s_id").agg(F.countDistinct("id").alias("tp"))
    m = hits.filter("negative").groupBy("id").agg(F.count("*").alias("m"))
    d = positives.agg(F.count("*").alias("p")).crossJoin(negatives.agg(F.count("*").alias("q"))).crossJoin(tp).crossJoin(m.agg(F.count("*").alias("some"), F.count_if(F.col("m") == 1).alias("one")))
    fp = F.col("some") * F.col("p") - F.col("one")
    return d.select("tp", fp.alias("fp"), (F.col("p") * F.col("q") - fp).alias("tn"), (F.col("p") - F.col("tp")).alias("fn"))


def with_metrics(d: DataFrame) -> DataFrame:
    m = stats.confusion(*(F.col(c) for c in ("tp", "fp", "tn", "fn")))
    return d.select("*", *[F.round(v, 6).alias(k) for k, v in m.items()])


def gates(d: DataFrame, max_fp: int = 0, min_precision: float = 0.99, min_specificity: float = 0.99) -> DataFrame:
    """Which gates each row of metrics passes; a metric that is null fails."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    g = {"no_misses": F.col("fn") == 0, "few_false": F.col("fp") <= max_fp, "precise": ok(F.col("precision_") >= min_precision), "specific": ok(F.col("specificity") >= min_specificity)}
    d = d.withColumns(g)
    return d.withColumn("passed", F.col("no_misses") & F.col("few_false") & F.col("precise") & F.col("specific"))


def subset_violations(tier1: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """Keys that the first tier confirms and the full policy doesn't: has to be empty."""
    return tier1.select(key).subtract(full.select(key))


def variant_coverage(d: DataFrame, source: str, decision: str) -> DataFrame:
    """variant, hard, soft, unmatched and n: the variant is what stands between "__" and the extension of a source."""
    name = F.regexp_replace(F.col(source), r"\.[^.]*$", "")
    variant = F.when(name.contains("__"), F.regexp_extract(name, "__(.*)$", 1)).otherwise("original")
    c = F.col(decision)
    return d.groupBy(variant.alias("variant")).agg(F.count_if(c == "confirmed").alias("hard"), F.count_if(c == "suspicious").alias("soft"), F.count_if(c.isNull()).alias("unmatched"), F.count("*").alias("n"))


def metric_gates(d: DataFrame, run: str, min_precision: float, min_specificity: float) -> DataFrame:
    """gate, value, least and passed for the precision and the specificity of one row of metrics; null fails."""
    rows = [F.struct(F.lit(f"{run}_{k}").alias("gate"), F.col(c).cast("double").alias("value"), F.lit(least).alias("least")) for k, c, least in (("precision", "precision_", min_precision), ("specificity", "specificity", min_specificity))]
    g = d.select(F.explode(F.array(*rows)).alias("g")).select("g.*")
    return g.withColumn("passed", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)))
