"""The four nearest-rank percentiles, over sorted arrays, and safe ratios."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _pick(values: Column, index: Column) -> Column:
    return F.when(F.size(values) > 0, F.element_at(values, F.least(index, F.size(values) - 1).cast("int") + 1))


def rank_round(values: Column, q: float) -> Column:
    """At (n - 1) * q, halves away from zero."""
    return _pick(values, F.floor((F.size(values) - 1) * F.lit(q) + 0.5))


def rank_ceil(values: Column, percent: int) -> Column:
    return _pick(values, F.ceil((F.size(values) - 1) * percent / 100))


def rank_half_up(values: Column, num: int, den: int) -> Column:
    return _pick(values, F.floor(((F.size(values) - 1) * num + den // 2) / den))


def rank_quarter(values: Column, quarter: int) -> Column:
    return _pick(values, F.floor(F.size(values) * quarter / 4))


def counted_ranks(d: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each group the values at some ranks (functions of the number of rows, from 0), from counts of distinct values:
    a group's rows are never held together."""
    n = d.groupBy(*keys, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    of = F.sum("n").over(Window.partitionBy(*keys))
    c = n.withColumns({"upto": upto, "total": of})
    at = {k: F.least(r(F.col("total")), F.col("total") - 1) for k, r in ranks.items()}
    return c.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") > i, F.col(value))).alias(k) for k, i in at.items()])


def duration_stats(d: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, min, max, avg and the 50th, 90th, 95th and 99th percentile (rank rounded, halves up) of each group."""
    at = {f"p{p}": (lambda n, p=p: F.floor((n - 1) * F.lit(p / 100) + 0.5)) for p in (50, 90, 95, 99)}
    simple = d.groupBy(*keys).agg(F.count("*").alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("avg"))
    return simple.join(counted_ranks(d, keys, value, at), keys)


def ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def confusion(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Metrics of a confusion table; null where a denominator is zero."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision_": p, "recall": r, "specificity": ratio(tn, tn + fp), "f1": ratio(2 * p * r, p + r), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp)}
