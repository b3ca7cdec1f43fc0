"""Counters, timing distributions and reports over metric events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions import stats


def counters(d: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    return d.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds])


def ring(d: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """The last cap rows of each key (a group limit runs before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return d.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= cap).drop("rn")


def timing(d: DataFrame, keys: list[str], order: list[str], value: str, cap: int) -> DataFrame:
    """count (all samples above 0), and of the last cap: average (floor), most, p95 and p99 (ranks rounded half up)."""
    some = d.filter(F.col(value) > 0)
    n = some.groupBy(*keys).agg(F.count("*").alias("count"))
    v = ring(some, keys, order, cap).groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("v"), F.sum(value).alias("s"))
    return n.join(v, keys).select(*keys, "count", F.floor(F.col("s") / F.size("v")).alias("average"), F.element_at("v", -1).alias("most"), stats.rank_half_up(F.col("v"), 95, 100).alias("p95"), stats.rank_half_up(F.col("v"), 99, 100).alias("p99"))


def snapshot(d: DataFrame, keys: list[str], order: list[str], value: str, ok: Column, cap: int) -> DataFrame:
    """Successes and failures of all, and least, most, average and percentiles of the last cap."""
    n = d.groupBy(*keys).agg(F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"))
    v = ring(d, keys, order, cap).groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("v"), F.sum(value).alias("s"))
    return n.join(v, keys).select(*keys, "successes", "failures", F.col("v")[0].alias("least"), F.element_at("v", -1).alias("most"), F.floor(F.col("s") / F.size("v")).alias("average"), *[stats.rank_round(F.col("v"), q / 100).alias(f"p{q}") for q in (50, 90, 95, 99)])


def period_report(d: DataFrame, key: str, ts: str, hours: int) -> DataFrame:
    """Counts of each key and period, and the running total up to its end."""
    g = d.groupBy(key, F.window(ts, f"{hours} hours").start.alias("period")).agg(F.count("*").alias("n"))
    return g.withColumn("running", F.sum("n").over(Window.partitionBy(key).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)))


def rollup_report(d: DataFrame, key: str, day: Column) -> DataFrame:
    """By key and day, and by key over all days (day null): two grouping sets in one pass."""
    return d.withColumn("day", day).groupingSets([[key, "day"], [key]], key, "day").agg(F.count("*").alias("n"))


def lru_dedupe(d: DataFrame, group: str, key: str, order: list[str], cap: int, schema: str) -> DataFrame:
    """Rows whose key isn't among the cap keys seen last in their group; seeing a key again renews it."""

    def run(df):  # noqa: ANN001, ANN202
        seen: dict = {}
        keep = []
        for k in df.sort_values(order, kind="stable")[key]:
            keep.append(k not in seen)
            seen.pop(k, None)
            seen[k] = None
            if len(seen) > cap:
                del seen[next(iter(seen))]
        return df.sort_values(order, kind="stable")[keep]

    return d.groupBy(group).applyInPandas(run, schema)


def memo(d: DataFrame, keys: list[str], decide: Column, order: list[str]) -> DataFrame:
    """Decide once for each distinct key, then look up: every row with its decision and whether it was reused."""
    w = Window.partitionBy(*keys).orderBy(*order)
    once = d.select(*keys).distinct().withColumn("decision", decide)
    return d.withColumn("reused", F.row_number().over(w) > 1).join(once, keys)
