"""Audit of a reference set: copies, imports, specimens without a hit, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_groups(items: DataFrame, key: Column, id_: str) -> DataFrame:
    """content, n and ids (sorted, joined by commas) of every content that occurs more than once."""
    g = items.groupBy(key.alias("content")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(id_)).alias("l")).filter("n > 1")
    return g.select("content", "n", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("ids"))


def importable(stored: DataFrame, incoming: DataFrame, key: str, id_: str) -> DataFrame:
    """Incoming rows whose key isn't stored, the first of each key. Only exact copies are turned away."""
    fresh = incoming.join(stored.select(key).distinct(), key, "left_anti")
    return fresh.groupBy(key).agg(F.min(id_).alias(id_))


def never_hit(specimens: DataFrame, hits: DataFrame) -> DataFrame:
    return specimens.join(hits.select("specimen").distinct(), "specimen", "left_anti")


def size_outliers(fp: DataFrame, max_aspect: float, max_pixels: int) -> DataFrame:
    """Specimens beyond four fifths of the pixels allowed, or whose width over height is beyond 1.2 times the limit."""
    ratio, most = F.col("width") / F.col("height"), max_aspect * 1.2
    d = fp.select("id", "width", "height", (F.col("width") * F.col("height") > max_pixels * 4 // 5).alias("large"), ((ratio > most) | (ratio < 1 / most)).alias("odd"))
    return d.filter("large or odd")
