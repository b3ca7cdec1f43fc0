"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fertility, hostpaths, langid, mix, neardup, perspectives, pii, quality, shard

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.query,
    "op2_simhash": neardup.query,
    "op3_shard": shard.query,
    "op4_fertility": fertility.query,
    "op5_mix": mix.query,
    "op6_pii": pii.query,
    "op7_perspectives": perspectives.query,
    "op8_hostpaths": hostpaths.query,
    "op9_langid": langid.query,
    "op10_quality": quality.query,
}

ORACLE_SQL: dict[str, str] = {"op3_shard": shard.SQL, "op7_perspectives": perspectives.SQL}
