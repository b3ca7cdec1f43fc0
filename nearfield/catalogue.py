"""Queries by name and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfield.plans import features, matching, metrics, texts, validation

_PLANS = (matching, texts, validation, metrics, features)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _PLANS for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _PLANS for k, v in m.ORACLE_SQL.items()}
