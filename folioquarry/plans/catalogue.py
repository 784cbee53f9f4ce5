"""Names of all queries, with their plans and SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package that define QUERIES (name to function) and ORACLE (name to SQL).
MODULES = ("documents", "segments", "quality", "review", "usage", "mining", "candidates", "atoms", "lookups", "streams")


def _all(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), what).items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return queries()["mined_candidates"](spark, folder)
