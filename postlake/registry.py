"""Queries by name, each with the DuckDB SQL of the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import bodies  # noqa: F401  registers its queries
from .plans import queries as plans

FLAGSHIP = "r09_threads"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)
