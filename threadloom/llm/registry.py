"""Where the modules of this subpackage register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    """Register a query under its function's name."""
    QUERIES[f.__name__] = f
    return f
