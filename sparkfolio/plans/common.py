"""The registry of queries and small helpers of the plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PLACES = 6


def query(name: str, sql: str | None = None):
    """Register a query (and its DuckDB SQL) under a name."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def rounded(c: Column) -> Column:
    """To a fixed number of places, with one zero."""
    return F.round(c, PLACES) + F.lit(0.0)


def sql_rounded(expression: str) -> str:
    return f"round({expression}, {PLACES}) + 0.0"
