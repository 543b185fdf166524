"""All queries of the library with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkfolio.plans import assembly, backtests, extra, factors, ledgers, mining, more, newsroom, portfolio, research, signals, validation  # noqa: F401  they register their queries
from sparkfolio.plans.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rank IC of a two-leg factor expression against next-session returns."""
    return QUERIES["b8_ordinal_ic"](spark, sf_dir)
