"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.functions.shipping import ship_package
from sparkfolio.functions.staging import new_folder, staged, unstage

__all__ = ["LOWER", "SPACE", "UPPER", "ascii_lower", "columns_of", "lines_of", "new_folder", "quoted", "staged", "table", "unstage", "words_of"]

#: ASCII white space, the separators of words.
SPACE = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, read by Spark alone; the package goes to the executors with the first one."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else: ``lower`` where all is ASCII, a slower map of letters elsewhere."""
    return F.when(F.char_length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Array of the words (runs without ASCII white space) of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+", -1), "")


def lines_of(text: Column) -> Column:
    """Array of the \\n-split lines; null counts as one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def columns_of(df: DataFrame, *, without: Iterable[str] = ()) -> list[Column]:
    """The columns of ``df``, whatever their names hold, but for those named (in any case) as ``without``."""
    gone = {x.lower() for x in without}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in gone]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
