"""Operators on ragged series: windows count a ticker's own rows, need them all filled, and use sample moments."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES: dict[str, Callable[..., DataFrame]] = {}
def own():
    """A ticker's history."""
    return Window.partitionBy("ticker").orderBy("date")


def day():
    """All rows of a date."""
    return Window.partitionBy("date")


def _last(n: int):
    return own().rowsBetween(-(n - 1), 0)


def _window(name: str, aggregate: Callable[..., Column]) -> None:
    """An aggregate over the last n rows; null unless n values are there."""

    def run(df: DataFrame, out: str, x: str, n: int) -> DataFrame:
        w = _last(n)
        return df.withColumn(out, F.when(F.count(x).over(w) == n, aggregate(F.col(x), w, n)))

    SERIES[name] = run


_window("Mean", lambda x, w, n: F.avg(x).over(w))
_window("Sum", lambda x, w, n: F.sum(x).over(w))
_window("Max", lambda x, w, n: F.max(x).over(w))
_window("Min", lambda x, w, n: F.min(x).over(w))
_window("Med", lambda x, w, n: F.percentile(x, F.lit(0.5)).over(w))
_window("Std", lambda x, w, n: F.stddev_samp(x).over(w))
_window("Var", lambda x, w, n: F.var_samp(x).over(w))


def _skew(x: Column, w, n: int) -> Column:
    """Spark's skewness is the population's; the factor makes it the sample's."""
    return F.skewness(x).over(w) * ((n * (n - 1)) ** 0.5 / (n - 2)) if n > 2 else F.lit(None).cast("double")


def _kurt(x: Column, w, n: int) -> Column:
    if n < 4:
        return F.lit(None).cast("double")
    return ((n + 1) * F.kurtosis(x).over(w) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


_window("Skew", _skew)
_window("Kurt", _kurt)


def _named(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    SERIES[f.__name__] = f
    return f


@_named
def Ref(df, out, x, n):
    return df.withColumn(out, F.lag(x, n).over(own()))


@_named
def Delta(df, out, x, n):
    return df.withColumn(out, F.col(x) - F.lag(x, n).over(own()))


@_named
def Count(df, out, x, n):
    return df.withColumn(out, F.when(F.row_number().over(own()) >= n, F.count(x).over(_last(n)).cast("double")))


@_named
def WMA(df, out, x, n):
    """Weights 1 to n, from two plain sums over the window."""
    row, w = F.row_number().over(own()), _last(n)
    df = df.withColumn("_row", row)
    top = F.sum(F.col("_row") * F.col(x)).over(w) + (n - F.col("_row")) * F.sum(x).over(w)
    return df.withColumn(out, F.when(F.count(x).over(w) == n, top / (n * (n + 1) / 2))).drop("_row")


@_named
def Slope(df, out, x, n):
    df = df.withColumn("_row", F.row_number().over(own()).cast("double"))
    return df.withColumn(out, F.when(F.count(x).over(_last(n)) == n, F.regr_slope(F.col(x), F.col("_row")).over(_last(n)))).drop("_row")


def _pair(name: str, aggregate: Callable[..., Column]) -> None:
    def run(df: DataFrame, out: str, x: str, y: str, n: int) -> DataFrame:
        w = _last(n)
        both = F.count(F.when(F.col(x).isNotNull(), F.col(y))).over(w) == n
        return df.withColumn(out, F.when(both, aggregate(F.col(x), F.col(y), w)))

    SERIES[name] = run


_pair("Cov", lambda x, y, w: F.covar_samp(x, y).over(w))
def _corr(x: Column, y: Column, w) -> Column:
    spread = F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)
    return F.when(spread > 1e-12, F.covar_samp(x, y).over(w) / spread)


_pair("Corr", _corr)


@_named
def Rank(df, out, x):
    """Share of the average rank among equal values."""
    ties = F.count("*").over(Window.partitionBy("date", x))
    rank = F.rank().over(day().orderBy(F.col(x).asc_nulls_last()))
    return df.withColumn(out, F.when(F.col(x).isNotNull(), (rank + (ties - 1) / 2) / F.count(x).over(day())))


@_named
def Zscore(df, out, x):
    spread = F.stddev_samp(x).over(day())
    return df.withColumn(out, F.when(spread > 1e-12, (F.col(x) - F.avg(x).over(day())) / spread))


@_named
def EMA(df, out, x, span):
    """Exponential mean with adjusted weights; a recursion, so each ticker's rows go to one Arrow batch."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pdf[["ticker", "date"]].assign(_ema=pdf[x].ewm(span=span).mean())

    ema = df.select("ticker", "date", x).groupBy("ticker").applyInPandas(run, f"ticker {kinds['ticker']}, date {kinds['date']}, _ema double")
    return df.join(ema, ["ticker", "date"]).withColumnRenamed("_ema", out)


# -- elementwise, by the rules of floating-point numbers ------------------------------------------------------------


def ieee_divide(x: Column, y: Column) -> Column:
    """x / y where y may be 0: an infinity of x's sign, no number for 0 / 0; null where either is missing."""
    at_zero = F.when(x > 0, float("inf")).when(x < 0, float("-inf")).when(x == 0, float("nan"))
    return F.when(y != 0, x / y).when(y == 0, at_zero)


def ieee_log(x: Column) -> Column:
    """Natural logarithm: minus infinity at 0, no number below it."""
    return F.when(x > 0, F.ln(x)).when(x == 0, float("-inf")).when(x < 0, float("nan"))


def ieee_power(x: Column, y: Column) -> Column:
    return F.pow(x, y)


def compared(test: Column, missing: Column) -> Column:
    """1 where a comparison holds, 0 where not; a missing operand compares as false, or gives ``missing`` where that is null."""
    return F.when(test, 1.0).when(missing.isNull(), F.lit(None).cast("double")).otherwise(0.0)


def ieee_if(test: Column, yes: Column, no: Column) -> Column:
    """``no`` where the test is 0, else ``yes``: a missing test counts as true."""
    return F.when(test == 0, no).otherwise(yes)
