"""Technical indicators on ragged bars (ticker, date, open, high, low, close, volume): windows, and one helper for recursions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def own():
    """A ticker's history."""
    return Window.partitionBy("ticker").orderBy("date")


def last(n: int):
    return own().rowsBetween(-(n - 1), 0)


def recursive_means(df: DataFrame, value: str, spans: dict[str, int], signal: tuple[str, str, str, int] | None = None) -> DataFrame:
    """``df`` with exponential means of ``value`` that start at its first row (weight 2 / (span + 1) for the new one).

    ``signal`` = (name, fast, slow, span) adds fast - slow less its own mean of that span.  A recursion over a ticker's
    rows: they go through one Arrow batch, in order of date, with all their columns, so nothing is joined back.
    """
    names = list(spans) + ([signal[0]] if signal else [])
    schema = ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [f"`{n}` double" for n in names])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        for name, span in spans.items():
            pdf[name] = pdf[value].ewm(span=span, adjust=False).mean()
        if signal:
            name, fast, slow, span = signal
            line = pdf[fast] - pdf[slow]
            pdf[name] = line - line.ewm(span=span, adjust=False).mean()
        return pdf

    return df.groupBy("ticker").applyInPandas(run, schema)


def when_full(n: int, x: str, value: Column) -> Column:
    """Null unless the last n rows all have a value."""
    return F.when(F.count(x).over(last(n)) == n, value)


def rsi(df: DataFrame, out: str, n: int = 14) -> DataFrame:
    """Relative strength from plain means of n gains and losses; null without them or without a loss."""
    df = df.withColumn("_d", F.col("close") - F.lag("close").over(own()))
    df = df.withColumn("_up", F.greatest("_d", F.lit(0.0))).withColumn("_down", F.greatest(-F.col("_d"), F.lit(0.0)))
    df = df.withColumn("_up", F.when(F.col("_d").isNotNull(), F.col("_up"))).withColumn("_down", F.when(F.col("_d").isNotNull(), F.col("_down")))
    gain, loss = when_full(n, "_up", F.avg("_up").over(last(n))), when_full(n, "_down", F.avg("_down").over(last(n)))
    return df.withColumn("_gain", gain).withColumn("_loss", loss).withColumn(out, F.when(F.col("_loss") != 0, 100 - 100 / (1 + F.col("_gain") / F.col("_loss")))).drop("_d", "_up", "_down", "_gain", "_loss")


def true_range_mean(df: DataFrame, out: str, n: int = 14) -> DataFrame:
    """Mean over n rows of the widest of the bar's range and its distances to the close before."""
    before = F.lag("close").over(own())
    df = df.withColumn("_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return df.withColumn(out, when_full(n, "_range", F.avg("_range").over(last(n)))).drop("_range")


def slope_z(df: DataFrame, n: int = 18, m: int = 126) -> DataFrame:
    """``slope`` of high on low over n rows and ``rz``, its distance from its mean over m rows in sample deviations."""
    spread = F.var_samp("low").over(last(n))
    df = df.withColumn("slope", when_full(n, "low", F.when(spread > 1e-12, F.covar_samp("high", "low").over(last(n)) / spread)))
    sd = F.stddev_samp("slope").over(last(m))
    return df.withColumn("rz", when_full(m, "slope", F.when(sd > 1e-12, (F.col("slope") - F.avg("slope").over(last(m))) / sd)))


def clipped(x: Column, limit: float = 3.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), x)))
