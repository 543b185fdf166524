"""Backtest steps on a panel: forward returns, information coefficients, books and their returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def own():
    """A ticker's history."""
    return Window.partitionBy("ticker").orderBy("date")


def day():
    """All rows of a date."""
    return Window.partitionBy("date")


def forward_return(n: int = 1, price: str = "close") -> Column:
    """Return over the next n sessions."""
    now = F.col(price)
    return F.when(now != 0, F.lead(price, n).over(own()) / now - 1)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, null where either side does not vary (an aggregate; nulls must have gone)."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 1e-12, F.covar_pop(x, y) / spread)


def pairs(df: DataFrame, x: str = "factor", y: str = "fwd") -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def average_rank(x: str) -> Column:
    """Rank within the date, equal values sharing their mean rank."""
    return F.rank().over(day().orderBy(x)) + (F.count("*").over(Window.partitionBy("date", x)) - 1) / 2


def ordinal_rank(x: str) -> Column:
    return F.row_number().over(day().orderBy(x, "ticker"))


def daily_ic(df: DataFrame) -> DataFrame:
    """date, pearson and spearman (average ranks) of factor and forward return."""
    ranked = pairs(df).withColumn("rf", average_rank("factor")).withColumn("rr", average_rank("fwd"))
    return ranked.groupBy("date").agg(correlation(F.col("factor"), F.col("fwd")).alias("pearson"), correlation(F.col("rf"), F.col("rr")).alias("spearman"))


def ordinal_ic(df: DataFrame) -> DataFrame:
    """date and rank IC with ties broken by ticker; 0 where fewer than three pairs or no spread."""
    ranked = pairs(df).withColumn("rf", ordinal_rank("factor")).withColumn("rr", ordinal_rank("fwd"))
    ic = F.when(F.count("*") >= 3, correlation(F.col("rf"), F.col("rr")))
    return ranked.groupBy("date").agg(F.coalesce(ic, F.lit(0.0)).alias("ic"), F.count("*").alias("n"))


def book(df: DataFrame, top: float = 0.2, bottom: float = 0.2, least: int = 10) -> DataFrame:
    """``df`` with ``weight``: equal long weights above rank 1 - top, equal short ones up to rank bottom, 0 elsewhere."""
    n = F.count("factor").over(day())
    share = F.when(F.col("factor").isNotNull(), F.row_number().over(day().orderBy(F.col("factor").asc_nulls_last(), "ticker")) / n)
    df = df.withColumn("_share", F.when(n >= least, share))
    long, short = F.col("_share") >= 1 - top, F.col("_share") <= bottom
    df = df.withColumn("_long", F.sum(long.cast("int")).over(day())).withColumn("_short", F.sum(short.cast("int")).over(day()))
    return df.withColumn("weight", F.when(long, 1 / F.col("_long")).when(short, -1 / F.col("_short")).otherwise(0.0)).drop("_share", "_long", "_short")


def book_returns(df: DataFrame, bps: float = 5.0) -> DataFrame:
    """date, gross, turnover, cost and net of a book, booked on the session after the decision.

    One shuffle by ticker for the weights' changes, one aggregate by date; the last step runs over dates alone.
    """
    traded = df.withColumn("traded", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(own()), F.lit(0.0))))
    daily = traded.groupBy("date").agg(F.sum(F.col("weight") * F.coalesce("fwd", F.lit(0.0))).alias("pnl"), F.sum("traded").alias("turnover"))
    line = Window.partitionBy(F.lit(0)).orderBy("date")
    cost = F.col("turnover") * bps / 10_000
    return daily.select(
        "date",
        F.lag("pnl").over(line).alias("gross"),
        F.lag("turnover").over(line).alias("turnover"),
        F.lag(cost).over(line).alias("cost"),
    ).withColumn("net", F.col("gross") - F.col("cost"))


def equity(returns: DataFrame, column: str = "net", start: float = 100_000.0) -> DataFrame:
    """date, equity and drawdown of a return series; a missing return counts as 0."""
    line = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.withColumn("equity", start * F.product(1 + F.coalesce(column, F.lit(0.0))).over(line))
    return curve.select("date", "equity", (F.col("equity") / F.max("equity").over(line) - 1).alias("drawdown"))


def charged_returns(df: DataFrame, bps: float = 5.0, slippage: float = 2.0, borrow_bps: float = 50.0, capital: float = 100_000.0) -> DataFrame:
    """date, k (its number from 0), gross, turnover, flat, slip, borrow and net, all of the decision that earned the return.

    Slippage of a trade is ``slippage`` basis points times the root of its share (in percent) of the day's dollar volume;
    borrowing costs ``borrow_bps`` a year on what is short.  A date whose decision met no return has none.
    """
    delta = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(own()), F.lit(0.0)))
    traded = df.withColumn("delta", delta)
    volume = F.col("close") * F.col("volume")
    share = F.when(volume > 0, 100 * F.col("delta") * capital / volume).otherwise(0.0)
    daily = traded.groupBy("date").agg(
        F.sum(F.col("weight") * F.col("fwd")).alias("pnl"),
        F.sum("delta").alias("moved"),
        F.sum(F.col("delta") * slippage * F.sqrt(share) / 10_000).alias("slipped"),
        (-F.sum(F.least("weight", F.lit(0.0))) * borrow_bps / (10_000 * 252)).alias("lent"),
    )
    line = Window.partitionBy(F.lit(0)).orderBy("date")
    booked = lambda c: F.lag(c).over(line)
    out = daily.select(
        "date", (F.row_number().over(line) - 1).alias("k"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("size"), "moved",
        booked("pnl").alias("gross"), booked("moved").alias("turnover"), booked(F.col("moved") * bps / 10_000).alias("flat"), booked("slipped").alias("slip"), booked("lent").alias("borrow"),
    )
    return out.withColumn("net", F.col("gross") - F.col("flat") - F.col("slip") - F.col("borrow"))


def labelled_metrics(daily: DataFrame, by: list[str]) -> DataFrame:
    """Metrics per label of daily rows (``by``, k, net, ic, moved): the dates of one label are few.

    ``moved`` is the book's change on a date; a label's first date does not count for its turnover.  Fewer than two
    returns give zeros.
    """
    line = Window.partitionBy(*by).orderBy("k")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("curve", F.product(1 + F.coalesce("net", F.lit(0.0))).over(so_far))
    d = d.withColumn("fall", F.col("curve") / F.max("curve").over(so_far) - 1).withColumn("later", F.row_number().over(line) > 1)
    spread, few = F.stddev_samp("net"), F.count("net") < 2
    ic, ic_spread, n_ic = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    t = F.when((n_ic >= 2) & (ic_spread > 1e-12), ic / (ic_spread / F.sqrt(n_ic)))
    or_zero = lambda c: F.when(few, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return d.groupBy(*by).agg(
        F.count("net").alias("n_days"),
        or_zero(F.product(1 + F.coalesce("net", F.lit(0.0))) - 1).alias("total_return"),
        or_zero(F.when(spread > 1e-12, F.avg("net") / spread * F.sqrt(F.lit(252.0)))).alias("sharpe"),
        or_zero(F.min(F.when(F.col("net").isNotNull(), F.col("fall")))).alias("max_drawdown"),
        or_zero(F.avg(F.when(F.col("later"), F.col("moved")))).alias("turnover"),
        or_zero(ic).alias("ic_mean"),
        or_zero(ic_spread).alias("ic_std"),
        or_zero(F.when(ic_spread > 1e-12, ic / ic_spread * F.sqrt(F.lit(252.0)))).alias("icir"),
        or_zero(t).alias("ic_t"),
        or_zero(F.avg((F.col("ic") > 0).cast("double"))).alias("hit_rate"),
    )
