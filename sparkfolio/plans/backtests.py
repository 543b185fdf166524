"""Queries of the backtest operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.operators import backtest as b
from sparkfolio.operators import gram
from sparkfolio.operators.expression import evaluate, evaluate_many
from sparkfolio.functions.staging import staged
from sparkfolio.plans.common import query, rounded
from sparkfolio.plans.common import sql_rounded as r
from sparkfolio.plans.factors import LIBRARY, WT, full, w
from sparkfolio.sources.market import PANEL_SQL, panel

HORIZONS = (1, 2, 3, 5)
FACTOR = "ts_mean(returns, 5)"


def factor_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(panel(spark, sf_dir), FACTOR, out="factor").withColumn("fwd", b.forward_return(1))


FAC = f"{PANEL_SQL}, fac AS (SELECT *, {full(5, f'avg(returns) {w(5)}')} AS factor, lead(close, 1) OVER ({WT}) / nullif(close, 0) - 1 AS fwd FROM panel)"
CORR = "CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
PAIRS = FAC + ", pairs AS (SELECT * FROM fac WHERE factor IS NOT NULL AND fwd IS NOT NULL)"
RANKED = (
    PAIRS
    + """, ranked AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY factor) + (count(*) OVER (PARTITION BY date, factor) - 1) / 2.0 AS rf,
    rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS rr FROM pairs),
  ic AS (SELECT date, """
    + CORR.format(x="factor", y="fwd")
    + " AS pearson, "
    + CORR.format(x="rf", y="rr")
    + " AS spearman FROM ranked GROUP BY date)"
)
ORDINAL = (
    PAIRS
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor, ticker) AS rf, row_number() OVER (PARTITION BY date ORDER BY fwd, ticker) AS rr FROM pairs),
  ic AS (SELECT date, coalesce(CASE WHEN count(*) >= 3 THEN """
    + CORR.format(x="rf", y="rr")
    + " END, 0) AS ic, count(*) AS n FROM ranked GROUP BY date)"
)


@query("b1_forward_returns", f"WITH {PANEL_SQL} SELECT date, ticker, " + ", ".join(f"{r(f'lead(close, {n}) OVER ({WT}) / nullif(close, 0) - 1')} AS fwd_{n}" for n in HORIZONS) + " FROM panel")
def b1_forward_returns(spark, sf_dir):
    return panel(spark, sf_dir).select("date", "ticker", *[rounded(b.forward_return(n)).alias(f"fwd_{n}") for n in HORIZONS])


@query("b2_daily_ic", f"WITH {RANKED} SELECT date, {r('pearson')} AS pearson, {r('spearman')} AS spearman FROM ic")
def b2_daily_ic(spark, sf_dir):
    return b.daily_ic(factor_frame(spark, sf_dir)).select("date", rounded(F.col("pearson")).alias("pearson"), rounded(F.col("spearman")).alias("spearman"))


@query("b3_ic_summary", f"WITH {RANKED} SELECT {r('avg(spearman)')} AS mean_ic, {r('stddev_samp(spearman)')} AS std_ic, {r('coalesce(CASE WHEN stddev_samp(spearman) > 1e-12 THEN avg(spearman) / stddev_samp(spearman) END, 0)')} AS ir, count(spearman) AS n FROM ic")
def b3_ic_summary(spark, sf_dir):
    ic = b.daily_ic(factor_frame(spark, sf_dir))
    mean, spread = F.avg("spearman"), F.stddev_samp("spearman")
    return ic.agg(rounded(mean).alias("mean_ic"), rounded(spread).alias("std_ic"), rounded(F.coalesce(F.when(spread > 1e-12, mean / spread), F.lit(0.0))).alias("ir"), F.count("spearman").alias("n"))


_DECAY = ", ".join(f"lead(close, {n}) OVER ({WT}) / nullif(close, 0) - 1 AS f{n}" for n in HORIZONS)


@query(
    "b4_alpha_decay",
    f"WITH {FAC}, wide AS (SELECT date, ticker, factor, {_DECAY} FROM fac), long AS ("
    + " UNION ALL ".join(f"SELECT {n} AS horizon, date, factor, f{n} AS fwd FROM wide" for n in HORIZONS)
    + f"), ic AS (SELECT horizon, date, {CORR.format(x='factor', y='fwd')} AS ic FROM long WHERE factor IS NOT NULL AND fwd IS NOT NULL GROUP BY horizon, date) SELECT horizon, {r('avg(ic)')} AS mean_ic FROM ic GROUP BY horizon",
)
def b4_alpha_decay(spark, sf_dir):
    wide = factor_frame(spark, sf_dir).select("date", "factor", *[b.forward_return(n).alias(str(n)) for n in HORIZONS])
    long = wide.unpivot(["date", "factor"], [str(n) for n in HORIZONS], "horizon", "fwd")
    ic = b.pairs(long).groupBy("horizon", "date").agg(b.correlation(F.col("factor"), F.col("fwd")).alias("ic"))
    return ic.groupBy(F.col("horizon").cast("int").alias("horizon")).agg(rounded(F.avg("ic")).alias("mean_ic"))


@query(
    "b5_quintile_spread",
    f"""WITH {PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor DESC, ticker DESC) AS d, row_number() OVER (PARTITION BY date ORDER BY factor, ticker) AS a,
    ceil(0.2 * count(*) OVER (PARTITION BY date)) AS k, count(*) OVER (PARTITION BY date) AS n FROM pairs)
    SELECT date, {r('avg(fwd) FILTER (d <= k) - avg(fwd) FILTER (a <= k)')} AS spread FROM o WHERE n >= 5 GROUP BY date""",
)
def b5_quintile_spread(spark, sf_dir):
    p = b.pairs(factor_frame(spark, sf_dir)).withColumn("a", b.ordinal_rank("factor")).withColumn("n", F.count("*").over(b.day())).withColumn("k", F.ceil(0.2 * F.col("n")))
    top, bottom = F.avg(F.when(F.col("n") - F.col("a") < F.col("k"), F.col("fwd"))), F.avg(F.when(F.col("a") <= F.col("k"), F.col("fwd")))
    return p.where("n >= 5").groupBy("date").agg(rounded(top - bottom).alias("spread"))


@query(
    "b7_rank_turnover",
    f"""WITH {FAC}, k AS (SELECT date, ticker, rank() OVER (PARTITION BY date ORDER BY factor) / CAST(count(*) OVER (PARTITION BY date) AS DOUBLE) AS p FROM fac WHERE factor IS NOT NULL),
    c AS (SELECT date, abs(p - lag(p) OVER ({WT})) AS moved FROM k), m AS (SELECT date, avg(moved) AS moved FROM c GROUP BY date) SELECT {r('avg(moved)')} AS turnover FROM m""",
)
def b7_rank_turnover(spark, sf_dir):
    k = factor_frame(spark, sf_dir).where("factor is not null").withColumn("p", F.rank().over(b.day().orderBy("factor")) / F.count("*").over(b.day()))
    moved = k.withColumn("moved", F.abs(F.col("p") - F.lag("p").over(b.own()))).groupBy("date").agg(F.avg("moved").alias("moved"))
    return moved.agg(rounded(F.avg("moved")).alias("turnover"))


@query("b8_ordinal_ic", f"WITH {ORDINAL} SELECT date, {r('ic')} AS ic, n FROM ic")
def b8_ordinal_ic(spark, sf_dir):
    return b.ordinal_ic(factor_frame(spark, sf_dir)).select("date", rounded(F.col("ic")).alias("ic"), "n")


BOOK = (
    FAC
    + """, sh AS (SELECT *, CASE WHEN factor IS NOT NULL AND count(factor) OVER (PARTITION BY date) >= 10
      THEN row_number() OVER (PARTITION BY date ORDER BY factor NULLS LAST, ticker) / CAST(count(factor) OVER (PARTITION BY date) AS DOUBLE) END AS share FROM fac),
  bk AS (SELECT *, CASE WHEN share >= 1 - 0.2 THEN 1.0 / count(*) FILTER (share >= 1 - CAST(0.2 AS DOUBLE)) OVER (PARTITION BY date)
      WHEN share <= CAST(0.2 AS DOUBLE) THEN -1.0 / count(*) FILTER (share <= CAST(0.2 AS DOUBLE)) OVER (PARTITION BY date) ELSE 0 END AS weight FROM sh)"""
).replace("share >= 1 - 0.2 THEN", "share >= 1 - CAST(0.2 AS DOUBLE) THEN")
RETURNS = (
    BOOK
    + f""", tr AS (SELECT *, abs(weight - coalesce(lag(weight) OVER ({WT}), 0)) AS traded FROM bk),
  dy AS (SELECT date, sum(weight * coalesce(fwd, 0)) AS pnl, sum(traded) AS turn FROM tr GROUP BY date),
  ret AS (SELECT date, lag(pnl) OVER (ORDER BY date) AS gross, lag(turn) OVER (ORDER BY date) AS turnover, lag(turn * 5 / 10000) OVER (ORDER BY date) AS cost FROM dy)"""
)


@query("b9_book_weights", f"WITH {BOOK} SELECT date, ticker, {r('CAST(weight AS DOUBLE)')} AS weight FROM bk")
def b9_book_weights(spark, sf_dir):
    return b.book(factor_frame(spark, sf_dir)).select("date", "ticker", rounded(F.col("weight")).alias("weight"))


@query("b10_b11_book_returns", f"WITH {RETURNS} SELECT date, {r('gross')} AS gross, {r('turnover')} AS turnover, {r('cost')} AS cost, {r('gross - cost')} AS net FROM ret")
def b10_b11_book_returns(spark, sf_dir):
    out = b.book_returns(b.book(factor_frame(spark, sf_dir)))
    return out.select("date", *[rounded(F.col(c)).alias(c) for c in ("gross", "turnover", "cost", "net")])


CURVE = RETURNS + ", eq AS (SELECT date, 100000 * product(1 + coalesce(gross - cost, 0)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM ret)"


@query("b12_equity_curve", f"WITH {CURVE} SELECT date, round(equity, 3) AS equity, {r('equity / max(equity) OVER (ORDER BY date) - 1')} AS drawdown FROM eq")
def b12_equity_curve(spark, sf_dir):
    curve = b.equity(b.book_returns(b.book(factor_frame(spark, sf_dir))))
    return curve.select("date", F.round("equity", 3).alias("equity"), rounded(F.col("drawdown")).alias("drawdown"))


@query(
    "b6_portfolio_stats",
    f"WITH {CURVE}, d AS (SELECT min(dd) AS dd FROM (SELECT equity / max(equity) OVER (ORDER BY date) - 1 AS dd FROM eq)) SELECT {r('CASE WHEN stddev_samp(gross - cost) > 1e-12 THEN avg(gross - cost) / stddev_samp(gross - cost) * sqrt(252) END')} AS sharpe, {r('avg(gross - cost) * 252')} AS annual, {r('any_value(dd)')} AS max_drawdown FROM ret CROSS JOIN d",
)
def b6_portfolio_stats(spark, sf_dir):
    returns = b.book_returns(b.book(factor_frame(spark, sf_dir)))
    stats = returns.agg(rounded(F.when(F.stddev_samp("net") > 1e-12, F.avg("net") / F.stddev_samp("net") * F.sqrt(F.lit(252.0)))).alias("sharpe"), rounded(F.avg("net") * 252).alias("annual"))
    worst = b.equity(returns).agg(rounded(F.min("drawdown")).alias("max_drawdown"))
    return stats.join(worst)  # one row each


@query("b15_monthly_returns", f"WITH {RETURNS} SELECT CAST(year(date) AS INT) AS y, CAST(month(date) AS INT) AS m, {r('product(1 + gross - cost) - 1')} AS ret, count(gross) AS days FROM ret GROUP BY ALL")
def b15_monthly_returns(spark, sf_dir):
    returns = b.book_returns(b.book(factor_frame(spark, sf_dir)))
    return returns.groupBy(F.year("date").alias("y"), F.month("date").alias("m")).agg(rounded(F.product(1 + F.col("net")) - 1).alias("ret"), F.count("gross").alias("days"))


@query(
    "b16_market_regimes",
    f"""WITH {PANEL_SQL}, m AS (SELECT date, avg(close) AS level FROM panel GROUP BY date), c AS (SELECT date, level / lag(level, 5) OVER (ORDER BY date) - 1 AS change FROM m)
    SELECT date, CASE WHEN change IS NULL THEN 'warm_up' WHEN change > 0.05 THEN 'bull' WHEN change < -0.05 THEN 'bear' ELSE 'sideways' END AS regime FROM c""",
)
def b16_market_regimes(spark, sf_dir):
    level = panel(spark, sf_dir).groupBy("date").agg(F.avg("close").alias("level"))
    change = F.col("level") / F.lag("level", 5).over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1
    regime = F.when(F.col("change").isNull(), "warm_up").when(F.col("change") > 0.05, "bull").when(F.col("change") < -0.05, "bear").otherwise("sideways")
    return level.withColumn("change", change).select("date", regime.alias("regime"))


@query(
    "b23_rank_stability",
    f"""WITH {FAC}, k AS (SELECT date, ticker, CAST(row_number() OVER (PARTITION BY date ORDER BY factor, ticker) AS DOUBLE) AS p FROM fac WHERE factor IS NOT NULL),
    c AS (SELECT date, p, lag(p) OVER ({WT}) AS q FROM k), s AS (SELECT date, {CORR.format(x='p', y='q')} AS s FROM c WHERE q IS NOT NULL GROUP BY date) SELECT {r('avg(s)')} AS stability FROM s""",
)
def b23_rank_stability(spark, sf_dir):
    k = factor_frame(spark, sf_dir).where("factor is not null").withColumn("p", b.ordinal_rank("factor").cast("double"))
    k = k.withColumn("q", F.lag("p").over(b.own())).where("q is not null")
    return k.groupBy("date").agg(b.correlation(F.col("p"), F.col("q")).alias("s")).agg(rounded(F.avg("s")).alias("stability"))


@query("b28_ic_series", f"WITH {ORDINAL} SELECT date, {r('ic')} AS ic, {r('avg(ic) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} AS mean_20 FROM ic")
def b28_ic_series(spark, sf_dir):
    line = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-19, 0)
    return b.ordinal_ic(factor_frame(spark, sf_dir)).select("date", rounded(F.col("ic")).alias("ic"), rounded(F.avg("ic").over(line)).alias("mean_20"))


@query(
    "b29_sector_exposure",
    f"""WITH {BOOK} SELECT date, sector, {r('CAST(sum(greatest(weight, 0)) AS DOUBLE)')} AS long_share, {r('CAST(-sum(least(weight, 0)) AS DOUBLE)')} AS short_share, {r('CAST(sum(weight) AS DOUBLE)')} AS net_share FROM bk GROUP BY date, sector""",
)
def b29_sector_exposure(spark, sf_dir):
    weight, zero = F.col("weight"), F.lit(0.0)
    return b.book(factor_frame(spark, sf_dir)).groupBy("date", "sector").agg(
        rounded(F.sum(F.greatest(weight, zero))).alias("long_share"), rounded(-F.sum(F.least(weight, zero))).alias("short_share"), rounded(F.sum(weight)).alias("net_share")
    )


# -- a library of factors ------------------------------------------------------------------------------------------

_LONG = " UNION ALL ".join(f"SELECT '{n}' AS factor_name, date, ticker, v AS factor FROM (SELECT *, {s} AS v FROM panel)" for n, (_, s) in LIBRARY.items())
LIB = f"""{PANEL_SQL}, nx AS (SELECT date, ticker, lead(close, 1) OVER ({WT}) / nullif(close, 0) - 1 AS fwd FROM panel), long AS ({_LONG}),
  sh AS (SELECT l.*, x.fwd, row_number() OVER (PARTITION BY factor_name, date ORDER BY factor, ticker) / CAST(count(*) OVER (PARTITION BY factor_name, date) AS DOUBLE) AS share,
         count(*) OVER (PARTITION BY factor_name, date) AS n FROM long l JOIN nx x USING (date, ticker) WHERE factor IS NOT NULL AND fwd IS NOT NULL),
  lr AS (SELECT factor_name, date, avg(fwd) FILTER (share >= 1 - CAST(0.2 AS DOUBLE)) - avg(fwd) FILTER (share <= CAST(0.2 AS DOUBLE)) AS ret FROM sh WHERE n >= 10 GROUP BY factor_name, date)"""


def library_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """factor_name, date and long-short return of each factor of the library."""
    base = panel(spark, sf_dir)
    long = evaluate_many(base, {n: e for n, (e, _) in LIBRARY.items()})
    ahead = base.select("date", "ticker", b.forward_return(1).alias("fwd"))
    p = long.withColumnRenamed("value", "factor").join(ahead, ["date", "ticker"]).where("factor is not null and fwd is not null")
    day = Window.partitionBy("factor_name", "date")
    p = p.withColumn("n", F.count("*").over(day)).withColumn("share", F.row_number().over(day.orderBy("factor", "ticker")) / F.col("n"))
    top, bottom = F.avg(F.when(F.col("share") >= 0.8, F.col("fwd"))), F.avg(F.when(F.col("share") <= 0.2, F.col("fwd")))
    return p.where("n >= 10").groupBy("factor_name", "date").agg((top - bottom).alias("ret"))


def series_of(lr: DataFrame) -> DataFrame:
    """Returns of factors as series: name, date, value."""
    return lr.select(F.col("factor_name").alias("name"), "date", F.col("ret").alias("value"))


@query("m1_library_returns", f"WITH {LIB} SELECT factor_name, date, {r('ret')} AS ret FROM lr")
def m1_library_returns(spark, sf_dir):
    return library_returns(spark, sf_dir).select("factor_name", "date", rounded(F.col("ret")).alias("ret"))


@query(
    "m2_return_correlations",
    f"""WITH {LIB} SELECT *, abs(c) > 0.8 AS warned FROM (SELECT a.factor_name AS a, b.factor_name AS b, {r('CASE WHEN stddev_samp(a.ret) * stddev_samp(b.ret) > 1e-24 THEN covar_pop(a.ret, b.ret) / (stddev_samp(a.ret) * stddev_samp(b.ret)) END')} AS c, count(*) AS n
    FROM lr a JOIN lr b ON a.date = b.date AND a.factor_name < b.factor_name WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY ALL)""",
)
def m2_return_correlations(spark, sf_dir):
    """Population covariance over sample deviations of all pairs of factors, from blocked Gram matrices."""
    p = gram.pair_sums(staged(series_of(library_returns(spark, sf_dir))))
    # deviations of a sample: null for one date, as is the product of the two
    spread = F.when(F.col("n") > 1, F.sqrt(gram.variance("x")) * F.sqrt(gram.variance("y")) * F.col("n") / (F.col("n") - 1))
    met = p.select("a", "b", rounded(F.when(spread > 1e-24, gram.covariance() / spread)).alias("c"), "n")
    return met.withColumn("warned", F.abs("c") > 0.8)


@query(
    "m3_self_correlation_gate",
    f"""WITH {LIB}, g AS (SELECT a.factor_name AS candidate, b.factor_name AS saved, abs({CORR.format(x='a.ret', y='b.ret')}) AS c FROM lr a JOIN lr b ON a.date = b.date
      WHERE a.factor_name IN ('reversal_1', 'close_to_vwap') AND b.factor_name NOT IN ('reversal_1', 'close_to_vwap') GROUP BY ALL)
    SELECT candidate, arg_max(saved, c) AS nearest, {r('max(c)')} AS likeness, max(c) >= 0.7 AS rejected FROM g GROUP BY candidate""",
)
def m3_self_correlation_gate(spark, sf_dir):
    """Each new factor's nearest saved one: blocks of new factors against blocks of saved ones."""
    lr = staged(series_of(library_returns(spark, sf_dir)))
    new = F.col("name").isin("reversal_1", "close_to_vwap")
    g = gram.pair_sums(lr.where(new), lr.where(~new)).select(F.col("a").alias("candidate"), F.col("b").alias("saved"), F.abs(gram.correlation()).alias("c"))
    return g.groupBy("candidate").agg(F.max_by("saved", "c").alias("nearest"), rounded(F.max("c")).alias("likeness"), (F.max("c") >= 0.7).alias("rejected"))


@query("m5_daily_differences", f"WITH {LIB}, cum AS (SELECT factor_name, date, sum(ret) OVER (PARTITION BY factor_name ORDER BY date) AS c FROM lr) SELECT factor_name, date, {r('c - lag(c) OVER (PARTITION BY factor_name ORDER BY date)')} AS d FROM cum")
def m5_daily_differences(spark, sf_dir):
    own = Window.partitionBy("factor_name").orderBy("date")
    cum = library_returns(spark, sf_dir).withColumn("c", F.sum("ret").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return cum.select("factor_name", "date", rounded(F.col("c") - F.lag("c").over(own)).alias("d"))


