"""Queries of books on the weekly panel, whose history is long enough for splits, regimes and folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.functions import normal
from sparkfolio.functions.staging import staged
from sparkfolio.operators import backtest as b
from sparkfolio.operators import cuts, resample
from sparkfolio.operators.expression import evaluate, evaluate_wide
from sparkfolio.operators.joins import global_ordinal
from sparkfolio.plans.backtests import CORR
from sparkfolio.plans.common import query, rounded
from sparkfolio.plans.common import sql_rounded as r
from sparkfolio.plans.factors import WT, full, w
from sparkfolio.sources.tables import WPANEL_SQL, panel_weekly, weeks

TRAIN, PURGE, EMBARGO = 0.7, 5, 5
TRIALS = 10


def _line():
    return Window.partitionBy(F.lit(0)).orderBy("date")


# -- the daily table of a book: returns after all costs, rank IC, moves ---------------------------------------------


def weekly_factor(spark: SparkSession, sf_dir: str, expression: str = "ts_mean(returns, 5)") -> DataFrame:
    return evaluate(panel_weekly(spark, sf_dir), expression, out="factor").withColumn("fwd", b.forward_return(1))


def with_ic(daily: DataFrame, factor: DataFrame) -> DataFrame:
    """The ordinal IC of each date beside its returns; dates without pairs have 0."""
    return daily.join(b.ordinal_ic(factor).select("date", "ic"), "date", "left").withColumn("ic", F.coalesce("ic", F.lit(0.0)))


def book_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, k, size, gross, turnover, flat, slip, borrow, net, moved, ic of the weekly book."""
    f = staged(weekly_factor(spark, sf_dir).select("date", "ticker", "factor", "fwd", "close", "volume"))
    return staged(with_ic(b.charged_returns(b.book(f)), f))


def _book_sql(source: str, keys: str = "", top: str = "CAST(0.2 AS DOUBLE)") -> str:
    """CTEs sh, bk, tr, dy, dd, ic, days of a factor table (date, ticker, factor, fwd, close, volume), per ``keys`` too."""
    by, at = f"{keys}date", f"PARTITION BY {keys}date"
    own, line = f"PARTITION BY {keys}ticker ORDER BY date", f"{f'PARTITION BY {keys[:-2]} ' if keys else ''}ORDER BY date"
    d2 = top
    return f"""sh AS (SELECT *, CASE WHEN factor IS NOT NULL AND count(factor) OVER ({at}) >= 10 THEN row_number() OVER ({at} ORDER BY factor NULLS LAST, ticker) / CAST(count(factor) OVER ({at}) AS DOUBLE) END AS share FROM {source}),
  bk AS (SELECT *, CAST(CASE WHEN share >= 1 - {d2} THEN 1.0 / count(*) FILTER (share >= 1 - {d2}) OVER ({at}) WHEN share <= {d2} THEN -1.0 / count(*) FILTER (share <= {d2}) OVER ({at}) ELSE 0 END AS DOUBLE) AS weight FROM sh),
  tr AS (SELECT *, abs(weight - coalesce(lag(weight) OVER ({own}), 0)) AS delta FROM bk),
  dy AS (SELECT {by}, sum(weight * fwd) AS pnl, sum(delta) AS moved, sum(delta * 2.0 * sqrt(CASE WHEN close * volume > 0 THEN 100 * delta * 100000 / (close * volume) ELSE 0 END) / 10000) AS slipped,
    -sum(least(weight, 0)) * 50.0 / (10000 * 252) AS lent FROM tr GROUP BY {by}),
  dd AS (SELECT *, row_number() OVER v - 1 AS k, lag(pnl) OVER v AS gross, lag(moved) OVER v AS turnover, lag(moved * 5.0 / 10000) OVER v AS flat, lag(slipped) OVER v AS slip, lag(lent) OVER v AS borrow FROM dy WINDOW v AS ({line})),
  rk AS (SELECT *, row_number() OVER ({at} ORDER BY factor, ticker) AS rf, row_number() OVER ({at} ORDER BY fwd, ticker) AS rr FROM {source} WHERE factor IS NOT NULL AND fwd IS NOT NULL),
  ics AS (SELECT {by}, coalesce(CASE WHEN count(*) >= 3 THEN {CORR.format(x="rf", y="rr")} END, 0) AS ic FROM rk GROUP BY {by}),
  days AS (SELECT dd.*, gross - flat - slip - borrow AS net, coalesce(ic, 0) AS ic, count(*) OVER ({f'PARTITION BY {keys[:-2]}' if keys else ''}) AS size FROM dd LEFT JOIN ics USING ({by}))"""


WFAC = f"{WPANEL_SQL}, wf AS (SELECT date, ticker, sector, close, volume, {full(5, f'avg(returns) {w(5)}')} AS factor, lead(close, 1) OVER ({WT}) / nullif(close, 0) - 1 AS fwd FROM wpanel)"
DAYS = f"{WFAC}, {_book_sql('wf')}"


def _metrics_sql(source: str, by: str) -> str:
    """CTEs curve, falls, metrics of labelled days."""
    v = f"PARTITION BY {by} ORDER BY k"
    z = lambda e: f"CASE WHEN count(net) < 2 THEN 0.0 ELSE coalesce({e}, 0.0) END"
    return f"""curve AS (SELECT *, product(1 + coalesce(net, 0)) OVER ({v} ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER ({v}) > 1 AS later FROM {source}),
  falls AS (SELECT *, c / max(c) OVER ({v} ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM curve),
  metrics AS (SELECT {by}, count(net) AS n_days, {z('product(1 + coalesce(net, 0)) - 1')} AS total_return, {z('CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) * sqrt(252) END')} AS sharpe,
    {z('min(fall) FILTER (net IS NOT NULL)')} AS max_drawdown, {z('avg(moved) FILTER (later)')} AS turnover, {z('avg(ic)')} AS ic_mean, {z('stddev_samp(ic)')} AS ic_std,
    {z('CASE WHEN stddev_samp(ic) > 1e-12 THEN avg(ic) / stddev_samp(ic) * sqrt(252) END')} AS icir, {z('CASE WHEN count(ic) >= 2 AND stddev_samp(ic) > 1e-12 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) END')} AS ic_t,
    {z('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END)')} AS hit_rate FROM falls GROUP BY {by})"""


METRICS = ["total_return", "sharpe", "max_drawdown", "turnover", "ic_mean", "ic_std", "icir", "ic_t", "hit_rate"]
_ROUNDED = ", ".join(f"{r(f'CAST({m} AS DOUBLE)')} AS {m}" for m in METRICS)


def _all_rounded(df: DataFrame, *first: str) -> DataFrame:
    return df.select(*first, *[rounded(F.col(m)).alias(m) for m in METRICS])


COSTS = ["gross", "turnover", "flat", "slip", "borrow", "net"]


@query("b11_all_costs", f"WITH {DAYS} SELECT date, {', '.join(f'{r(c)} AS {c}' for c in COSTS)} FROM days")
def b11_all_costs(spark, sf_dir):
    """Flat cost of turnover, slippage by share of dollar volume, and borrowing, each of the decision that earned the return."""
    return book_days(spark, sf_dir).select("date", *[rounded(F.col(c)).alias(c) for c in COSTS])


@query("b12_benchmark_curve", f"""WITH {DAYS}, lv AS (SELECT date, avg(close) AS level FROM wpanel GROUP BY date), e AS (SELECT date, 100000 * product(1 + coalesce(net, 0)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM days)
  SELECT date, round(equity, 3) AS equity, round(100000 * level / first_value(level) OVER (ORDER BY date), 3) AS benchmark, {r('equity / max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1')} AS drawdown FROM e JOIN lv USING (date)""")  # fmt: skip
def b12_benchmark_curve(spark, sf_dir):
    """The book's equity, the benchmark rescaled to the same start, and the drawdown."""
    level = panel_weekly(spark, sf_dir).groupBy("date").agg(F.avg("close").alias("level"))
    curve = b.equity(book_days(spark, sf_dir)).join(level, "date")
    bench = F.round(100_000 * F.try_divide("level", F.first("level").over(_line())), 3)
    return curve.select("date", F.round("equity", 3).alias("equity"), bench.alias("benchmark"), rounded(F.col("drawdown")).alias("drawdown"))


# -- splits, windows, regimes ---------------------------------------------------------------------------------------


def split_of(k, size):
    """Rows before the split's end less the purge are train, those from its end plus the embargo test, others neither."""
    end = F.floor(size * TRAIN)
    return F.when(k < F.greatest(F.lit(1), end - PURGE), "train").when(k >= F.least(size - 1, end + EMBARGO), "test")


_SPLIT = f"CASE WHEN k < greatest(1, floor(size * CAST({TRAIN} AS DOUBLE)) - {PURGE}) THEN 'train' WHEN k >= least(size - 1, floor(size * CAST({TRAIN} AS DOUBLE)) + {EMBARGO}) THEN 'test' END"
SPLITS = f"{DAYS}, lab AS (SELECT *, {_SPLIT} AS split FROM days WHERE {_SPLIT} IS NOT NULL), {_metrics_sql('lab', 'split')}"
_LUCK = f"(sqrt(252.0 / greatest(n_days - 1, 1)) * {normal.luckiest(TRIALS)})"


def probable_sharpe(rows: DataFrame, by: list[str], trials: int) -> DataFrame:
    """Per label of daily ``net`` returns: the Sharpe ratio's moments and the probability that it beats the luckiest of so many trials.

    Fewer than 30 returns or no spread give one half.
    """
    m = rows.where("net is not null").groupBy(*by).agg(F.count("*").alias("n"), F.avg("net").alias("mean"), F.stddev_samp("net").alias("std"), F.skewness("net").alias("skew"), F.kurtosis("net").alias("excess"))
    daily = F.when(F.col("std") > 1e-12, F.col("mean") / F.col("std"))
    m = m.withColumn("sr", daily).withColumn("lucky", F.sqrt(252.0 / F.greatest(F.col("n") - 1, F.lit(1))) * normal.luckiest(trials))
    var = (1 - F.col("skew") * F.col("sr") + F.col("excess") / 4 * F.col("sr") * F.col("sr")) / (F.col("n") - 1)
    m = m.withColumn("var", F.when(var > 0, var).otherwise(F.greatest(1 / (F.col("n") - 1), F.lit(1e-12))))
    z = (F.col("sr") - F.col("lucky") / F.sqrt(F.lit(252.0))) / F.sqrt("var")
    return m.withColumn("psr", F.when((F.col("n") >= 30) & F.col("sr").isNotNull(), normal.cdf(z)).otherwise(0.5))


def _probable_sql(source: str, by: str, trials: int, tag: str = "") -> str:
    """CTEs mo, sv, ps with psr, lucky, skew and excess per label."""
    return f"""mm{tag} AS (SELECT *, avg(net) OVER (PARTITION BY {by}) AS mu FROM {source} WHERE net IS NOT NULL),
  mo{tag} AS (SELECT {by}, count(*) AS n, any_value(mu) AS mean, stddev_samp(net) AS std, avg(power(net - mu, 2)) AS m2, avg(power(net - mu, 3)) AS m3, avg(power(net - mu, 4)) AS m4 FROM mm{tag} GROUP BY {by}),
  sv{tag} AS (SELECT *, CASE WHEN std > 1e-12 THEN mean / std END AS sr, CASE WHEN m2 > 0 THEN m3 / power(m2, 1.5) END AS skew, CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 END AS excess, sqrt(252.0 / greatest(n - 1, 1)) * {normal.luckiest(trials)} AS lucky FROM mo{tag}),
  vv{tag} AS (SELECT *, (1 - skew * sr + excess / 4 * sr * sr) / nullif(n - 1, 0) AS var FROM sv{tag}),
  ps{tag} AS (SELECT *, CASE WHEN n >= 30 AND sr IS NOT NULL THEN {normal.sql_cdf('(sr - lucky / sqrt(252.0)) / sqrt(CASE WHEN var > 0 THEN var ELSE greatest(1.0 / (n - 1), 1e-12) END)')} ELSE 0.5 END AS psr FROM vv{tag})"""


@query("b13_split_metrics", f"WITH {SPLITS}, {_probable_sql('lab', 'split', TRIALS)} SELECT split, n_days, {_ROUNDED}, {r(normal.sql_two_sided('ic_t'))} AS ic_p, {r('psr')} AS psr, {r('lucky')} AS lucky FROM metrics JOIN ps USING (split)")
def b13_split_metrics(spark, sf_dir):
    """Train and test metrics, with a purge before the split and an embargo after it, and the deflated Sharpe ratio."""
    lab = book_days(spark, sf_dir).withColumn("split", split_of(F.col("k"), F.col("size"))).where("split is not null")
    m = b.labelled_metrics(lab, ["split"]).join(probable_sharpe(lab, ["split"], TRIALS), "split")
    m = m.withColumn("p", normal.two_sided(F.col("ic_t")))  # apart from the select below, whose ic_t is rounded
    figures = [rounded(F.col(c)).alias(c) for c in METRICS]
    return m.select("split", "n_days", *figures, rounded(F.col("p")).alias("ic_p"), rounded(F.col("psr")).alias("psr"), rounded(F.col("lucky")).alias("lucky"))


@query("b14_walk_forward_metrics", f"""WITH {DAYS}, g AS (SELECT unnest(range(0, 10000, 20)) AS start), lab AS (SELECT start, days.* FROM g JOIN days ON k >= start AND k < start + 60 WHERE start + 60 <= size),
  fr AS (SELECT start, min(date) AS first_date, max(date) AS last_date FROM lab GROUP BY start), cut AS (SELECT * FROM lab WHERE k >= start + {EMBARGO} AND k < start + 60 - {PURGE}), {_metrics_sql('cut', 'start')}
  SELECT start, first_date, last_date, n_days, {_ROUNDED} FROM metrics JOIN fr USING (start)""")  # fmt: skip
def b14_walk_forward_metrics(spark, sf_dir):
    """Windows of 60 dates, 20 apart: each date names the windows it is in; the embargo and purge are cut off their ends."""
    days = book_days(spark, sf_dir)
    newest = (F.floor(F.col("k") / 20) * 20).cast("int")
    windows = F.filter(F.array(newest, newest - 20, newest - 40), lambda s: (s >= 0) & (s + 60 <= F.col("size")))
    lab = days.withColumn("start", F.explode(windows))
    frames = lab.groupBy("start").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    cut = lab.where((F.col("k") >= F.col("start") + EMBARGO) & (F.col("k") < F.col("start") + 60 - PURGE))
    m = b.labelled_metrics(cut, ["start"]).join(frames, "start")
    return _all_rounded(m, "start", "first_date", "last_date", "n_days")


def regimes(spark, sf_dir, lookback: int = 60) -> DataFrame:
    """date, level, bench (its daily return) and regime by the market's return over the lookback."""
    level = panel_weekly(spark, sf_dir).groupBy("date").agg(F.avg("close").alias("level"))
    change = F.col("level") / F.lag("level", lookback).over(_line()) - 1
    regime = F.when(F.col("change").isNull(), "warmup").when(F.col("change") > 0.05, "bull").when(F.col("change") < -0.05, "bear").otherwise("sideways")
    return level.withColumn("change", change).withColumn("bench", F.col("level") / F.lag("level").over(_line()) - 1).withColumn("regime", regime)


REGIMES = "lv AS (SELECT date, avg(close) AS level FROM wpanel GROUP BY date), rg AS (SELECT date, level, level / lag(level) OVER (ORDER BY date) - 1 AS bench, level / lag(level, 60) OVER (ORDER BY date) - 1 AS change FROM lv), reg AS (SELECT *, CASE WHEN change IS NULL THEN 'warmup' WHEN change > 0.05 THEN 'bull' WHEN change < -0.05 THEN 'bear' ELSE 'sideways' END AS regime FROM rg)"


@query("b16_regimes_60", f"WITH {WPANEL_SQL}, {REGIMES} SELECT date, {r('change')} AS change, regime FROM reg")
def b16_regimes_60(spark, sf_dir):
    return regimes(spark, sf_dir).select("date", rounded(F.col("change")).alias("change"), "regime")


def alpha_beta(pairs: DataFrame, by: list[str], least: int) -> DataFrame:
    """Per label of (net, bench): least-squares alpha and beta, the t value of alpha, R²; fewer pairs than ``least`` give zeros."""
    p = pairs.where("net is not null and bench is not null")
    s = p.groupBy(*by).agg(F.count("*").alias("n"), F.avg("bench").alias("mx"), F.avg("net").alias("my"), F.regr_sxx("net", "bench").alias("sxx"), F.regr_sxy("net", "bench").alias("sxy"), F.regr_syy("net", "bench").alias("syy"))
    known = (F.col("n") >= least) & (F.col("sxx") >= 1e-20)
    s = s.withColumn("beta", F.when(known, F.col("sxy") / F.col("sxx"))).withColumn("alpha", F.when(F.col("n") >= least, F.col("my") - F.coalesce(F.col("beta") * F.col("mx"), F.lit(0.0))))
    rss = F.greatest(F.col("syy") - F.col("beta") * F.col("sxy"), F.lit(0.0))
    se = F.sqrt(rss / (F.col("n") - 2) * (1 / F.col("n") + F.col("mx") * F.col("mx") / F.col("sxx")))
    s = s.withColumn("rss", rss).withColumn("se", F.when(known, se))
    s = s.withColumn("t", F.coalesce(F.when(F.col("se") > 1e-20, F.col("alpha") / F.col("se")), F.lit(0.0))).withColumn("r2", F.coalesce(F.when(known & (F.col("syy") > 1e-20), 1 - F.col("rss") / F.col("syy")), F.lit(0.0)))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return s.select(*by, zero("alpha"), zero("beta"), "t", F.when(F.col("t") == 0, 1.0).otherwise(normal.two_sided(F.col("t"))).alias("p"), "r2", "n")


def _alpha_sql(source: str, by: str, least: int, tag: str = "") -> str:
    """CTEs sm, ab, al with alpha, beta, t, r2, n per label."""
    return f"""sm{tag} AS (SELECT {by}, count(*) AS n, avg(bench) AS mx, avg(net) AS my, regr_sxx(net, bench) AS sxx, regr_sxy(net, bench) AS sxy, regr_syy(net, bench) AS syy FROM {source} WHERE net IS NOT NULL AND bench IS NOT NULL GROUP BY {by}),
  ab{tag} AS (SELECT *, CASE WHEN n >= {least} AND sxx >= 1e-20 THEN sxy / sxx END AS beta FROM sm{tag}),
  ac{tag} AS (SELECT *, CASE WHEN n >= {least} THEN my - coalesce(beta * mx, 0) END AS alpha, greatest(syy - beta * sxy, 0) AS rss FROM ab{tag}),
  ad{tag} AS (SELECT *, sqrt(rss / nullif(n - 2, 0) * (1.0 / n + mx * mx / sxx)) AS se FROM ac{tag}),
  al{tag} AS (SELECT {by}, n, coalesce(alpha, 0) AS alpha, coalesce(beta, 0) AS beta, coalesce(CASE WHEN beta IS NOT NULL AND se > 1e-20 THEN alpha / se END, 0) AS t, coalesce(CASE WHEN beta IS NOT NULL AND syy > 1e-20 THEN 1 - rss / syy END, 0) AS r2 FROM ad{tag})"""


_P = f"CASE WHEN t = 0 THEN 1.0 ELSE {normal.sql_two_sided('t')} END"


@query("b18_market_decomposition", f"WITH {DAYS}, {REGIMES}, pr AS (SELECT 'book' AS strategy, net, bench FROM days JOIN reg USING (date)), {_alpha_sql('pr', 'strategy', 30)} SELECT strategy, {r('alpha')} AS alpha, {r('alpha * 252')} AS alpha_year, {r('beta')} AS beta, {r('t')} AS t, {r(_P)} AS p, {r('r2')} AS r2, n FROM al")
def b18_market_decomposition(spark, sf_dir):
    """Alpha and beta against the market with the t and p value of alpha, from 30 pairs on."""
    pairs = book_days(spark, sf_dir).join(regimes(spark, sf_dir), "date").withColumn("strategy", F.lit("book"))
    a = alpha_beta(pairs, ["strategy"], 30)
    return a.select("strategy", rounded(F.col("alpha")).alias("alpha"), rounded(F.col("alpha") * 252).alias("alpha_year"), rounded(F.col("beta")).alias("beta"), rounded(F.col("t")).alias("t"), rounded(F.col("p")).alias("p"), rounded(F.col("r2")).alias("r2"), "n")


@query("b17_regime_metrics", f"""WITH {SPLITS}, {REGIMES}, tr2 AS (SELECT lab.*, regime, bench FROM lab JOIN reg USING (date) WHERE split = 'test' AND regime <> 'warmup'), {_alpha_sql('tr2', 'regime', 20)},
  g AS (SELECT regime, count(*) AS n_days, count(net) AS n_net, avg(net) / (stddev_samp(net) + 1e-12) * sqrt(252) AS sharpe, avg(ic) AS ic, avg(ic) / ((stddev_samp(ic) + 1e-12) / sqrt(count(ic))) AS ic_t, count(ic) AS n_ic FROM tr2 GROUP BY regime)
  SELECT regime, n_days, {r('sharpe')} AS sharpe, {r('ic')} AS ic, {r(normal.sql_two_sided('ic_t'))} AS ic_p, {r('alpha * 252')} AS alpha_year, {r('t')} AS alpha_t, {r(_P)} AS alpha_p FROM g JOIN al USING (regime) WHERE n_days >= 20 AND n_net >= 20 AND n_ic >= 10""")  # fmt: skip
def b17_regime_metrics(spark, sf_dir):
    """Sharpe ratio, IC and alpha per market regime of the test split; regimes of fewer than 20 days are left out."""
    days = book_days(spark, sf_dir).withColumn("split", split_of(F.col("k"), F.col("size"))).where("split = 'test'")
    d = days.join(regimes(spark, sf_dir).select("date", "bench", "regime"), "date").where("regime <> 'warmup'")
    ic_t = F.avg("ic") / ((F.stddev_samp("ic") + 1e-12) / F.sqrt(F.count("ic")))
    g = d.groupBy("regime").agg(F.count("*").alias("n_days"), F.count("net").alias("n_net"), (F.avg("net") / (F.stddev_samp("net") + 1e-12) * F.sqrt(F.lit(252.0))).alias("sharpe"), F.avg("ic").alias("ic"), ic_t.alias("ic_t"), F.count("ic").alias("n_ic"))
    g = g.where("n_days >= 20 and n_net >= 20 and n_ic >= 10").join(alpha_beta(d, ["regime"], 20), "regime")
    return g.select("regime", "n_days", rounded(F.col("sharpe")).alias("sharpe"), rounded(F.col("ic")).alias("ic"), rounded(normal.two_sided(F.col("ic_t"))).alias("ic_p"), rounded(F.col("alpha") * 252).alias("alpha_year"), rounded(F.col("t")).alias("alpha_t"), rounded(F.col("p")).alias("alpha_p"))


@query("b19_overfit_flag", f"""WITH {SPLITS}, s AS (SELECT max(sharpe) FILTER (split = 'train') AS train, max(sharpe) FILTER (split = 'test') AS test FROM metrics), d AS (SELECT *, CASE WHEN train > 0.5 THEN (train - test) / train ELSE 0 END AS decay FROM s)
  SELECT {r('train')} AS train_sharpe, {r('test')} AS test_sharpe, {r('decay')} AS decay, train > 0.5 AND decay > 0.5 AS overfit FROM d""")  # fmt: skip
def b19_overfit_flag(spark, sf_dir):
    """How much of the train split's Sharpe ratio is lost in the test split, where there was any to lose."""
    lab = book_days(spark, sf_dir).withColumn("split", split_of(F.col("k"), F.col("size"))).where("split is not null")
    of = lambda s: F.max(F.when(F.col("split") == s, F.col("sharpe"))).alias(s)
    s = b.labelled_metrics(lab, ["split"]).agg(of("train"), of("test")).withColumn("decay", F.when(F.col("train") > 0.5, (F.col("train") - F.col("test")) / F.col("train")).otherwise(0.0))
    return s.select(rounded(F.col("train")).alias("train_sharpe"), rounded(F.col("test")).alias("test_sharpe"), rounded(F.col("decay")).alias("decay"), ((F.col("train") > 0.5) & (F.col("decay") > 0.5)).alias("overfit"))


def weight_text(weight: Column) -> Column:
    """A weight to four places as plain digits with one after the point at least; a short one that rounds to nothing keeps its sign."""
    places = F.signum(weight) * F.floor(F.abs(weight) * 10_000 + 0.5) / 10_000
    return F.regexp_replace(F.format_string("%.4f", places), "0{1,3}$", "")


@query("b20_basket_breakdown", f"""WITH {DAYS}, nm AS (SELECT date, string_agg(ticker || ':' || round(weight, 4), ',' ORDER BY ticker) FILTER (weight > 0) AS longs, string_agg(ticker || ':' || round(weight, 4), ',' ORDER BY ticker) FILTER (weight < 0) AS shorts FROM bk GROUP BY date)
  SELECT date, longs, shorts, {r('coalesce(net, 0)')} AS daily_return, {r('ic')} AS daily_ic FROM nm JOIN days USING (date)""")  # fmt: skip
def b20_basket_breakdown(spark, sf_dir):
    """Names and weights of both sides of each date, with its return and IC."""
    f = staged(weekly_factor(spark, sf_dir).select("date", "ticker", "factor", "fwd", "close", "volume"))
    bk = b.book(f)
    names = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ticker", "weight")))), lambda t: F.concat_ws(":", t["ticker"].cast("string"), weight_text(t["weight"]))), ",")
    baskets = bk.groupBy("date").agg(names(F.col("weight") > 0).alias("longs"), names(F.col("weight") < 0).alias("shorts"))
    days = with_ic(b.charged_returns(bk), f)
    or_null = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return baskets.join(days, "date").select("date", or_null("longs"), or_null("shorts"), rounded(F.coalesce("net", F.lit(0.0))).alias("daily_return"), rounded(F.col("ic")).alias("daily_ic"))


# -- several strategies ---------------------------------------------------------------------------------------------

#: Factors of the weekly panel: expression, SQL, economic family.
WEEKLY = {
    "mean_5": ("ts_mean(returns, 5)", full(5, f"avg(returns) {w(5)}"), "trend"),
    "reversal": ("reverse(returns)", "-returns", "trend"),
    "calm_10": ("reverse(ts_std(returns, 10))", full(10, f"-stddev_pop(returns) {w(10)}"), "risk"),
    "volume_mean_8": ("ts_mean(volume, 8)", full(8, f"avg(volume) {w(8)}"), "activity"),
    "range_share": ("divide(subtract(high, low), vwap)", "(high - low) / nullif(vwap, 0)", "trend"),
}
_WLONG = " UNION ALL ".join(f"SELECT '{n}' AS strategy, date, ticker, v AS factor, fwd, close, volume FROM (SELECT *, {s} AS v, lead(close, 1) OVER ({WT}) / nullif(close, 0) - 1 AS fwd FROM wpanel)" for n, (_, s, _) in WEEKLY.items())
MANY = f"{WPANEL_SQL}, wl AS ({_WLONG}), {_book_sql('wl', 'strategy, ')}"


def many_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ticker, close, volume, fwd and a column for each factor of ``WEEKLY``, as they lie by ticker."""
    base = panel_weekly(spark, sf_dir, places=False).withColumn("fwd", b.forward_return(1))
    return evaluate_wide(base, {n: e for n, (e, _, _) in WEEKLY.items()}).select("date", "ticker", "close", "volume", "fwd", *WEEKLY)


def many_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`book_days`, with ``strategy``, of all factors of ``WEEKLY`` in one pass."""
    return cuts.book_days(many_factors(spark, sf_dir), {n: (n, 0.2) for n in WEEKLY}, ["date"])


@query("b21_deflated_sharpe", f"WITH {MANY}, {_probable_sql('days', 'strategy', len(WEEKLY))} SELECT strategy, n, {r('coalesce(sr, 0) * sqrt(252)')} AS sharpe, {r('skew')} AS skew, {r('excess')} AS excess, {r('lucky')} AS lucky, {r('psr')} AS psr FROM ps")
def b21_deflated_sharpe(spark, sf_dir):
    """The probability that a strategy's true Sharpe ratio beats the luckiest of as many trials as there are strategies."""
    p = probable_sharpe(many_days(spark, sf_dir), ["strategy"], len(WEEKLY))
    return p.select("strategy", "n", rounded(F.coalesce("sr", F.lit(0.0)) * F.sqrt(F.lit(252.0))).alias("sharpe"), rounded(F.col("skew")).alias("skew"), rounded(F.col("excess")).alias("excess"), rounded(F.col("lucky")).alias("lucky"), rounded(F.col("psr")).alias("psr"))


def bootstrap(values: np.ndarray, metric, block: int = 20, draws: int = 1000, seed: int = 42) -> tuple[float | None, float | None]:
    """The 2.5th and 97.5th percentile of a metric over stationary block resamples; none below five values.

    A place starts a new block with probability 1 / ``block``, else it follows its neighbour around the end.  ``metric``
    takes a matrix, one resample a row.
    """
    x = values[~np.isnan(values)]
    n = len(x)
    if n < 5:
        return None, None
    rng = np.random.default_rng(seed)
    starts = rng.integers(0, n, size=(draws, n))
    fresh = rng.random(size=(draws, n)) < 1 / max(block, 1)
    fresh[:, 0] = True
    steps = np.arange(n)
    last = np.maximum.accumulate(np.where(fresh, steps, 0), axis=1)
    got = metric(x[(np.take_along_axis(starts, last, axis=1) + steps - last) % n])
    got = got[~np.isnan(got)]
    if len(got) < 5:
        return None, None
    low, high = np.percentile(got, [2.5, 97.5])
    return float(low), float(high)


def row_sharpe(x: np.ndarray) -> np.ndarray:
    spread = x.std(axis=1, ddof=1)
    return np.where(spread > 0, x.mean(axis=1) / np.where(spread > 0, spread, 1) * np.sqrt(252.0), 0.0)


@query("b22_bootstrap_interval")
def b22_bootstrap_interval(spark, sf_dir):
    """Intervals of each strategy's Sharpe ratio and mean IC: a group is a strategy's series of dates."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        sharpe = bootstrap(pdf["net"].to_numpy(dtype=float), row_sharpe)
        ic = bootstrap(pdf["ic"].to_numpy(dtype=float), lambda x: x.mean(axis=1))
        return pd.DataFrame({"strategy": pdf["strategy"].iloc[:1], "sharpe_low": [sharpe[0]], "sharpe_high": [sharpe[1]], "ic_low": [ic[0]], "ic_high": [ic[1]]})

    days = many_days(spark, sf_dir).select("strategy", "date", "net", "ic")
    return days.groupBy("strategy").applyInPandas(run, "strategy string, sharpe_low double, sharpe_high double, ic_low double, ic_high double")


@query("b22_dealt_bootstrap")
def b22_dealt_bootstrap(spark, sf_dir):
    """The same intervals with resamples dealt to tasks: each one's draws are its own, whatever task makes it."""
    metrics = {"sharpe": ("net", lambda x: row_sharpe(x[None, :])[0]), "ic": ("ic", np.mean)}
    return resample.intervals(many_days(spark, sf_dir).select("strategy", "date", "net", "ic"), "strategy", "date", metrics)


@query("b25_turnover_and_spread", f"WITH {DAYS}, t AS (SELECT avg(moved) FILTER (k > 0) AS turnover FROM days), s AS (SELECT stddev_pop(factor) AS spread FROM wf) SELECT {r('turnover')} AS turnover, {r('coalesce(spread, 0)')} AS factor_std, coalesce(spread, 0) < 1e-9 AS degenerate FROM t, s")
def b25_turnover_and_spread(spark, sf_dir):
    """Mean change of the book between dates, and the factor's spread over all cells, which tells a factor that says nothing."""
    f = staged(weekly_factor(spark, sf_dir).select("date", "ticker", "factor", "fwd", "close", "volume"))
    turn = b.charged_returns(b.book(f)).where("k > 0").agg(rounded(F.avg("moved")).alias("turnover"))
    spread = f.agg(F.coalesce(F.stddev_pop("factor"), F.lit(0.0)).alias("s"))
    return turn.join(spread).select("turnover", rounded(F.col("s")).alias("factor_std"), (F.col("s") < 1e-9).alias("degenerate"))  # one row each


_FITNESS = "sharpe + 1.5 * icir + 5 * ic_mean - 0.25 * turnover"


@query("b27_candidate_fitness", f"WITH {MANY}, lab AS (SELECT * FROM days WHERE {_SPLIT} = 'train'), {_metrics_sql('lab', 'strategy')} SELECT strategy, {r(f'CAST({_FITNESS} AS DOUBLE)')} AS fitness, row_number() OVER (ORDER BY {_FITNESS} DESC, strategy) AS place FROM metrics")
def b27_candidate_fitness(spark, sf_dir):
    """Candidates by Sharpe, ICIR, IC and turnover of the train split alone; the test split stays unseen."""
    train = many_days(spark, sf_dir).where(split_of(F.col("k"), F.col("size")) == "train")
    m = b.labelled_metrics(train, ["strategy"]).withColumn("fitness", F.expr(_FITNESS))
    finite = F.when(F.isnan("fitness") | F.col("fitness").isNull(), F.lit(float("-inf"))).otherwise(F.col("fitness"))
    return global_ordinal(m.select("strategy", finite.alias("fitness")), None, [F.desc("fitness"), "strategy"], "place").select("strategy", rounded(F.col("fitness")).alias("fitness"), "place")


@query("b28_ic_statistics", f"""WITH {DAYS}, i AS (SELECT date, ic, CASE WHEN row_number() OVER (ORDER BY date) >= 20 THEN avg(ic) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS m FROM days WHERE k < size - 1)
  SELECT date, {r('ic')} AS ic, {r('m')} AS mean_20, {r('avg(ic) OVER ()')} AS mean_ic, {r('stddev_pop(ic) OVER ()')} AS std_ic, {r('CASE WHEN stddev_pop(ic) OVER () > 0 THEN avg(ic) OVER () / stddev_pop(ic) OVER () * sqrt(252) ELSE 0 END')} AS ir, {r('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) OVER ()')} AS hit_rate FROM i""")  # fmt: skip
def b28_ic_statistics(spark, sf_dir):
    """The IC of each date but the last with its trailing mean, and mean, spread, ratio and hit rate of them all."""
    i = book_days(spark, sf_dir).where("k < size - 1").select("date", "k", "ic")
    s = i.agg(F.avg("ic").alias("mean"), F.stddev_pop("ic").alias("std"), F.avg((F.col("ic") > 0).cast("double")).alias("hits"))
    mean = F.when(F.col("k") >= 19, F.avg("ic").over(_line().rowsBetween(-19, 0)))
    ir = F.when(F.col("std") > 0, F.col("mean") / F.col("std") * F.sqrt(F.lit(252.0))).otherwise(0.0)
    return i.withColumn("m", mean).join(F.broadcast(s)).select("date", rounded(F.col("ic")).alias("ic"), rounded(F.col("m")).alias("mean_20"), rounded(F.col("mean")).alias("mean_ic"), rounded(F.col("std")).alias("std_ic"), rounded(ir).alias("ir"), rounded(F.col("hits")).alias("hit_rate"))  # one row


@query("b29_exposure_of_extremes", f"""WITH {WFAC}, l AS (SELECT * FROM wf WHERE date = (SELECT max(date) FROM wf)), c AS (SELECT ticker, close * volume AS cap FROM l),
  q AS (SELECT ticker, least(CAST(floor((row_number() OVER (ORDER BY cap, ticker) - 1) * 5.0 / count(*) OVER ()) AS INT), 4) AS bucket, count(*) OVER () AS caps FROM c WHERE cap IS NOT NULL),
  v AS (SELECT *, row_number() OVER (ORDER BY factor DESC, ticker) AS up, row_number() OVER (ORDER BY factor, ticker DESC) AS dn, least(10, count(*) OVER () // 2) AS n FROM l WHERE factor IS NOT NULL),
  x AS (SELECT v.*, up <= n AS is_long, dn <= n AS is_short, CASE WHEN caps >= 5 THEN bucket END AS bucket FROM v LEFT JOIN q USING (ticker)),
  g AS (SELECT 'sector' AS kind, sector AS name, is_long, is_short, n FROM x UNION ALL SELECT 'cap', 'Q' || (bucket + 1), is_long, is_short, n FROM x WHERE bucket IS NOT NULL)
  SELECT kind, name, {r('100.0 * count(*) FILTER (is_long) / greatest(any_value(n), 1)')} AS long_pct, {r('100.0 * count(*) FILTER (is_short) / greatest(any_value(n), 1)')} AS short_pct,
    {r('100.0 * (count(*) FILTER (is_long) - count(*) FILTER (is_short)) / greatest(any_value(n), 1)')} AS net_pct FROM g GROUP BY kind, name""")  # fmt: skip
def b29_exposure_of_extremes(spark, sf_dir):
    """Shares of the last date's top and bottom ten names per sector and per quintile of size."""
    f = weekly_factor(spark, sf_dir)
    l = f.join(f.agg(F.max("date").alias("date")), "date", "left_semi").select("date", "ticker", "sector", "factor", (F.col("close") * F.col("volume")).alias("cap"))
    at = Window.partitionBy("date")
    caps = F.count("cap").over(at)
    bucket = F.least(F.floor((F.row_number().over(at.orderBy(F.col("cap").asc_nulls_last(), "ticker")) - 1) * 5.0 / caps).cast("int"), F.lit(4))
    x = l.withColumn("bucket", F.when(F.col("cap").isNotNull() & (caps >= 5), bucket)).where("factor is not null")
    x = x.withColumn("n", F.least(F.lit(10), F.floor(F.count("*").over(at) / 2)))
    x = x.withColumn("is_long", F.row_number().over(at.orderBy(F.desc("factor"), "ticker")) <= F.col("n")).withColumn("is_short", F.row_number().over(at.orderBy("factor", F.desc("ticker"))) <= F.col("n"))
    kinds = F.array_compact(F.array(F.struct(F.lit("sector").alias("kind"), F.col("sector").alias("name")), F.when(F.col("bucket").isNotNull(), F.struct(F.lit("cap").alias("kind"), F.concat(F.lit("Q"), F.col("bucket") + 1).alias("name")))))
    g = x.select("is_long", "is_short", "n", F.explode(kinds).alias("g")).groupBy("g.kind", "g.name").agg(F.count_if("is_long").alias("a"), F.count_if("is_short").alias("z"), F.greatest(F.first("n"), F.lit(1)).alias("n"))
    pct = lambda c: rounded(100.0 * c / F.col("n"))
    return g.select("kind", "name", pct(F.col("a")).alias("long_pct"), pct(F.col("z")).alias("short_pct"), pct(F.col("a") - F.col("z")).alias("net_pct"))


# -- robustness, folds, selection -----------------------------------------------------------------------------------

SIGMA, TAIL = 0.03, 20
_KINDS = [f"{kind}_{i}" for kind in ("gaussian", "student_t") for i in range(3)]


def _draws(kind: str):
    """Seeded noise of a cell from the digest of its keys: Box-Muller pairs of four uniform numbers."""
    digest = F.md5(F.concat_ws(":", F.lit(kind), F.col("ticker").cast("string"), F.col("date").cast("string")))
    u = [(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0 for i in range(4)]
    radius, angle = (lambda x: F.sqrt(-2 * F.ln(x))), (lambda x: 2 * F.pi() * x)
    z = [radius(u[0]) * F.cos(angle(u[1])), radius(u[0]) * F.sin(angle(u[1])), radius(u[2]) * F.cos(angle(u[3])), radius(u[2]) * F.sin(angle(u[3]))]
    return z[0] if kind.startswith("gaussian") else z[0] / F.sqrt((z[1] * z[1] + z[2] * z[2] + z[3] * z[3]) / 3)


def _draws_sql(kind: str) -> str:
    u = [f"((CAST(('0x' || substr(md5('{kind}:' || ticker || ':' || date), {8 * i + 1}, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0)" for i in range(4)]
    z = [f"(sqrt(-2 * ln({u[a]})) * {f}(2 * pi() * {u[a + 1]}))" for a in (0, 2) for f in ("cos", "sin")]
    return z[0] if kind.startswith("gaussian") else f"({z[0]} / sqrt(({z[1]} * {z[1]} + {z[2]} * {z[2]} + {z[3]} * {z[3]}) / 3))"


_TAIL = f"tl AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date DESC) AS age FROM (SELECT DISTINCT date FROM wpanel)) WHERE age BETWEEN 2 AND {TAIL + 1})"


@query("b24_perturbation_robustness", f"""WITH {WPANEL_SQL}, {_TAIL}, nz AS (SELECT *, {", ".join(f"returns * (1 + {SIGMA} * {_draws_sql(k)}) AS {k}" for k in _KINDS)} FROM wpanel),
  fx AS (SELECT date, ticker, {full(5, f"avg(returns) {w(5)}")} AS clean, {", ".join(full(5, f"avg({k}) {w(5)}") + f" AS {k}" for k in _KINDS)} FROM nz), tx AS (SELECT * FROM fx WHERE date IN (SELECT date FROM tl) AND clean IS NOT NULL),
  lg AS ({" UNION ALL ".join(f"SELECT '{k}' AS trial, date, row_number() OVER (PARTITION BY date ORDER BY clean, ticker) AS a, row_number() OVER (PARTITION BY date ORDER BY {k}, ticker) AS z FROM tx WHERE {k} IS NOT NULL" for k in _KINDS)}),
  cs AS (SELECT trial, date, {CORR.format(x="a", y="z")} AS c FROM lg GROUP BY trial, date HAVING count(*) >= 3) SELECT trial, {r("avg(c)")} AS consistency FROM cs GROUP BY trial""")  # fmt: skip
def b24_perturbation_robustness(spark, sf_dir):
    """Mean rank correlation of the factor with itself on inputs that normal and fat-tailed noise has moved, over the last dates."""
    p = panel_weekly(spark, sf_dir).select("date", "ticker", "returns")
    noisy = p.select("*", *[(F.col("returns") * (1 + SIGMA * _draws(k))).alias(f"r_{k}") for k in _KINDS])
    f = evaluate_wide(noisy, {"clean": "ts_mean(returns, 5)", **{k: f"ts_mean(r_{k}, 5)" for k in _KINDS}})
    days = p.select("date").distinct().withColumn("age", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("date")))).where(F.col("age").between(2, TAIL + 1))
    tail = f.join(days, "date", "left_semi").where("clean is not null").unpivot(["date", "ticker", "clean"], _KINDS, "trial", "noisy").where("noisy is not null")
    at = Window.partitionBy("trial", "date")
    tail = tail.withColumn("a", F.row_number().over(at.orderBy("clean", "ticker"))).withColumn("z", F.row_number().over(at.orderBy("noisy", "ticker")))
    c = tail.groupBy("trial", "date").agg(b.correlation(F.col("a"), F.col("z")).alias("c"), F.count("*").alias("n")).where("n >= 3")
    return c.groupBy("trial").agg(rounded(F.avg("c")).alias("consistency"))


FOLDS = 5
#: Rows before the first test row that its figures rest on: two decisions, each of five returns.
LEAD_IN = 7
_FOLD_ROWS = f"""ix AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM wpanel)),
  fd AS (SELECT i AS fold, CAST(floor(n * CAST(i AS DOUBLE) / {FOLDS}) AS BIGINT) AS lo, CAST(floor(n * CAST(i + 1 AS DOUBLE) / {FOLDS}) AS BIGINT) - 1 AS hi FROM (SELECT DISTINCT n FROM ix) CROSS JOIN (SELECT unnest(range({FOLDS})) AS i)),
  fr AS (SELECT fold, date AS day, t BETWEEN lo AND hi AS test, row_number() OVER (PARTITION BY fold ORDER BY t BETWEEN lo AND hi, t) - 1 AS date FROM ix JOIN fd ON t BETWEEN lo AND hi OR t < lo - {EMBARGO} OR t > hi + {EMBARGO})"""


@query("b26_purged_folds", f"""WITH {WPANEL_SQL}, {_FOLD_ROWS}, fp AS (SELECT fr.fold, fr.date, p.ticker, p.close, p.volume FROM fr JOIN wpanel p ON p.date = fr.day),
  fq AS (SELECT *, close / nullif(lag(close) OVER v, 0) - 1 AS returns, lead(close) OVER v / nullif(close, 0) - 1 AS fwd, row_number() OVER v AS rn FROM fp WINDOW v AS (PARTITION BY fold, ticker ORDER BY date)),
  ff AS (SELECT *, CASE WHEN rn >= 5 THEN avg(returns) OVER (PARTITION BY fold, ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS factor FROM fq), {_book_sql('ff', 'fold, ')},
  lab AS (SELECT days.* FROM days JOIN fr USING (fold, date) WHERE test), {_metrics_sql('lab', 'fold')},
  s AS (SELECT avg(ic_mean) AS ic, max(sharpe) - stddev_pop(sharpe) * ln(1 + count(*)) AS deflated FROM metrics)
  SELECT fold, n_days, {r('CAST(sharpe AS DOUBLE)')} AS sharpe, {r('CAST(ic_mean AS DOUBLE)')} AS ic_mean, {r('ic')} AS mean_ic, {r('deflated')} AS deflated_sharpe FROM metrics, s""")  # fmt: skip
def b26_purged_folds(spark, sf_dir):
    """Contiguous test blocks with an embargo on both sides; a fold's rows are numbered train first, then test, and scored on the test rows.

    Folds and dates are few; rows of the panel meet them by date.  A test row's figures reach back two decisions, and those
    seven closes; train rows before that have no part in any of them, so that each date is in little more than one fold.
    """
    p = panel_weekly(spark, sf_dir, places=False).select("date", "ticker", "close", "volume")
    ix = weeks(spark, sf_dir).withColumnsRenamed({"k": "t", "size": "n"})
    edge = lambda i: F.floor(F.col("n") * i.cast("double") / FOLDS).cast("long")
    fr = ix.withColumn("fold", F.explode(F.array(*[F.lit(i).cast("long") for i in range(FOLDS)])))
    fr = fr.withColumn("lo", edge(F.col("fold"))).withColumn("hi", edge(F.col("fold") + 1) - 1).withColumn("test", F.col("t").between(F.col("lo"), F.col("hi")))
    fr = fr.where(F.col("test") | (F.col("t") < F.col("lo") - EMBARGO) | (F.col("t") > F.col("hi") + EMBARGO))
    fr = fr.withColumn("at", F.row_number().over(Window.partitionBy("fold").orderBy("test", "t")) - 1)
    lead_in = F.min(F.when(F.col("test"), F.col("at"))).over(Window.partitionBy("fold")) - F.col("at")  # rows before the first test row
    fr = staged(fr.withColumn("early", F.greatest(lead_in, F.lit(0))).select("fold", "date", "at", "test", "early").where(F.col("early") <= LEAD_IN))
    rows = p.join(F.broadcast(fr.withColumnRenamed("date", "day")), F.col("date").eqNullSafe(F.col("day"))).drop("date", "day").withColumnRenamed("at", "date")  # five rows a date
    own = Window.partitionBy("fold", "ticker").orderBy("date")
    rows = rows.withColumn("returns", F.when(F.lag("close").over(own) != 0, F.col("close") / F.lag("close").over(own) - 1)).withColumn("fwd", F.when(F.col("close") != 0, F.lead("close").over(own) / F.col("close") - 1))
    rows = rows.withColumn("factor", F.when(F.col("date") >= 4, F.avg("returns").over(own.rowsBetween(-4, 0)))).where("early <= 2")
    days = cuts.book_days(rows.select("fold", "date", "ticker", "factor", "fwd", "close", "volume"), {"book": ("factor", 0.2)}, ["fold", "date"])
    test = fr.where("test").select("fold", F.col("at").alias("date"))
    m = staged(b.labelled_metrics(days.join(test, ["fold", "date"], "left_semi"), ["fold"]))
    s = m.agg(F.avg("ic_mean").alias("ic"), (F.max("sharpe") - F.stddev_pop("sharpe") * F.log1p(F.count("*").cast("double"))).alias("deflated"))
    return m.join(F.broadcast(s)).select("fold", "n_days", rounded(F.col("sharpe")).alias("sharpe"), rounded(F.col("ic_mean")).alias("ic_mean"), rounded(F.col("ic")).alias("mean_ic"), rounded(F.col("deflated")).alias("deflated_sharpe"))  # one row


TOPS = (0.1, 0.2, 0.3, 0.4)
ALPHA_T, PSR_LEAST, PICKS, PER_FAMILY = 1.5, 0.65, 6, 2
_FAMILY = "CASE name " + " ".join(f"WHEN '{n}' THEN '{f}'" for n, (_, _, f) in WEEKLY.items()) + " END"


@query("b30_selection_funnel", f"""WITH {WPANEL_SQL}, wl AS ({_WLONG}), wv AS (SELECT wl.* REPLACE (strategy || '|' || top AS strategy), top FROM wl CROSS JOIN (SELECT unnest([{", ".join(f"CAST({t} AS DOUBLE)" for t in TOPS)}]) AS top)), {_book_sql('wv', 'strategy, ', 'top')}, {REGIMES},
  tst AS (SELECT days.*, bench, regime, strategy || '|' || regime AS label FROM days JOIN reg USING (date) WHERE {_SPLIT} = 'test'), trn AS (SELECT * FROM days WHERE {_SPLIT} = 'train'),
  {_probable_sql('trn', 'strategy', TRIALS, '1')}, {_probable_sql('tst', 'strategy', TRIALS)}, {_alpha_sql('tst', 'strategy', 30)}, {_alpha_sql('tst', 'label', 20, '2')},
  vr AS (SELECT split_part(p1.strategy, '|', 1) AS name, p1.strategy, p1.psr AS train_psr, ps.psr, al.t AS alpha_t, count(*) FILTER (al.t > 0) OVER (PARTITION BY split_part(p1.strategy, '|', 1)) AS positive,
    row_number() OVER (PARTITION BY split_part(p1.strategy, '|', 1) ORDER BY round(p1.psr, 9) DESC, p1.strategy) AS place FROM ps1 p1 JOIN ps USING (strategy) JOIN al USING (strategy)),
  rgm AS (SELECT strategy, bool_or(t > 0) AS any_good, bool_or(t < -2 AND n >= 30) AS deep FROM (SELECT al2.*, split_part(label, '|', 1) || '|' || split_part(label, '|', 2) AS strategy FROM al2 WHERE split_part(label, '|', 3) <> 'warmup' AND n >= 20) GROUP BY strategy),
  ch AS (SELECT vr.*, {_FAMILY} AS family, CASE WHEN NOT (alpha_t > {ALPHA_T} AND psr > {PSR_LEAST}) THEN 'D' WHEN positive < 2 THEN 'C' WHEN any_good IS NULL OR (any_good AND NOT deep) THEN 'A' ELSE 'B' END AS stage,
    0.5 * alpha_t + 0.3 * (psr - 0.5) * 4 + 0.2 * (positive / 4.0) * 5 AS score FROM vr LEFT JOIN rgm USING (strategy) WHERE place = 1),
  fm AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY stage, round(score, 9) DESC, name) AS in_family FROM ch)
  SELECT name, strategy AS variant, family, stage, {r('score')} AS score FROM fm WHERE in_family <= {PER_FAMILY} ORDER BY stage, round(fm.score, 9) DESC, name LIMIT {PICKS}""")  # fmt: skip
def b30_selection_funnel(spark, sf_dir):
    """Variants of each factor chosen on the train split, filtered by significance, stability over variants and regimes, and picked by tier with two of a family at most."""
    books = {f"{n}|{t}": (n, t) for n in WEEKLY for t in TOPS}
    days = cuts.book_days(many_factors(spark, sf_dir), books, ["date"]).withColumn("split", split_of(F.col("k"), F.col("size")))
    test = staged(days.where("split = 'test'").join(regimes(spark, sf_dir).select("date", "bench", "regime"), "date"))
    name = F.split_part(F.col("strategy"), F.lit("|"), F.lit(1))
    train_psr = probable_sharpe(days.where("split = 'train'"), ["strategy"], TRIALS).select("strategy", F.col("psr").alias("train_psr"))
    psr = probable_sharpe(test, ["strategy"], TRIALS).select("strategy", "psr")
    v = train_psr.join(psr, "strategy").join(alpha_beta(test, ["strategy"], 30).select("strategy", F.col("t").alias("alpha_t")), "strategy").withColumn("name", name)
    v = v.withColumn("positive", F.count_if(F.col("alpha_t") > 0).over(Window.partitionBy("name"))).withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(F.round("train_psr", 9).desc(), "strategy")))
    by_regime = alpha_beta(test.where("regime <> 'warmup'"), ["strategy", "regime"], 20).where("n >= 20")
    good = by_regime.groupBy("strategy").agg(F.bool_or(F.col("t") > 0).alias("any_good"), F.bool_or((F.col("t") < -2) & (F.col("n") >= 30)).alias("deep"))
    stage = F.when(~((F.col("alpha_t") > ALPHA_T) & (F.col("psr") > PSR_LEAST)), "D").when(F.col("positive") < 2, "C").when(F.col("any_good").isNull() | (F.col("any_good") & ~F.col("deep")), "A").otherwise("B")
    score = 0.5 * F.col("alpha_t") + 0.3 * (F.col("psr") - 0.5) * 4 + 0.2 * (F.col("positive") / 4.0) * 5
    ch = v.where("place = 1").join(good, "strategy", "left").withColumn("family", F.expr(_FAMILY)).withColumn("stage", stage).withColumn("score", score)
    order = ["stage", F.round("score", 9).desc(), "name"]
    ch = ch.withColumn("in_family", F.row_number().over(Window.partitionBy("family").orderBy(*order))).where(F.col("in_family") <= PER_FAMILY)
    return ch.orderBy(*order).limit(PICKS).select("name", F.col("strategy").alias("variant"), "family", "stage", rounded(F.col("score")).alias("score"))
