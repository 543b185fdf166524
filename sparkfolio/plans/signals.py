"""Queries of signals: per-ticker scores from bars, flows, option chains, analysts, news and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.functions.staging import staged
from sparkfolio.operators import backtest as b
from sparkfolio.operators import options
from sparkfolio.operators import technical as t
from sparkfolio.plans.backtests import CORR
from sparkfolio.plans.common import query, rounded
from sparkfolio.plans.common import sql_rounded as r
from sparkfolio.plans.factors import WT
from sparkfolio.sources.chains import CHAIN_SQL, nearest_expiry, option_chain
from sparkfolio.sources.market import table
from sparkfolio.sources.tables import BARS_SQL, FILINGS_SQL, bars_weekly, filings

# -- SQL forms ------------------------------------------------------------------------------------------------------


def _w(n: int) -> str:
    return f"OVER ({WT} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(n: int, x: str, e: str) -> str:
    return f"CASE WHEN count({x}) {_w(n)} = {n} THEN {e} END"


def _ema(x: str, span: int) -> str:
    """The recursive mean of span, unrolled: the first value's weight and those of the others, scaled by the row."""
    a = 2.0 / (span + 1)
    return f"(power({1 - a!r}, k) * sum(CASE WHEN k = 0 THEN {x} ELSE {x} * {a!r} * power({1 - a!r}, -k) END) OVER ({WT} ROWS UNBOUNDED PRECEDING))"


def _clip(e: str) -> str:
    return f"CASE WHEN {e} IS NOT NULL THEN greatest(-3.0, least(3.0, {e})) END"


INDICATORS = f"""{BARS_SQL}, i0 AS (SELECT *, row_number() OVER ({WT}) - 1 AS k, close - lag(close) OVER ({WT}) AS d, lag(close) OVER ({WT}) AS before FROM wbars),
  i1 AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS down, greatest(high - low, coalesce(abs(high - before), 0), coalesce(abs(low - before), 0)) AS tr,
    {_ema('close', 8)} AS ema8, {_ema('close', 12)} AS ema12, {_ema('close', 21)} AS ema21, {_ema('close', 26)} AS ema26 FROM i0),
  i2 AS (SELECT *, {_full(14, 'up', f'avg(up) {_w(14)}')} AS gain, {_full(14, 'down', f'avg(down) {_w(14)}')} AS loss, ema12 - ema26 AS macd FROM i1),
  i3 AS (SELECT *, 100 - 100 / (1 + gain / nullif(loss, 0)) AS rsi, macd - {_ema('macd', 9)} AS hist, {_full(14, 'tr', f'avg(tr) {_w(14)}')} AS atr FROM i2)"""


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars with rsi, atr, the recursive means and the MACD histogram."""
    df = t.true_range_mean(t.rsi(bars_weekly(spark, sf_dir), "rsi"), "atr")
    return t.recursive_means(df, "close", {"ema8": 8, "ema12": 12, "ema21": 21, "ema26": 26}, ("hist", "ema12", "ema26", 9))


@query("s1_technicals", f"""WITH {INDICATORS}, i4 AS (SELECT *, close / nullif({_full(50, 'close', f'avg(close) {_w(50)}')}, 0) - 1 AS d50, close / nullif({_full(200, 'close', f'avg(close) {_w(200)}')}, 0) - 1 AS d200,
    stddev_samp(close) OVER (PARTITION BY ticker) AS sd, count(*) OVER (PARTITION BY ticker) AS n, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM i3),
  z AS (SELECT ticker, date, n, ((coalesce(rsi, 50) - 50) / 20 + tanh(hist / greatest(sd, 1e-6)) - tanh(atr / close * 50) + tanh(d50 * 10) + tanh(d200 * 10)) / 5 AS z FROM i4 WHERE age = 1)
  SELECT ticker, date, n, CASE WHEN n < 60 THEN 0 ELSE {r(_clip('z'))} END AS z, CASE WHEN n < 60 THEN CAST(0.3 AS DOUBLE) ELSE 0.85 END AS confidence FROM z""")  # fmt: skip
def s1_technicals(spark, sf_dir):
    """Strength, trend, range and distances to two means, mixed to one score at each ticker's last bar."""
    df = indicators(spark, sf_dir)
    distance = lambda n: F.col("close") / t.when_full(n, "close", F.avg("close").over(t.last(n))) - 1
    all_rows = Window.partitionBy("ticker")
    df = df.withColumn("d50", distance(50)).withColumn("d200", distance(200)).withColumn("sd", F.stddev_samp("close").over(all_rows)).withColumn("n", F.count("*").over(all_rows))
    latest = df.withColumn("age", F.row_number().over(all_rows.orderBy(F.desc("date")))).where("age = 1")
    parts = [(F.coalesce("rsi", F.lit(50.0)) - 50) / 20, F.tanh(F.col("hist") / F.greatest("sd", F.lit(1e-6))), -F.tanh(F.col("atr") / F.col("close") * 50), F.tanh(F.col("d50") * 10), F.tanh(F.col("d200") * 10)]
    z = t.clipped(sum(parts[1:], parts[0]) / 5)
    short = F.col("n") < 60
    return latest.select("ticker", "date", "n", F.when(short, 0.0).otherwise(rounded(z)).alias("z"), F.when(short, 0.3).otherwise(0.85).alias("confidence"))


def _slope_sql(m: int, n: int = 18) -> str:
    return f"""sl AS (SELECT *, {_full(n, 'low', f'CASE WHEN var_samp(low) {_w(n)} > 1e-12 THEN covar_samp(high, low) {_w(n)} / var_samp(low) {_w(n)} END')} AS slope FROM wbars),
  sz{m} AS (SELECT *, {_full(m, 'slope', f'CASE WHEN stddev_samp(slope) {_w(m)} > 1e-12 THEN (slope - avg(slope) {_w(m)}) / stddev_samp(slope) {_w(m)} END')} AS rz FROM sl)"""


@query("s2_rsrs", f"""WITH {BARS_SQL}, {_slope_sql(126)} SELECT ticker, date, {r('slope')} AS slope, {r(_clip('rz'))} AS z, CASE WHEN rz IS NULL THEN 0.0::DOUBLE ELSE 0.7 END AS confidence FROM sz126""")
def s2_rsrs(spark, sf_dir):
    """Slope of high on low over 18 bars, scored against its last 126 values."""
    df = t.slope_z(bars_weekly(spark, sf_dir))
    return df.select("ticker", "date", rounded(F.col("slope")).alias("slope"), rounded(t.clipped(F.col("rz"))).alias("z"), F.when(F.col("rz").isNull(), 0.0).otherwise(0.7).alias("confidence"))


_GRID = [(m, h) for m in (126, 252) for h in (5, 20)]


@query("s3_rsrs_grid", f"""WITH {BARS_SQL}, {_slope_sql(126)}, {_slope_sql(252).split('),' + chr(10), 1)[1]}, fw AS (SELECT ticker, date, {", ".join(f"lead(close, {h}) OVER ({WT}) / nullif(close, 0) - 1 AS f{h}" for h in (5, 20))} FROM wbars),
  g AS ({" UNION ALL ".join(f"SELECT {m} AS m, {h} AS horizon, date, ticker, round(rz, 9) AS z, f{h} AS fwd FROM sz{m} JOIN fw USING (ticker, date) WHERE rz IS NOT NULL AND f{h} IS NOT NULL" for m, h in _GRID)}),
  k AS (SELECT *, rank() OVER (PARTITION BY m, horizon, date ORDER BY z) + (count(*) OVER (PARTITION BY m, horizon, date, z) - 1) / 2.0 AS a, rank() OVER (PARTITION BY m, horizon, date ORDER BY fwd) + (count(*) OVER (PARTITION BY m, horizon, date, fwd) - 1) / 2.0 AS f FROM g),
  c AS (SELECT m, horizon, date, {CORR.format(x='a', y='f')} AS ic FROM k GROUP BY ALL HAVING count(*) >= 8)
  SELECT m, horizon, {r('avg(ic)')} AS mean_ic, {r('CASE WHEN stddev_samp(ic) > 1e-12 THEN avg(ic) / stddev_samp(ic) END')} AS ir, {r('avg(CASE WHEN round(ic, 12) > 0 THEN 1.0 ELSE 0 END)')} AS positive, count(ic) AS dates FROM c WHERE ic IS NOT NULL GROUP BY m, horizon""")  # fmt: skip
def s3_rsrs_grid(spark, sf_dir):
    """The slope score's daily rank IC for two windows and two horizons; dates of fewer than eight names do not count."""
    bars = bars_weekly(spark, sf_dir).select("ticker", "date", "high", "low", "close")
    wide = t.slope_z(bars, m=126).withColumnRenamed("rz", "z126")
    wide = t.slope_z(wide, m=252).withColumnRenamed("rz", "z252").withColumn("f5", b.forward_return(5)).withColumn("f20", b.forward_return(20))
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(h).alias("horizon"), F.round(f"z{m}", 9).alias("z"), F.col(f"f{h}").alias("fwd")) for m, h in _GRID]))
    g = wide.select("date", "ticker", cells.alias("c")).select("date", "ticker", "c.*").where("z is not null and fwd is not null")
    at = Window.partitionBy("m", "horizon", "date")
    rank = lambda x: F.rank().over(at.orderBy(x)) + (F.count("*").over(Window.partitionBy("m", "horizon", "date", x)) - 1) / 2
    ic = g.withColumn("a", rank("z")).withColumn("f", rank("fwd")).groupBy("m", "horizon", "date").agg(b.correlation(F.col("a"), F.col("f")).alias("ic"), F.count("*").alias("n")).where("n >= 8 and ic is not null")
    spread = F.stddev_samp("ic")
    return ic.groupBy("m", "horizon").agg(rounded(F.avg("ic")).alias("mean_ic"), rounded(F.when(spread > 1e-12, F.avg("ic") / spread)).alias("ir"), rounded(F.avg((F.round("ic", 12) > 0).cast("double"))).alias("positive"), F.count("*").alias("dates"))


# -- flows, options, analysts ---------------------------------------------------------------------------------------


@query("s5_insider", f"""WITH {FILINGS_SQL}, m AS (SELECT max(filing_date) AS d FROM filings), f AS (SELECT ticker, filing_id, sum(CASE WHEN filing_id % 2 = 0 THEN amount ELSE -amount END) AS net FROM filings, m WHERE filing_date > d - INTERVAL 30 DAY GROUP BY ALL),
  n AS (SELECT ticker, sum(net) AS net, count(*) FILTER (net <> 0) AS n FROM f GROUP BY ticker), t AS (SELECT DISTINCT ticker FROM filings)
  SELECT ticker, {r('CASE WHEN n > 0 THEN tanh(net / 1000000) END')} AS z, CASE WHEN coalesce(n, 0) = 0 THEN 0.0::DOUBLE ELSE 0.7 END AS confidence FROM t LEFT JOIN n USING (ticker)""")  # fmt: skip
def s5_insider(spark, sf_dir):
    """Net value of the last 30 days' filings; a ticker without any has no score, not a neutral one."""
    from sparkfolio.plans.extra import io7_net_value_30_days

    tickers = filings(spark, sf_dir).select("ticker").distinct()
    n = tickers.join(io7_net_value_30_days(spark, sf_dir), "ticker", "left")
    return n.select("ticker", rounded(F.when(F.col("n") > 0, F.tanh(F.col("net") / 1_000_000))).alias("z"), F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).otherwise(0.7).alias("confidence"))


@query("s6_put_call", f"""WITH {CHAIN_SQL}, c AS (SELECT ticker, coalesce(sum(volume) FILTER (kind = 'put'), 0) AS puts, coalesce(sum(volume) FILTER (kind = 'call'), 0) AS calls, avg(iv) AS iv FROM nearest GROUP BY ALL),
  p AS (SELECT ticker, puts, calls, 100 * percent_rank() OVER (ORDER BY round(iv, 9)) AS iv FROM c)
  SELECT ticker, CASE WHEN puts + calls = 0 THEN 0 ELSE {r(_clip('(-tanh((puts / greatest(calls, 1) - 1) * 1.5) - tanh((iv - 50) / 30)) / 2 * 2'))} END AS z FROM p""")  # fmt: skip
def s6_put_call(spark, sf_dir):
    """Put volume over call volume and the rank of implied volatility at each ticker's nearest expiry."""
    return options.put_call(nearest_expiry(option_chain(spark, sf_dir))).select("ticker", rounded(F.col("z")).alias("z"))


@query("s7_gamma_exposure", f"""WITH {BARS_SQL}, {CHAIN_SQL}, sp AS (SELECT ticker, arg_max(close, date) AS spot FROM wbars GROUP BY ticker),
  g AS (SELECT nearest.*, spot, {options.GAMMA} AS gamma FROM nearest JOIN sp USING (ticker)),
  s AS (SELECT ticker, sum(CASE WHEN kind = 'call' THEN gamma * open_interest ELSE 0 END) AS calls, sum(CASE WHEN kind = 'call' THEN 0 ELSE gamma * open_interest END) AS puts, any_value(spot) AS spot, count(*) AS n_strikes FROM g GROUP BY ticker), x AS (SELECT *, (calls - puts) * 100 * spot * spot AS signed FROM s WHERE calls <> 0 OR puts <> 0)
  SELECT ticker, round(signed, 2) + 0.0 AS signed_notional, CASE WHEN signed > 5e8 THEN 'pinned' WHEN signed < -5e8 THEN 'volatile' ELSE 'mixed' END AS regime, n_strikes FROM x""")  # fmt: skip
def s7_gamma_exposure(spark, sf_dir):
    """Gamma exposure of the nearest expiry in notional of a one-percent move, and the regime it makes."""
    spot = bars_weekly(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "date").alias("spot"))
    x = options.gamma_exposure(nearest_expiry(option_chain(spark, sf_dir)), spot)
    return x.select("ticker", (F.round("signed", 2) + F.lit(0.0)).alias("signed_notional"), "regime", "n_strikes")


#: Recommendation keys of analysts and their scores.
RECOMMENDATIONS = {"strong_buy": 2.0, "buy": 1.0, "hold": 0.0, "underperform": -1.0, "sell": -2.0, "strong_sell": -2.0}
_REC_OF = {"BUILDING": "strong_buy", "AUTOMOBILE": "buy", "MACHINERY": "hold", "HOUSEHOLD": "underperform"}
_REC_Z = "CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN {RECOMMENDATIONS[k]}" for s, k in _REC_OF.items()) + " END"


@query("s8_analyst", f"""WITH o AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS cur, avg(o_totalprice) AS tgt FROM orders GROUP BY ALL), c AS (SELECT c_custkey AS ticker, CAST({_REC_Z} AS DOUBLE) AS rec, cur, tgt FROM customer LEFT JOIN o ON o_custkey = c_custkey)
  SELECT ticker, CASE WHEN rec IS NULL THEN 0 ELSE {r(_clip('(rec / 2 + coalesce(CASE WHEN cur <> 0 AND tgt <> 0 THEN greatest(least((tgt - cur) / cur / 0.20, 1.0), -1.0) END, 0)) / 2 * 2'))} END AS z FROM c""")  # fmt: skip
def s8_analyst(spark, sf_dir):
    """An analyst's key and the upside to the target, which saturates at 20 percent; an unknown key gives nothing."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("cur"), F.avg("o_totalprice").alias("tgt"))
    c = table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("ticker"), F.expr(_REC_Z).cast("double").alias("rec"), "cur", "tgt")
    upside = F.when((F.col("cur") != 0) & (F.col("tgt") != 0), F.greatest(F.least((F.col("tgt") - F.col("cur")) / F.col("cur") / 0.20, F.lit(1.0)), F.lit(-1.0)))
    z = t.clipped((F.col("rec") / 2 + F.coalesce(upside, F.lit(0.0))) / 2 * 2)
    return c.select("ticker", F.when(F.col("rec").isNull(), 0.0).otherwise(rounded(z)).alias("z"))


@query("s8_premarket_gap", f"WITH {INDICATORS}, p AS (SELECT ticker, date, open, before, lag(atr) OVER ({WT}) AS range FROM i3) SELECT ticker, date, CASE WHEN open <> 0 AND before <> 0 AND range <> 0 THEN {r(_clip('(open - before) / nullif(range, 0)'))} ELSE 0 END AS z FROM p")
def s8_premarket_gap(spark, sf_dir):
    """The gap from the close before to the open, in mean true ranges."""
    df = t.true_range_mean(bars_weekly(spark, sf_dir), "atr")
    df = df.withColumn("before", F.lag("close").over(t.own())).withColumn("range", F.lag("atr").over(t.own()))
    known = (F.col("open") != 0) & (F.col("before") != 0) & (F.col("range") != 0)
    return df.select("ticker", "date", F.when(known, rounded(t.clipped((F.col("open") - F.col("before")) / F.col("range")))).otherwise(0.0).alias("z"))


@query("s8_macro", f"""WITH m AS (SELECT CAST(ts AS DATE) AS date, avg(value) / 10 AS dgs10, avg(value) FILTER (event_type = 'click') / 10 AS dgs2, 80 + avg(value) FILTER (event_type = 'view') / 2 AS dxy, avg(value) FILTER (event_type <> 'view') / 3 AS vix FROM events GROUP BY ALL)
  SELECT date, {r(_clip('(tanh((dgs10 - dgs2) * 5) - tanh((dxy - 100) / 5) - tanh((vix - 16) / 8)) / 3'))} AS z FROM m""")  # fmt: skip
def s8_macro(spark, sf_dir):
    """Slope of rates, strength of the currency and volatility, each bent by tanh and averaged."""
    of = lambda c: F.avg(F.when(c, F.col("value")))
    kind = F.col("event_type")
    m = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg((F.avg("value") / 10).alias("dgs10"), (of(kind == "click") / 10).alias("dgs2"), (80 + of(kind == "view") / 2).alias("dxy"), (of(kind != "view") / 3).alias("vix"))
    z = (F.tanh((F.col("dgs10") - F.col("dgs2")) * 5) - F.tanh((F.col("dxy") - 100) / 5) - F.tanh((F.col("vix") - 16) / 8)) / 3
    return m.select("date", rounded(t.clipped(z)).alias("z"))


#: Weights of the supply-chain scorecard's factors, and its penalties.
CARD = {"demand_inflection": 15, "architecture_coupling": 10, "chokepoint_severity": 15, "supplier_concentration": 12, "expansion_difficulty": 12, "evidence_quality": 15, "valuation_disconnect": 11, "catalyst_timing": 10}
PENALTIES = ["dilution_financing", "governance", "geopolitics", "liquidity", "hype_risk", "accounting_quality", "cyclicality", "alternative_design_risk"]
_RATING = "CAST((p_partkey * {i} + p_size) % 13 AS DOUBLE) / 2"  # 0 to 6: ratings over 5 are errors
_PENALTY = "CAST((p_partkey + {i} * p_size) % 7 AS DOUBLE) / 4"
_CARD_TOTAL = " + ".join(f"{_RATING.format(i=i)} / 5.0 * {wt}" for i, wt in enumerate(CARD.values(), 3))
_CARD_BAD = " OR ".join([f"{_RATING.format(i=i)} > 5" for i, _ in enumerate(CARD, 3)])


@query("s9_supply_chain_card", f"""WITH c AS (SELECT p_partkey AS ticker, {_CARD_TOTAL} AS points, ({" + ".join(_PENALTY.format(i=i) for i, _ in enumerate(PENALTIES, 2))}) * 2.0 AS penalty, {_CARD_BAD} AS bad FROM part), s AS (SELECT *, CASE WHEN NOT bad THEN greatest(0.0, least(100.0, points - penalty)) END AS score FROM c)
  SELECT ticker, round(score, 2) AS score, CASE WHEN score >= 85 THEN 'Top research priority' WHEN score >= 70 THEN 'High research priority' WHEN score >= 55 THEN 'Worth tracking' WHEN score IS NOT NULL THEN 'Early lead or low priority' END AS verdict, {r(_clip('(score - 50.0) / (50.0 / 3.0)'))} AS z, bad AS error FROM s""")  # fmt: skip
def s9_supply_chain_card(spark, sf_dir):
    """Weighted ratings less twice the penalties, from maps of ratings; a rating outside 0 to 5 is an error."""
    pairs = lambda names, form, first: F.map_from_entries(F.array(*[F.struct(F.lit(n), F.expr(form.format(i=i))) for i, n in enumerate(names, first)]))
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticker"), pairs(CARD, _RATING, 3).alias("factors"), pairs(PENALTIES, _PENALTY, 2).alias("penalties"))
    weights = F.create_map(*[x for n, wt in CARD.items() for x in (F.lit(n), F.lit(float(wt)))])
    points = F.aggregate(F.map_entries("factors"), F.lit(0.0), lambda acc, e: acc + F.coalesce(e["value"], F.lit(0.0)) / 5.0 * F.element_at(weights, e["key"]))
    penalty = F.aggregate(F.map_values("penalties"), F.lit(0.0), lambda acc, x: acc + x) * 2.0
    bad = F.exists(F.concat(F.map_values("factors"), F.map_values("penalties")), lambda x: (x < 0) | (x > 5))
    s = c.select("ticker", bad.alias("error"), F.when(~bad, F.greatest(F.lit(0.0), F.least(F.lit(100.0), points - penalty))).alias("score"))
    verdict = F.when(F.col("score") >= 85, "Top research priority").when(F.col("score") >= 70, "High research priority").when(F.col("score") >= 55, "Worth tracking").when(F.col("score").isNotNull(), "Early lead or low priority")
    return s.select("ticker", F.round("score", 2).alias("score"), verdict.alias("verdict"), rounded(t.clipped((F.col("score") - 50.0) / (50.0 / 3.0))).alias("z"), "error")


# -- features, models, gates ----------------------------------------------------------------------------------------

FEATURES = ["log_return", "volatility_20d", "rsi_14", "macd", "bollinger_pctb", "momentum_10d", "momentum_20d", "momentum_60d", "mean_reversion_score", "volume_anomaly"]
_M20, _S20 = f"avg(close) {_w(20)}", f"stddev_samp(close) {_w(20)}"
FEATURE_SQL = f"""{INDICATORS}, f0 AS (SELECT *, CASE WHEN close > 0 AND before > 0 THEN ln(close / before) END AS log_return FROM i3),
  f1 AS (SELECT ticker, date, log_return, {_full(20, 'log_return', f'stddev_samp(log_return) {_w(20)}')} AS volatility_20d, rsi AS rsi_14, (ema12 - ema26) / nullif(close, 0) AS macd,
    {_full(20, 'close', f'CASE WHEN {_S20} > 1e-12 THEN (close - ({_M20} - 2 * {_S20})) / (4 * {_S20}) END')} AS bollinger_pctb, {", ".join(f"close / nullif(lag(close, {n}) OVER ({WT}), 0) - 1 AS momentum_{n}d" for n in (10, 20, 60))},
    {_full(20, 'close', f'CASE WHEN {_S20} > 1e-12 THEN -(close - {_M20}) / {_S20} END')} AS mean_reversion_score, {_full(20, 'volume', f'CASE WHEN stddev_samp(volume) {_w(20)} > 1e-12 THEN (volume - avg(volume) {_w(20)}) / stddev_samp(volume) {_w(20)} END')} AS volume_anomaly FROM f0),
  feats AS (SELECT * FROM f1 WHERE {" AND ".join(f"{f} IS NOT NULL" for f in FEATURES)})"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten features per weekly bar; bars without the history for all of them are left out."""
    df = t.rsi(bars_weekly(spark, sf_dir), "rsi_14")
    df = t.recursive_means(df, "close", {"ema12": 12, "ema26": 26})
    before, mean, sd = F.lag("close").over(t.own()), F.avg("close").over(t.last(20)), F.stddev_samp("close").over(t.last(20))
    df = df.withColumn("log_return", F.when((F.col("close") > 0) & (before > 0), F.ln(F.col("close") / before))).withColumn("mean", mean).withColumn("sd", sd)
    spread = lambda value: t.when_full(20, "close", F.when(F.col("sd") > 1e-12, value))
    sv = F.stddev_samp("volume").over(t.last(20))
    momentum = [(F.when(F.lag("close", n).over(t.own()) != 0, F.col("close") / F.lag("close", n).over(t.own()) - 1)).alias(f"momentum_{n}d") for n in (10, 20, 60)]
    df = df.select(
        "ticker", "date", "log_return", t.when_full(20, "log_return", F.stddev_samp("log_return").over(t.last(20))).alias("volatility_20d"), "rsi_14", F.when(F.col("close") != 0, (F.col("ema12") - F.col("ema26")) / F.col("close")).alias("macd"),
        spread((F.col("close") - (F.col("mean") - 2 * F.col("sd"))) / (4 * F.col("sd"))).alias("bollinger_pctb"), *momentum,
        spread(-(F.col("close") - F.col("mean")) / F.col("sd")).alias("mean_reversion_score"), t.when_full(20, "volume", F.when(sv > 1e-12, (F.col("volume") - F.avg("volume").over(t.last(20))) / sv)).alias("volume_anomaly"),
    )
    return df.dropna(subset=FEATURES)


@query("s12_features", f"WITH {FEATURE_SQL} SELECT ticker, date, {', '.join(f'{r(f)} AS {f}' for f in FEATURES)} FROM feats")
def s12_features(spark, sf_dir):
    return features(spark, sf_dir).select("ticker", "date", *[rounded(F.col(f)).alias(f) for f in FEATURES])


_FLONG = " UNION ALL ".join(f"SELECT ticker, date, '{f}' AS feature, {f} AS v FROM feats" for f in FEATURES)


@query("s13_feature_statistics", f"""WITH {FEATURE_SQL}, l AS ({_FLONG}), x AS (SELECT *, arg_max(v, date) OVER (PARTITION BY ticker, feature) AS latest FROM l)
  SELECT ticker, feature, {r('any_value(latest)')} AS value, {r('CASE WHEN stddev_samp(v) > 0 THEN (any_value(latest) - avg(v)) / stddev_samp(v) ELSE 0 END')} AS z, {r('CASE WHEN count(*) < 2 THEN 0.5 ELSE (count(*) FILTER (v < latest) + count(*) FILTER (v <= latest) + CASE WHEN count(*) FILTER (v = latest) > 0 THEN 1 ELSE 0 END) * 0.5 / count(*) END')} AS percentile,
    {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS std, {r('min(v)')} AS low, {r('max(v)')} AS high FROM x GROUP BY ticker, feature""")  # fmt: skip
def s13_feature_statistics(spark, sf_dir):
    """Each feature's latest value beside its own history: score, percentile, mean, spread and range."""
    l = staged(features(spark, sf_dir)).unpivot(["ticker", "date"], FEATURES, "feature", "v")
    latest = l.groupBy("ticker", "feature").agg(F.max_by("v", "date").alias("latest"))
    x = l.join(latest, ["ticker", "feature"])
    v, now, sd = F.col("v"), F.col("latest"), F.stddev_samp("v")
    below, upto = F.count_if(v < now), F.count_if(v <= now)
    percentile = F.when(F.count("*") < 2, 0.5).otherwise((below + upto + F.when(upto > below, 1).otherwise(0)) * 0.5 / F.count("*"))
    return x.groupBy("ticker", "feature").agg(
        rounded(F.first("latest")).alias("value"), rounded(F.coalesce(F.when(sd > 0, (F.first("latest") - F.avg("v")) / sd), F.lit(0.0))).alias("z"), rounded(percentile).alias("percentile"),
        rounded(F.avg("v")).alias("mean"), rounded(sd).alias("std"), rounded(F.min("v")).alias("low"), rounded(F.max("v")).alias("high"),
    )


#: Weights of the models that are blended.
MODELS = {"XGBoost": 0.45, "LSTM": 0.35, "HMM": 0.20}
_BULL = {"XGBoost": "1 / (1 + exp(-20 * log_return))", "LSTM": "rsi_14 / 100", "HMM": "CASE WHEN momentum_20d > 0 THEN 0.7 ELSE 0.3 END"}


@query("s15_model_blend", f"""WITH {FEATURE_SQL}, p AS ({" UNION ALL ".join(f"SELECT ticker, date, {MODELS[m]} AS w, {e} AS bull FROM feats" for m, e in _BULL.items())}), f AS (SELECT ticker, date, sum(bull * w) / CASE WHEN sum(w) = 0 THEN 1 ELSE sum(w) END AS bull FROM p GROUP BY ALL)
  SELECT ticker, date, {r('bull')} AS bull, CASE WHEN round(bull, 9) > 0.5 THEN 'Bullish' ELSE 'Bearish' END AS direction, {r('abs(bull - 0.5) * 2')} AS confidence FROM f""")  # fmt: skip
def s15_model_blend(spark, sf_dir):
    """Weighted mean of the models' bull probabilities, its direction and how far it is from even."""
    models = F.array(*[F.struct(F.lit(MODELS[m]).alias("w"), F.expr(e).cast("double").alias("bull")) for m, e in _BULL.items()])
    p = features(spark, sf_dir).select("ticker", "date", F.explode(models).alias("m")).select("ticker", "date", "m.*")
    total = F.sum("w")
    f = p.groupBy("ticker", "date").agg((F.sum(F.col("bull") * F.col("w")) / F.when(total == 0, 1.0).otherwise(total)).alias("b"))
    return f.select("ticker", "date", rounded(F.col("b")).alias("bull"), F.when(F.round("b", 9) > 0.5, "Bullish").otherwise("Bearish").alias("direction"), rounded(F.abs(F.col("b") - 0.5) * 2).alias("confidence"))


_UNIT = lambda e: f"greatest(0.0, least(1.0, {e}))"


@query("s16_timeframe_gate", f"""WITH {INDICATORS}, l AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM i3),
  s AS (SELECT ticker, CASE WHEN n < 21 THEN 0.5 ELSE {_UNIT('0.5 + (ema8 - ema21) / close * 10')} END AS trend, CASE WHEN n < 15 THEN 0.5 ELSE {_UNIT('((100 - 100 / (1 + gain / greatest(loss, 1e-10))) - 30) / 40')} END AS momentum, CASE WHEN n < 26 THEN 0.5 ELSE {_UNIT('0.5 + hist / close * 50')} END AS entry FROM l WHERE age = 1)
  SELECT ticker, {r('trend')} AS trend, {r('momentum')} AS momentum, {r('entry')} AS entry, {r('0.4 * trend + 0.35 * momentum + 0.25 * entry')} AS overall, trend >= 0.5 AND momentum >= 0.5 AND entry >= 0.5 AS passed FROM s""")  # fmt: skip
def s16_timeframe_gate(spark, sf_dir):
    """Trend, momentum and entry gates at each ticker's last bar; all three must reach one half."""
    df = bars_weekly(spark, sf_dir).withColumn("d", F.col("close") - F.lag("close").over(t.own()))
    df = t.recursive_means(df, "close", {"ema8": 8, "ema12": 12, "ema21": 21, "ema26": 26}, ("hist", "ema12", "ema26", 9))
    df = df.withColumn("gain", F.avg(F.greatest("d", F.lit(0.0))).over(t.last(14))).withColumn("loss", F.avg(F.greatest(-F.col("d"), F.lit(0.0))).over(t.last(14)))
    n = F.count("*").over(Window.partitionBy("ticker"))
    l = df.withColumn("n", n).withColumn("age", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where("age = 1")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    rsi = 100 - 100 / (1 + F.col("gain") / F.greatest("loss", F.lit(1e-10)))
    s = l.select(
        "ticker", F.when(F.col("n") < 21, 0.5).otherwise(unit(0.5 + (F.col("ema8") - F.col("ema21")) / F.col("close") * 10)).alias("trend"),
        F.when(F.col("n") < 15, 0.5).otherwise(unit((rsi - 30) / 40)).alias("momentum"), F.when(F.col("n") < 26, 0.5).otherwise(unit(0.5 + F.col("hist") / F.col("close") * 50)).alias("entry"),
    )
    overall = 0.4 * F.col("trend") + 0.35 * F.col("momentum") + 0.25 * F.col("entry")
    passed = (F.col("trend") >= 0.5) & (F.col("momentum") >= 0.5) & (F.col("entry") >= 0.5)
    return s.select("ticker", *[rounded(F.col(c)).alias(c) for c in ("trend", "momentum", "entry")], rounded(overall).alias("overall"), passed.alias("passed"))
