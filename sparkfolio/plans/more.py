"""Further queries: risk figures, signals from bars, hysteresis, calibration, books, mined expressions, streams."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkfolio.functions import normal
from sparkfolio.operators import backtest as b
from sparkfolio.plans.backtests import BOOK, CORR, ORDINAL, RETURNS, factor_frame
from sparkfolio.plans.common import query, rounded
from sparkfolio.plans.common import sql_rounded as r
from sparkfolio.plans.factors import LIBRARY, WT
from sparkfolio.plans.research import AHEAD, FUSED, SIG, TIER, fused, signals, tier
from sparkfolio.sources.feeds import HASH_SQL, NEWS_SQL
from sparkfolio.sources.market import PANEL_SQL, PRICES_SQL, panel, prices_daily, table
from sparkfolio.sources.tables import FILINGS_SQL, WEEKLY_SQL, filings, prices_weekly
from sparkfolio.streaming import jobs

# -- backtest ------------------------------------------------------------------------------------------------------


@query("b13_ic_significance", f"""WITH {ORDINAL}, s AS (SELECT avg(ic) AS mean, stddev_samp(ic) AS std, count(*) AS n FROM ic), q AS (SELECT *, CASE WHEN std > 1e-12 THEN mean / std * sqrt(n) END AS t FROM s)
  SELECT {r('mean')} AS mean, {r('t')} AS t, {r(normal.sql_two_sided('q.t'))} AS p, n FROM q""")  # fmt: skip
def b13_ic_significance(spark, sf_dir):
    """Mean, t value and two-sided p value of the daily rank IC."""
    ic = b.ordinal_ic(factor_frame(spark, sf_dir))
    s = ic.agg(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("std"), F.count("*").alias("n")).withColumn("t0", F.when(F.col("std") > 1e-12, F.col("m") / F.col("std") * F.sqrt("n")))
    return s.select(rounded(F.col("m")).alias("mean"), rounded(F.col("t0")).alias("t"), rounded(normal.two_sided(F.col("t0"))).alias("p"), "n")


@query("b14_walk_forward_windows", f"""WITH {ORDINAL}, i AS (SELECT date, ic, row_number() OVER (ORDER BY date) - 1 AS k FROM ic), g AS (SELECT unnest(range(0, 100, 5)) AS start)
  SELECT g.start, {r('avg(ic)')} AS mean_ic, count(*) AS n FROM g JOIN i ON i.k >= g.start AND i.k < g.start + 10 GROUP BY g.start HAVING count(*) = 10""")  # fmt: skip
def b14_walk_forward_windows(spark, sf_dir):
    """Windows of ten dates, five apart: each date names the windows it is in, so dates meet windows without a range join."""
    i = b.ordinal_ic(factor_frame(spark, sf_dir)).withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)
    starts = F.explode(F.filter(F.array(F.floor(F.col("k") / 5) * 5, F.floor(F.col("k") / 5) * 5 - 5), lambda s: s >= 0))
    return i.withColumn("start", starts).groupBy("start").agg(rounded(F.avg("ic")).alias("mean_ic"), F.count("*").alias("n")).where("n = 10")


@query("b18_alpha_beta", f"""WITH {RETURNS}, m AS (SELECT date, avg(close) AS level FROM panel GROUP BY date), mk AS (SELECT date, level / lag(level) OVER (ORDER BY date) - 1 AS mret FROM m),
  j AS (SELECT gross - cost AS y, mret AS x FROM ret JOIN mk USING (date) WHERE gross IS NOT NULL AND mret IS NOT NULL)
  SELECT {r('regr_slope(y, x)')} AS beta, {r('regr_intercept(y, x)')} AS alpha, {r('regr_r2(y, x)')} AS r2, count(*) AS n FROM j""")  # fmt: skip
def b18_alpha_beta(spark, sf_dir):
    market = panel(spark, sf_dir).groupBy("date").agg(F.avg("close").alias("level"))
    x = (F.col("level") / F.lag("level").over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).alias("x")
    j = b.book_returns(b.book(factor_frame(spark, sf_dir))).select("date", F.col("net").alias("y")).join(market.select("date", x), "date").where("y is not null and x is not null")
    return j.agg(rounded(F.regr_slope("y", "x")).alias("beta"), rounded(F.regr_intercept("y", "x")).alias("alpha"), rounded(F.regr_r2("y", "x")).alias("r2"), F.count("*").alias("n"))


@query("b20_daily_baskets", f"""WITH {BOOK} SELECT date, string_agg(CAST(ticker AS VARCHAR), ',' ORDER BY ticker) FILTER (weight > 0) AS longs, string_agg(CAST(ticker AS VARCHAR), ',' ORDER BY ticker) FILTER (weight < 0) AS shorts FROM bk GROUP BY date""")
def b20_daily_baskets(spark, sf_dir):
    names = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.col("ticker")))), lambda t: t.cast("string")), ",")
    bk = b.book(factor_frame(spark, sf_dir)).groupBy("date").agg(names(F.col("weight") > 0).alias("longs"), names(F.col("weight") < 0).alias("shorts"))
    return bk.select("date", *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("longs", "shorts")])


# -- signals -------------------------------------------------------------------------------------------------------


@query("s2_rsrs_slope", f"""WITH {PRICES_SQL}, s AS (SELECT ticker, date, CASE WHEN count(*) OVER w = 8 AND var_pop(low) OVER w > 1e-12 THEN covar_pop(high, low) OVER w / var_pop(low) OVER w END AS slope
    FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
  SELECT ticker, date, {r('slope')} AS slope FROM s""")  # fmt: skip
def s2_rsrs_slope(spark, sf_dir):
    w = b.own().rowsBetween(-7, 0)
    spread = F.var_pop("low").over(w)
    slope = F.when((F.count("*").over(w) == 8) & (spread > 1e-12), F.covar_pop("high", "low").over(w) / spread)
    return prices_daily(spark, sf_dir).select("ticker", "date", rounded(slope).alias("slope"))


@query("s4_earnings_surprise", f"""WITH {FILINGS_SQL}, s AS (SELECT ticker, filing_id, filing_date, amount, avg(amount) OVER (PARTITION BY ticker ORDER BY filing_date, filing_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS expected FROM filings),
  u AS (SELECT *, (amount - expected) / nullif(expected, 0) AS surprise FROM s), g AS (SELECT ticker, CASE WHEN count(surprise) >= 4 THEN greatest(stddev_pop(surprise), 0.05) ELSE 0.2 END AS sigma, max(filing_date) AS last_date FROM u GROUP BY ticker)
  SELECT u.ticker, u.filing_id, {r("greatest(-3.0, least(3.0, surprise / sigma)) * exp(-date_diff('day', filing_date, last_date) / 14.0)")} AS z FROM u JOIN g USING (ticker) WHERE surprise IS NOT NULL""")  # fmt: skip
def s4_earnings_surprise(spark, sf_dir):
    before = Window.partitionBy("ticker").orderBy("filing_date", "filing_id").rowsBetween(-4, -1)
    u = filings(spark, sf_dir).withColumn("expected", F.avg("amount").over(before)).withColumn("surprise", F.when(F.col("expected") != 0, (F.col("amount") - F.col("expected")) / F.col("expected")))
    g = u.groupBy("ticker").agg(F.when(F.count("surprise") >= 4, F.greatest(F.stddev_pop("surprise"), F.lit(0.05))).otherwise(0.2).alias("sigma"), F.max("filing_date").alias("last_date"))
    z = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col("surprise") / F.col("sigma"))) * F.exp(-F.datediff("last_date", "filing_date") / 14.0)
    return u.join(g, "ticker").where("surprise is not null").select("ticker", "filing_id", rounded(z).alias("z"))


@query("s5_s6_flow_signals", f"""SELECT user_id AS ticker, {r("tanh(sum(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN value ELSE -value END) / 1000)")} AS z FROM events GROUP BY user_id""")
def s5_s6_flow_signals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("first_type"))
    signed = F.when(F.col("event_type") == F.col("first_type"), F.col("value")).otherwise(-F.col("value"))
    return e.join(F.broadcast(first)).groupBy(F.col("user_id").alias("ticker")).agg(rounded(F.tanh(F.sum(signed) / 1000)).alias("z"))  # one row


@query("s12_feature_table", f"""WITH {PRICES_SQL}, f AS (SELECT ticker, date, close, lag(close, 1) OVER w AS p1, lag(close, 5) OVER w AS p5, count(close) OVER w5 AS n5, avg(close) OVER w5 AS ma5, stddev_samp(close) OVER w5 AS sd5, avg(volume) OVER w5 AS vm FROM prices
    WINDOW w AS (PARTITION BY ticker ORDER BY date), w5 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
  SELECT ticker, date, {r('CASE WHEN close > 0 AND p1 > 0 THEN ln(close / p1) END')} AS log_return, {r('close / nullif(p5, 0) - 1')} AS momentum_5, {r('CASE WHEN n5 = 5 AND sd5 > 1e-12 THEN (close - ma5 + 2 * sd5) / (4 * sd5) END')} AS bollinger_b FROM f""")  # fmt: skip
def s12_feature_table(spark, sf_dir):
    w5 = b.own().rowsBetween(-4, 0)
    f = prices_daily(spark, sf_dir).select("ticker", "date", "close", F.lag("close").over(b.own()).alias("p1"), F.lag("close", 5).over(b.own()).alias("p5"), F.count("close").over(w5).alias("n5"), F.avg("close").over(w5).alias("ma5"), F.stddev_samp("close").over(w5).alias("sd5"))
    return f.select(
        "ticker", "date",
        rounded(F.when((F.col("close") > 0) & (F.col("p1") > 0), F.ln(F.col("close") / F.col("p1")))).alias("log_return"),
        rounded(F.when(F.col("p5") != 0, F.col("close") / F.col("p5") - 1)).alias("momentum_5"),
        rounded(F.when((F.col("n5") == 5) & (F.col("sd5") > 1e-12), (F.col("close") - F.col("ma5") + 2 * F.col("sd5")) / (4 * F.col("sd5")))).alias("bollinger_b"),
    )


@query("s14_direction_label", f"WITH {PRICES_SQL} SELECT ticker, date, lead(close, 5) OVER ({WT}) / nullif(close, 0) - 1 > 0 AS up FROM prices")
def s14_direction_label(spark, sf_dir):
    return prices_daily(spark, sf_dir).select("ticker", "date", (b.forward_return(5) > 0).alias("up"))


# -- fusion and validation -----------------------------------------------------------------------------------------


#: The tiers' ranges by (low, high), infinite at the ends.
TIER_RANGE = {"BUY": (1.5, math.inf), "OW": (0.5, 1.5), "HOLD": (-0.5, 0.5), "UW": (-1.5, -0.5), "SELL": (-math.inf, -1.5)}
BAND = 0.15


def tier_of(x: float | None) -> str:
    """A score's tier without memory, on one value (``research.tier`` is the same on columns)."""
    if x is None or x != x:
        return "HOLD"
    return next((t for t in ("BUY", "OW") if x > TIER_RANGE[t][0]), None) or next((t for t in ("HOLD", "UW") if x >= TIER_RANGE[t][0]), "SELL")


def held_tiers(scores, band: float = BAND, held: str | None = None) -> list[str]:
    """Tiers of a ticker's scores in order: one is held while the score stays in its range, widened by the band on both sides."""
    out = []
    for x in scores:
        now = tier_of(x)
        if held is not None and held != now and x is not None and TIER_RANGE[held][0] - band <= x <= TIER_RANGE[held][1] + band:
            now = held
        held = now
        out.append(now)
    return out


_BOUND = lambda end: "CASE h.tier " + " ".join(f"WHEN '{t}' THEN {'-1e300' if lo == -math.inf else lo - BAND}" if end == 0 else f"WHEN '{t}' THEN {'1e300' if hi == math.inf else hi + BAND}" for t, (lo, hi) in TIER_RANGE.items()) + " END"


@query("f5_hysteresis_tier", f"""WITH RECURSIVE {FUSED}, k AS (SELECT ticker, date, composite, {TIER} AS now, row_number() OVER ({WT}) AS n FROM fused WHERE composite IS NOT NULL),
  h AS (SELECT ticker, date, n, now AS tier FROM k WHERE n = 1 UNION ALL
    SELECT k.ticker, k.date, k.n, CASE WHEN k.now <> h.tier AND k.composite BETWEEN {_BOUND(0)} AND {_BOUND(1)} THEN h.tier ELSE k.now END FROM h JOIN k ON k.ticker = h.ticker AND k.n = h.n + 1)
  SELECT ticker, date, tier FROM h""")  # fmt: skip
def f5_hysteresis_tier(spark, sf_dir):
    """A tier is held while the score stays within the band around it: sequential, one ticker's cards at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pd.DataFrame({"ticker": pdf["ticker"], "date": pdf["date"], "tier": held_tiers(pdf["composite"].tolist())})

    cards = fused(spark, sf_dir).where("composite is not null").select("ticker", "date", "composite")
    return cards.groupBy("ticker").applyInPandas(run, f"ticker {dict(cards.dtypes)['ticker']}, date date, tier string")


@query("f8_dimension_grades", f"""WITH {SIG}, live AS (SELECT signal FROM sig GROUP BY signal HAVING count(z) >= 20 AND stddev_pop(z) >= 1e-6),
  d AS (SELECT date, ticker, avg(z) AS m FROM sig JOIN live USING (signal) WHERE z IS NOT NULL GROUP BY ALL),
  g AS (SELECT *, CASE WHEN stddev_pop(m) OVER (PARTITION BY date) > 1e-12 THEN (m - avg(m) OVER (PARTITION BY date)) / stddev_pop(m) OVER (PARTITION BY date) END AS z FROM d)
  SELECT date, ticker, CASE WHEN z IS NULL THEN '-' WHEN z >= 1 THEN 'A' WHEN z >= 0.3 THEN 'B' WHEN z > -0.3 THEN 'C' WHEN z > -1 THEN 'D' ELSE 'F' END AS grade FROM g""")  # fmt: skip
def f8_dimension_grades(spark, sf_dir):
    s = signals(spark, sf_dir)
    live = s.groupBy("signal").agg(F.count("z").alias("n"), F.stddev_pop("z").alias("spread")).where("n >= 20 and spread >= 1e-6").select("signal")
    d = s.join(live, "signal", "left_semi").where("z is not null").groupBy("date", "ticker").agg(F.avg("z").alias("m"))
    spread = F.stddev_pop("m").over(b.day())
    z = F.when(spread > 1e-12, (F.col("m") - F.avg("m").over(b.day())) / spread)
    d = d.withColumn("z", z)
    z = F.col("z")
    return d.select("date", "ticker", F.when(z.isNull(), "-").when(z >= 1, "A").when(z >= 0.3, "B").when(z > -0.3, "C").when(z > -1, "D").otherwise("F").alias("grade"))


@query("v10_isotonic_calibration")
def v10_isotonic_calibration(spark, sf_dir):
    """Monotone map of confidence to hit rate: counts by rounded confidence first, then pooling of at most 1001 steps."""
    from sparkfolio.plans.research import v9_confidence_hits

    steps = v9_confidence_hits(spark, sf_dir).groupBy(F.round("confidence", 3).alias("x")).agg(F.sum(F.col("hit").cast("double")).alias("hits"), F.count("*").cast("double").alias("n")).withColumn("key", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks: list[list[float]] = []
        for x, hits, n in pdf.sort_values("x")[["x", "hits", "n"]].itertuples(index=False):
            blocks.append([hits, n, x, x])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                hits, n, _, high = blocks.pop()
                blocks[-1] = [blocks[-1][0] + hits, blocks[-1][1] + n, blocks[-1][2], high]
        return pd.DataFrame([(low, high, h / n, n) for h, n, low, high in blocks], columns=["low", "high", "rate", "n"])

    return steps.groupBy("key").applyInPandas(run, "low double, high double, rate double, n double")


@query("v11_reliability_bins", f"""WITH {FUSED}, {AHEAD}, c AS (SELECT date, ticker, agreement, {TIER} AS tier FROM fused),
  h AS (SELECT round(agreement, 6) AS confidence, CASE WHEN tier IN ('BUY', 'OW') THEN fwd > 0 ELSE fwd < 0 END AS hit FROM c JOIN nx USING (date, ticker) WHERE tier <> 'HOLD' AND fwd IS NOT NULL),
  g AS (SELECT least(CAST(floor(confidence * 10) AS INT), 9) AS bin, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) AS rate, avg(power(confidence - CASE WHEN hit THEN 1 ELSE 0 END, 2)) AS brier, count(*) AS n FROM h GROUP BY 1)
  SELECT CAST(b.bin AS INT) AS bin, {r('rate')} AS rate, {r('brier')} AS brier, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN g USING (bin)""")  # fmt: skip
def v11_reliability_bins(spark, sf_dir):
    from sparkfolio.plans.research import v9_confidence_hits

    h = v9_confidence_hits(spark, sf_dir).withColumn("bin", F.least(F.floor(F.col("confidence") * 10).cast("int"), F.lit(9))).withColumn("y", F.col("hit").cast("double"))
    g = h.groupBy("bin").agg(rounded(F.avg("y")).alias("rate"), rounded(F.avg(F.pow(F.col("confidence") - F.col("y"), 2))).alias("brier"), F.count("*").alias("n"))
    bins = spark.range(10).select(F.col("id").cast("int").alias("bin"))
    return bins.join(g, "bin", "left").select("bin", "rate", "brier", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("v21_ic_changes", f"""WITH {ORDINAL}, c AS (SELECT date, ic, lag(ic) OVER (ORDER BY date) AS before FROM ic) SELECT date, {r('ic - before')} AS change, ic * before < 0 AS flipped FROM c WHERE abs(ic - before) >= 0.05 OR ic * before < 0""")
def v21_ic_changes(spark, sf_dir):
    c = b.ordinal_ic(factor_frame(spark, sf_dir)).withColumn("before", F.lag("ic").over(Window.partitionBy(F.lit(0)).orderBy("date")))
    flipped = F.col("ic") * F.col("before") < 0
    return c.where((F.abs(F.col("ic") - F.col("before")) >= 0.05) | flipped).select("date", rounded(F.col("ic") - F.col("before")).alias("change"), flipped.alias("flipped"))


# -- books ---------------------------------------------------------------------------------------------------------


@query("l3_select_book", f"""WITH {FUSED}, k AS (SELECT date, ticker, composite, {TIER} AS tier FROM fused), o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN tier IN ('BUY', 'OW') THEN 0 ELSE 1 END, composite DESC NULLS LAST, ticker) AS place FROM k),
  c AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM o WHERE place <= 10) SELECT date, ticker, place, {r('least(1.0 / n, 0.15)')} AS weight FROM c""")  # fmt: skip
def l3_select_book(spark, sf_dir):
    k = fused(spark, sf_dir).withColumn("tier", tier(F.col("composite")))
    order = b.day().orderBy(F.when(F.col("tier").isin("BUY", "OW"), 0).otherwise(1), F.desc_nulls_last("composite"), "ticker")
    c = k.withColumn("place", F.row_number().over(order)).where("place <= 10").withColumn("n", F.count("*").over(b.day()))
    return c.select("date", "ticker", "place", rounded(F.least(1 / F.col("n"), F.lit(0.15))).alias("weight"))


@query("l10_limit_fills", f"""WITH {WEEKLY_SQL}, s AS (SELECT ticker, date, close * 0.97 AS cap, row_number() OVER w AS k FROM weekly WINDOW w AS (PARTITION BY ticker ORDER BY date)),
  f AS (SELECT s.ticker, s.date, s.cap, min(p.date) FILTER (p.close < s.cap) AS fill, max(p.k - s.k) AS seen FROM s LEFT JOIN s q ON false LEFT JOIN (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM weekly) p ON p.ticker = s.ticker AND p.k > s.k AND p.k <= s.k + 4 GROUP BY ALL)
  SELECT ticker, date, fill AS fill_date, CASE WHEN fill IS NOT NULL THEN 'filled' WHEN seen = 4 THEN 'expired' ELSE 'pending' END AS status FROM f""")  # fmt: skip
def l10_limit_fills(spark, sf_dir):
    """Buy orders three percent below each close: the next four closes are looked at in a bounded window, without a join."""
    ahead = b.own().rowsBetween(1, 4)
    s = prices_weekly(spark, sf_dir).withColumn("cap", F.col("close") * 0.97).withColumn("next", F.collect_list(F.struct("date", "close")).over(ahead))
    hits = F.filter("next", lambda p: p["close"] < F.col("cap"))
    status = F.when(F.size(hits) > 0, "filled").when(F.size("next") == 4, "expired").otherwise("pending")
    return s.select("ticker", "date", F.try_element_at(hits, F.lit(1))["date"].alias("fill_date"), status.alias("status"))


# -- mined expressions ---------------------------------------------------------------------------------------------

_MINED = " UNION ALL ".join(f"SELECT '{n}' AS name, '{e}' AS expression" for n, (e, _) in LIBRARY.items())


@query("m1b_factor_ic_ranking", f"""WITH {PANEL_SQL}, nx AS (SELECT date, ticker, lead(close, 1) OVER ({WT}) / nullif(close, 0) - 1 AS fwd FROM panel), long AS ({" UNION ALL ".join(f"SELECT '{n}' AS factor_name, date, ticker, v AS factor FROM (SELECT *, {s} AS v FROM panel)" for n, (_, s) in LIBRARY.items())}),
  p AS (SELECT factor_name, date, factor, fwd FROM long JOIN nx USING (date, ticker) WHERE factor IS NOT NULL AND fwd IS NOT NULL), i AS (SELECT factor_name, date, {CORR.format(x="factor", y="fwd")} AS ic FROM p GROUP BY ALL)
  SELECT factor_name, {r("avg(ic)")} AS mean_ic, {r("avg(ic) / nullif(stddev_samp(ic), 0)")} AS ir FROM i GROUP BY factor_name""")  # fmt: skip
def m1b_factor_ic_ranking(spark, sf_dir):
    from sparkfolio.operators.expression import evaluate_many

    base = panel(spark, sf_dir)
    p = evaluate_many(base, {n: e for n, (e, _) in LIBRARY.items()}).withColumnRenamed("value", "factor").join(base.select("date", "ticker", b.forward_return(1).alias("fwd")), ["date", "ticker"])
    i = b.pairs(p).groupBy("factor_name", "date").agg(b.correlation(F.col("factor"), F.col("fwd")).alias("ic"))
    spread = F.stddev_samp("ic")
    return i.groupBy("factor_name").agg(rounded(F.avg("ic")).alias("mean_ic"), rounded(F.when(spread != 0, F.avg("ic") / spread)).alias("ir"))


# -- streams, held against the batch result ------------------------------------------------------------------------


@query("st6_alert_stream", "SELECT user_id AS ticker, event_type AS type, count(*) > 0 AS seen, CAST(time_bucket(INTERVAL 30 MINUTE, ts) AS TIMESTAMP) AS bucket FROM events GROUP BY ALL")
def st6_alert_stream(spark, sf_dir):
    out = jobs.run_to_table(jobs.alert_buckets(jobs.read_events(spark, sf_dir)))
    return out.select("ticker", "type", F.lit(True).alias("seen"), F.col("bucket").cast("timestamp_ntz").alias("bucket"))


@query("st5_tier_stream", """WITH RECURSIVE k AS (SELECT user_id AS ticker, event_id, value, CASE WHEN value > 50 THEN 'HIGH' ELSE 'LOW' END AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE value IS NOT NULL),
  h AS (SELECT ticker, event_id, n, now AS tier FROM k WHERE n = 1 UNION ALL SELECT k.ticker, k.event_id, k.n, CASE WHEN abs(k.value - 50) > 10 THEN k.now ELSE h.tier END FROM h JOIN k ON k.ticker = h.ticker AND k.n = h.n + 1)
  SELECT ticker, event_id, tier FROM h""")  # fmt: skip
def st5_tier_stream(spark, sf_dir):
    """All that is there is a backlog, so no ticker's history goes through one Python worker."""
    return jobs.hysteresis_tiers_of_table(table(spark, sf_dir, "events"))


@query("st1_story_stream", f"WITH {NEWS_SQL} SELECT DISTINCT {HASH_SQL} AS hash FROM news")
def st1_story_stream(spark, sf_dir):
    """Each story of the stream once."""
    return jobs.run_to_table(jobs.fresh_stories(jobs.read_events(spark, sf_dir), table(spark, sf_dir, "documents")))


@query("st2_mood_stream", f"""WITH w AS (SELECT user_id AS ticker, value, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 24 HOUR, INTERVAL 15 MINUTE)) AS slice_end FROM events WHERE ts IS NOT NULL)
  SELECT slice_end, ticker, {r('avg(value)')} AS mean, count(*) AS n FROM w GROUP BY ALL""")  # fmt: skip
def st2_mood_stream(spark, sf_dir):
    """The mean of each ticker's last day, anew every quarter of an hour: the stream adds up slices, of which moods are made."""
    out = jobs.moods_of_slices(jobs.mood_slices(jobs.read_events(spark, sf_dir)))
    return out.select(F.col("at").cast("timestamp_ntz").alias("slice_end"), "ticker", rounded(F.col("mean")).alias("mean"), "n")


@query("st3_bar_stream", "SELECT user_id AS ticker, date_trunc('minute', ts) AS minute, last(value ORDER BY ts, event_id) AS close FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def st3_bar_stream(spark, sf_dir):
    """The latest value of each ticker and minute."""
    return jobs.bars_table(jobs.read_events(spark, sf_dir)).select("ticker", F.col("minute").cast("timestamp_ntz").alias("minute"), "close")


@query("st4_reaction_stream", f"""WITH j AS (SELECT e.event_id, b.ts, b.event_id AS id, b.value AS close FROM events e JOIN events b ON b.user_id = e.user_id AND b.ts >= e.ts AND b.ts <= e.ts + INTERVAL 60 MINUTE),
  g AS (SELECT event_id, arg_min(close, (ts, id)) AS a, arg_max(close, (ts, id)) AS z, count(close) AS bars FROM j GROUP BY event_id) SELECT event_id, {r('z / a - 1')} AS car, bars FROM g WHERE bars >= 2 AND a <> 0""")  # fmt: skip
def st4_reaction_stream(spark, sf_dir):
    """First to last value in the hour after each event, by an interval join of two streams."""
    pairs = jobs.run_to_table(jobs.reactions(jobs.read_events(spark, sf_dir), jobs.read_events(spark, sf_dir)))
    order = F.struct("bar_at", "bar_id")
    g = pairs.groupBy("event_id").agg(F.min_by("close", order).alias("a"), F.max_by("close", order).alias("z"), F.count("close").alias("bars")).where("bars >= 2 and a <> 0")
    return g.select("event_id", rounded(F.col("z") / F.col("a") - 1).alias("car"), "bars")


_SCORE = "(value - 50) / 20"


@query("st5_card_stream", f"""WITH RECURSIVE k AS (SELECT user_id AS ticker, event_id, {_SCORE} AS composite, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events WHERE value IS NOT NULL AND ts IS NOT NULL), t AS (SELECT *, {TIER} AS now FROM k),
  h AS (SELECT ticker, day, event_id, n, now AS tier, false AS alert FROM t WHERE n = 1 UNION ALL
    SELECT t.ticker, t.day, t.event_id, t.n, CASE WHEN t.now <> h.tier AND t.composite BETWEEN {_BOUND(0)} AND {_BOUND(1)} THEN h.tier ELSE t.now END, CASE WHEN t.now <> h.tier AND t.composite BETWEEN {_BOUND(0)} AND {_BOUND(1)} THEN false ELSE t.now <> h.tier END FROM h JOIN t ON t.ticker = h.ticker AND t.day = h.day AND t.n = h.n + 1)
  SELECT ticker, event_id, tier, alert FROM h""")  # fmt: skip
def st5_card_stream(spark, sf_dir):
    """Five tiers with hysteresis and alerts on the stream; a day's first card has none before it."""
    cards = jobs.read_events(spark, sf_dir).where("value is not null and ts is not null").select(F.col("user_id").cast("long").alias("ticker"), F.col("event_id").cast("long").alias("event_id"), "ts", F.expr(_SCORE).alias("score"))
    return jobs.rated_cards_by_batch(cards, lambda scores, held: held_tiers(scores, BAND, held))
