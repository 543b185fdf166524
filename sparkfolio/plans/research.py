"""Queries of panel assembly, screening, signals, fusion, validation, news, books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.functions import lexicon
from sparkfolio.functions.staging import new_folder, staged
from sparkfolio.operators import backtest as b
from sparkfolio.operators.expression import evaluate_wide
from sparkfolio.operators.joins import asof_join, global_ordinal, next_after
from sparkfolio.plans.common import query, rounded
from sparkfolio.plans.common import sql_rounded as r
from sparkfolio.plans.factors import WT
from sparkfolio.sources.dictionary import LEARNED_SQL, learned, read_dictionary, write_dictionary
from sparkfolio.sources.market import PANEL_SQL, PRICES_SQL, panel, prices_daily, table
from sparkfolio.sources.store import exact_quantiles
from sparkfolio.sources.tables import FILINGS_SQL, SIGNALS, WEEKLY_SQL, WEIGHTS, filings, prices_weekly

# -- panel assembly ------------------------------------------------------------------------------------------------


@query("p1_dense_panel", f"WITH {PANEL_SQL} SELECT date, ticker, sector, close, volume FROM panel")
def p1_dense_panel(spark, sf_dir):
    return panel(spark, sf_dir).select("date", "ticker", "sector", "close", "volume")


@query("io5_latest_close_upsert", f"""SELECT user_id AS ticker, CAST(ts AS DATE) AS date, last(value ORDER BY ts, event_id) AS close FROM events WHERE value > 0 GROUP BY ALL""")
def io5_latest_close_upsert(spark, sf_dir):
    """One close per ticker and date, the latest wins; null and non-positive ones are refused."""
    good = table(spark, sf_dir, "events").where("value > 0")
    return good.groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))


@query("io8_winsorize_global", f"WITH {FILINGS_SQL}, q AS (SELECT quantile_cont(amount, 0.005) AS lo, quantile_cont(amount, 0.995) AS hi FROM filings) SELECT filing_id, {r('least(greatest(amount, lo), hi)')} AS amount FROM filings, q")
def io8_winsorize_global(spark, sf_dir):
    """Amounts clipped at exact quantiles, which ranges and counts find, so that no task holds all values."""
    f = filings(spark, sf_dir)
    q = exact_quantiles(f, "amount", [0.005, 0.995])
    return f.join(F.broadcast(q)).select("filing_id", rounded(F.least(F.greatest("amount", "q0"), "q1")).alias("amount"))  # one row


@query("p3_asof_statements", f"""WITH {WEEKLY_SQL}, {FILINGS_SQL}, f AS (SELECT ticker, filing_date, arg_max(amount, filing_id) AS amount FROM filings GROUP BY ALL)
  SELECT w.ticker, w.date, f.filing_date, f.amount FROM weekly w ASOF LEFT JOIN f ON w.ticker = f.ticker AND w.date >= f.filing_date""")  # fmt: skip
def p3_asof_statements(spark, sf_dir):
    prices = prices_weekly(spark, sf_dir).select("ticker", "date")
    return asof_join(prices, filings(spark, sf_dir), "ticker", "date", "filing_date", "filing_id", ["amount"])


@query("p4_market_cap", f"""WITH {WEEKLY_SQL}, {FILINGS_SQL}, f AS (SELECT ticker, filing_date, arg_max(amount, filing_id) AS amount FROM filings GROUP BY ALL)
  SELECT w.ticker, w.date, {r('w.close * f.amount / 1000')} AS cap FROM weekly w ASOF LEFT JOIN f ON w.ticker = f.ticker AND w.date >= f.filing_date""")  # fmt: skip
def p4_market_cap(spark, sf_dir):
    joined = asof_join(prices_weekly(spark, sf_dir), filings(spark, sf_dir), "ticker", "date", "filing_date", "filing_id", ["amount"])
    return joined.select("ticker", "date", rounded(F.col("close") * F.col("amount") / 1000).alias("cap"))


@query("p6_event_window", f"""WITH {WEEKLY_SQL}, {FILINGS_SQL} SELECT w.ticker, w.date FROM weekly w WHERE EXISTS (SELECT 1 FROM filings f WHERE f.ticker = w.ticker AND abs(date_diff('day', f.filing_date, w.date)) <= 3)""")
def p6_event_window(spark, sf_dir):
    """Price rows within three days of a filing: the days around filings are laid out, then met by equality."""
    days = F.explode(F.sequence(F.date_sub("filing_date", 3), F.date_add("filing_date", 3)))
    near = filings(spark, sf_dir).select("ticker", days.alias("date"))
    return prices_weekly(spark, sf_dir).select("ticker", "date").join(near, ["ticker", "date"], "left_semi")


@query("p8_snapshot_attributes", f"WITH {PRICES_SQL} SELECT ticker, last(sector ORDER BY date) AS sector, last(close ORDER BY date) AS close, max(date) AS date FROM prices GROUP BY ticker")
def p8_snapshot_attributes(spark, sf_dir):
    return prices_daily(spark, sf_dir).groupBy("ticker").agg(F.max_by("sector", "date").alias("sector"), F.max_by("close", "date").alias("close"), F.max("date").alias("date"))


@query("p10_medium_cap_filter", f"WITH {PRICES_SQL}, m AS (SELECT ticker, avg(close * volume) AS cap FROM prices GROUP BY ticker) SELECT ticker, {r('cap')} AS cap FROM m WHERE cap < (SELECT quantile_cont(cap, 0.7) FROM m)")
def p10_medium_cap_filter(spark, sf_dir):
    m = prices_daily(spark, sf_dir).groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("cap"))
    m = staged(m)
    limit = exact_quantiles(m, "cap", [0.7])
    return m.join(F.broadcast(limit)).where("cap < q0").select("ticker", rounded(F.col("cap")).alias("cap"))  # one row


@query("p11_coverage", f"WITH {PANEL_SQL} SELECT ticker, {r('count(close) / CAST(count(*) AS DOUBLE)')} AS close_rate, {r('count(returns) / CAST(count(*) AS DOUBLE)')} AS returns_rate FROM panel GROUP BY ticker")
def p11_coverage(spark, sf_dir):
    rate = lambda c: rounded(F.count(c) / F.count("*")).alias(f"{c}_rate")
    return panel(spark, sf_dir).groupBy("ticker").agg(rate("close"), rate("returns"))


@query("p12_quality_report", f"""WITH {PRICES_SQL}, g AS (SELECT *, date_diff('day', lag(date) OVER ({WT}), date) AS gap FROM prices)
  SELECT ticker, count(*) FILTER (least(open, high, low, close) < 0) AS negatives, count(*) FILTER (open > high) AS open_above, count(*) FILTER (low > open) AS low_above,
         count(*) FILTER (volume <= 0) AS no_volume, count(*) FILTER (gap > 5) AS gaps, count(*) FILTER (close IS NULL) AS missing FROM g GROUP BY ticker""")  # fmt: skip
def p12_quality_report(spark, sf_dir):
    g = prices_daily(spark, sf_dir).withColumn("gap", F.datediff("date", F.lag("date").over(b.own())))
    rules = {"negatives": F.least("open", "high", "low", "close") < 0, "open_above": F.col("open") > F.col("high"), "low_above": F.col("low") > F.col("open"), "no_volume": F.col("volume") <= 0, "gaps": F.col("gap") > 5, "missing": F.col("close").isNull()}
    return g.groupBy("ticker").agg(*[F.count_if(c).alias(n) for n, c in rules.items()])


# -- screener ------------------------------------------------------------------------------------------------------


@query("k2_multi_factor_screen", f"""WITH {PANEL_SQL}, d AS (SELECT * FROM panel WHERE date = (SELECT max(date) FROM panel) AND sector <> 'S0'),
  z AS (SELECT ticker, CASE WHEN stddev_samp(returns) OVER () > 0 THEN (returns - avg(returns) OVER ()) / stddev_samp(returns) OVER () WHEN returns IS NOT NULL THEN 0 END AS z1,
    CASE WHEN stddev_samp(volume) OVER () > 0 THEN -(volume - avg(volume) OVER ()) / stddev_samp(volume) OVER () WHEN volume IS NOT NULL THEN 0 END AS z2 FROM d)
  SELECT ticker, {r('(coalesce(z1, 0) + coalesce(z2, 0)) / 2')} AS score FROM z WHERE z1 IS NOT NULL OR z2 IS NOT NULL""")  # fmt: skip
def k2_multi_factor_screen(spark, sf_dir):
    p = panel(spark, sf_dir)
    d = p.where("sector <> 'S0'").join(p.agg(F.max("date").alias("date")), "date", "left_semi")
    spread = lambda c: F.stddev_samp(c).over(b.day())
    z = lambda c: F.when(spread(c) > 0, (F.col(c) - F.avg(c).over(b.day())) / spread(c)).when(F.col(c).isNotNull(), 0.0)
    z = d.select("ticker", z("returns").alias("z1"), (-z("volume")).alias("z2")).where("z1 is not null or z2 is not null")
    return z.select("ticker", rounded((F.coalesce("z1", F.lit(0.0)) + F.coalesce("z2", F.lit(0.0))) / 2).alias("score"))


@query("k4_top_and_bottom", f"""WITH {PANEL_SQL}, d AS (SELECT ticker, volume AS v FROM panel WHERE date = (SELECT max(date) FROM panel) AND volume IS NOT NULL)
  (SELECT 'top' AS side, ticker, v FROM d ORDER BY v DESC, ticker LIMIT 10) UNION ALL (SELECT 'bottom', ticker, v FROM d ORDER BY v, ticker LIMIT 10)""")  # fmt: skip
def k4_top_and_bottom(spark, sf_dir):
    p = panel(spark, sf_dir)
    d = p.join(p.agg(F.max("date").alias("date")), "date", "left_semi").where("volume is not null").select("ticker", F.col("volume").alias("v"))
    side = lambda name, *order: d.orderBy(*order).limit(10).select(F.lit(name).alias("side"), "ticker", "v")
    return side("top", F.desc("v"), "ticker").union(side("bottom", "v", "ticker"))


@query("k7_daily_change", f"""WITH {PRICES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM prices)
  SELECT ticker, max(close) FILTER (n = 1) AS last_close, max(close) FILTER (n = 2) AS previous_close, {r('(max(close) FILTER (n = 1) / nullif(max(close) FILTER (n = 2), 0) - 1) * 100')} AS change_pct FROM k WHERE n <= 2 GROUP BY ticker""")  # fmt: skip
def k7_daily_change(spark, sf_dir):
    k = prices_daily(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where("n <= 2")
    one, two = (F.max(F.when(F.col("n") == n, F.col("close"))) for n in (1, 2))
    return k.groupBy("ticker").agg(one.alias("last_close"), two.alias("previous_close")).withColumn("change_pct", rounded(F.when(F.col("previous_close") != 0, (F.col("last_close") / F.col("previous_close") - 1) * 100)))


# -- signals and fusion --------------------------------------------------------------------------------------------


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table ticker, date, signal, z, confidence of three signals on the panel; confidence 0 where z is missing."""
    df = evaluate_wide(panel(spark, sf_dir), {"momentum": "zscore(ts_mean(returns, 5))", "reversal": "zscore(reverse(returns))", "activity": "zscore(volume)"})
    long = df.unpivot(["date", "ticker"], list(SIGNALS), "signal", "z")
    confidence = F.coalesce(*[F.when(F.col("signal") == s, F.lit(c)) for s, c in SIGNALS.items()])
    return long.withColumn("confidence", F.when(F.col("z").isNull(), 0.0).otherwise(confidence))


def _z(x: str) -> str:
    return f"CASE WHEN stddev_pop({x}) OVER (PARTITION BY date) > 1e-12 THEN ({x} - avg({x}) OVER (PARTITION BY date)) / stddev_pop({x}) OVER (PARTITION BY date) END"


SIG = f"""{PANEL_SQL}, legs AS (SELECT *, CASE WHEN rn >= 5 THEN avg(returns) OVER ({WT} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS m FROM panel),
  zs AS (SELECT date, ticker, {_z('m')} AS momentum, {_z('-returns')} AS reversal, {_z('volume')} AS activity FROM legs),
  sig AS (""" + " UNION ALL ".join(f"SELECT date, ticker, '{s}' AS signal, {s} AS z, CASE WHEN {s} IS NULL THEN 0 ELSE {c} END AS confidence, {WEIGHTS[s]} AS w FROM zs" for s, c in SIGNALS.items()) + ")"  # fmt: skip
FUSED = SIG + """, live AS (SELECT *, w / sum(w) OVER (PARTITION BY date, ticker) AS we FROM sig WHERE confidence > 0),
  fused AS (SELECT date, ticker, sum(we * z) * sqrt(sum(w)) AS composite, sum(w) AS coverage, 1 / (1 + var_pop(z)) AS agreement,
    arg_max(signal, (we * z, signal)) AS driver, arg_min(signal, (we * z, signal)) AS drag FROM live GROUP BY date, ticker)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite of live signals with renormalised weights, coverage, agreement, and the strongest and weakest contribution."""
    weight = F.coalesce(*[F.when(F.col("signal") == s, F.lit(x)) for s, x in WEIGHTS.items()])
    card = Window.partitionBy("date", "ticker")
    live = signals(spark, sf_dir).where("confidence > 0").withColumn("w", weight).withColumn("we", F.col("w") / F.sum("w").over(card))
    part = F.struct((F.col("we") * F.col("z")).alias("c"), F.col("signal").alias("s"))
    return live.groupBy("date", "ticker").agg(
        (F.sum(F.col("we") * F.col("z")) * F.sqrt(F.sum("w"))).alias("composite"),
        F.sum("w").alias("coverage"),
        (1 / (1 + F.var_pop("z"))).alias("agreement"),
        F.max(part)["s"].alias("driver"),
        F.min(part)["s"].alias("drag"),
    )


def tier(score):
    """Five tiers; the upper cuts are left by more than their value, the lower ones keep theirs; no score is HOLD."""
    score = F.nanvl(score, F.lit(None).cast("double"))
    return F.when(score.isNull(), "HOLD").when(score > 1.5, "BUY").when(score > 0.5, "OW").when(score >= -0.5, "HOLD").when(score >= -1.5, "UW").otherwise("SELL")


TIER = "CASE WHEN composite IS NULL OR isnan(composite) THEN 'HOLD' WHEN composite > 1.5 THEN 'BUY' WHEN composite > 0.5 THEN 'OW' WHEN composite >= -0.5 THEN 'HOLD' WHEN composite >= -1.5 THEN 'UW' ELSE 'SELL' END"


@query("f1_f3_fuse_signals", f"WITH {FUSED} SELECT date, ticker, {r('composite')} AS composite, {r('CAST(coverage AS DOUBLE)')} AS coverage FROM fused")
def f1_f3_fuse_signals(spark, sf_dir):
    return fused(spark, sf_dir).select("date", "ticker", rounded(F.col("composite")).alias("composite"), rounded(F.col("coverage")).alias("coverage"))


@query("f4_f6_tier_and_agreement", f"WITH {FUSED} SELECT date, ticker, {TIER} AS tier, {r('agreement')} AS agreement FROM fused")
def f4_f6_tier_and_agreement(spark, sf_dir):
    return fused(spark, sf_dir).select("date", "ticker", tier(F.col("composite")).alias("tier"), rounded(F.col("agreement")).alias("agreement"))


@query("f7_cross_section_normalize", f"WITH {SIG} SELECT date, ticker, signal, {r('greatest(-3.0, least(3.0, coalesce(z, 0)))')} AS z FROM sig")
def f7_cross_section_normalize(spark, sf_dir):
    return signals(spark, sf_dir).select("date", "ticker", "signal", rounded(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.coalesce("z", F.lit(0.0))))).alias("z"))


@query("f9_drivers_and_drags", f"WITH {FUSED} SELECT date, ticker, driver, drag FROM fused")
def f9_drivers_and_drags(spark, sf_dir):
    return fused(spark, sf_dir).select("date", "ticker", "driver", "drag")


# -- validation ----------------------------------------------------------------------------------------------------

AHEAD = f"nx AS (SELECT date, ticker, lead(close, 5) OVER ({WT}) / nullif(close, 0) - 1 AS fwd, lead(close, 1) OVER ({WT}) / nullif(close, 0) - 1 AS fwd1 FROM panel)"


@query("v1_v2_walk_forward_ic", f"""WITH {SIG}, {AHEAD}, p AS (SELECT s.signal, s.z, x.fwd, s.ticker, s.date FROM sig s JOIN nx x USING (date, ticker) WHERE z IS NOT NULL AND fwd IS NOT NULL),
  k AS (SELECT signal, CAST(row_number() OVER (PARTITION BY signal ORDER BY round(z, 9), date, ticker) AS DOUBLE) AS a, CAST(row_number() OVER (PARTITION BY signal ORDER BY round(fwd, 9), date, ticker) AS DOUBLE) AS b FROM p)
  SELECT signal, {r('covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b))')} AS ic, count(*) AS n FROM k GROUP BY signal HAVING count(*) >= 10""")  # fmt: skip
def v1_v2_walk_forward_ic(spark, sf_dir):
    """Pooled rank correlation per signal: signals are few and large, so ranks come from ranges and offsets."""
    ahead = panel(spark, sf_dir).select("date", "ticker", b.forward_return(5).alias("fwd"))
    p = signals(spark, sf_dir).join(ahead, ["date", "ticker"]).where("z is not null and fwd is not null")
    p = p.select("signal", "date", "ticker", F.round("z", 9).alias("z"), F.round("fwd", 9).alias("fwd"))  # ties must not hang on the last bits
    p = global_ordinal(p, "signal", ["z", "date", "ticker"], "a")
    p = global_ordinal(p, "signal", ["fwd", "date", "ticker"], "b")
    ic = b.correlation(F.col("a").cast("double"), F.col("b").cast("double"))
    return p.groupBy("signal").agg(rounded(ic).alias("ic"), F.count("*").alias("n")).where("n >= 10")


@query("v9_confidence_hits", f"""WITH {FUSED}, {AHEAD}, c AS (SELECT date, ticker, agreement, {TIER} AS tier FROM fused)
  SELECT c.date, c.ticker, {r('agreement')} AS confidence, CASE WHEN tier IN ('BUY', 'OW') THEN fwd > 0 ELSE fwd < 0 END AS hit FROM c JOIN nx USING (date, ticker) WHERE tier <> 'HOLD' AND fwd IS NOT NULL""")  # fmt: skip
def v9_confidence_hits(spark, sf_dir):
    ahead = panel(spark, sf_dir).select("date", "ticker", b.forward_return(5).alias("fwd"))
    c = fused(spark, sf_dir).withColumn("tier", tier(F.col("composite"))).where("tier <> 'HOLD'").join(ahead, ["date", "ticker"]).where("fwd is not null")
    return c.select("date", "ticker", rounded(F.col("agreement")).alias("confidence"), F.when(F.col("tier").isin("BUY", "OW"), F.col("fwd") > 0).otherwise(F.col("fwd") < 0).alias("hit"))


@query("v12_tier_returns", f"""WITH {FUSED}, {AHEAD}, c AS (SELECT date, ticker, {TIER} AS tier FROM fused)
  SELECT tier, {r('avg(fwd)')} AS mean_return, {r('avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END)')} AS hit_rate, count(*) AS n FROM c JOIN nx USING (date, ticker) WHERE fwd IS NOT NULL GROUP BY tier""")  # fmt: skip
def v12_tier_returns(spark, sf_dir):
    ahead = panel(spark, sf_dir).select("date", "ticker", b.forward_return(5).alias("fwd"))
    c = fused(spark, sf_dir).withColumn("tier", tier(F.col("composite"))).join(ahead, ["date", "ticker"]).where("fwd is not null")
    return c.groupBy("tier").agg(rounded(F.avg("fwd")).alias("mean_return"), rounded(F.avg((F.col("fwd") > 0).cast("double"))).alias("hit_rate"), F.count("*").alias("n"))


@query("v18_basket_scoreboard", f"""WITH {FUSED}, {AHEAD}, s AS (SELECT date, ticker, composite, fwd1, rank() OVER (PARTITION BY date ORDER BY composite DESC) AS up, rank() OVER (PARTITION BY date ORDER BY composite) AS dn, count(*) OVER (PARTITION BY date) AS n
    FROM fused JOIN nx USING (date, ticker) WHERE fwd1 IS NOT NULL)
  SELECT date, {r('avg(fwd1) FILTER (up <= 20)')} AS long_return, {r('avg(fwd1) FILTER (dn <= 20)')} AS short_return, {r('avg(fwd1)')} AS market, count(*) AS n FROM s WHERE n >= 60 GROUP BY date""")  # fmt: skip
def v18_basket_scoreboard(spark, sf_dir):
    ahead = panel(spark, sf_dir).select("date", "ticker", b.forward_return(1).alias("fwd"))
    s = fused(spark, sf_dir).join(ahead, ["date", "ticker"]).where("fwd is not null")
    s = s.withColumn("up", F.rank().over(b.day().orderBy(F.desc("composite")))).withColumn("dn", F.rank().over(b.day().orderBy("composite"))).withColumn("size", F.count("*").over(b.day()))
    mean = lambda c: rounded(F.avg(F.when(F.col(c) <= 20, F.col("fwd"))))
    return s.where("size >= 60").groupBy("date").agg(mean("up").alias("long_return"), mean("dn").alias("short_return"), rounded(F.avg("fwd")).alias("market"), F.count("*").alias("n"))


# -- news, events, alerts ------------------------------------------------------------------------------------------

@query("n1_n2_news_dedup", r"""WITH n AS (SELECT page_id, 'T' || (page_id % 50) AS ticker,
    lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', '') AS u FROM pages),
  h AS (SELECT page_id, sha256(upper(ticker) || '|' || u) AS hash FROM n) SELECT hash, min(page_id) AS page_id, count(*) AS copies FROM h GROUP BY hash""")  # fmt: skip
def n1_n2_news_dedup(spark, sf_dir):
    """Items by the hash of ticker and normalised url; the first of a hash stays."""
    head = F.lower(F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]*)", 1))
    tail = F.regexp_replace(F.regexp_replace("url", "^[a-zA-Z]+://[^/?#]*", ""), "[?#].*$", "")
    ticker = F.concat(F.lit("T"), F.col("page_id") % 50)
    return table(spark, sf_dir, "pages").groupBy(F.sha2(F.concat(F.upper(ticker), F.lit("|"), head, tail), 256).alias("hash")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of the news queries: words that lean to good or bad labelled documents, written to a file and read as a caller's."""
    path = new_folder(spark, "dictionary")
    write_dictionary(learned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), path)
    return read_dictionary(spark, path)


@query("n3_dictionary_sentiment", f"""WITH {LEARNED_SQL}, c AS (SELECT doc_id, {lexicon.sql_hits('text', lexicon.POSITIVE)} AS good, {lexicon.sql_hits('text', lexicon.NEGATIVE)} AS bad FROM documents, sides) SELECT doc_id, good, bad, {lexicon.sql_mood('good', 'bad')} AS sentiment FROM c""")
def n3_dictionary_sentiment(spark, sf_dir):
    """Counts of good and bad whole words and the side that outweighs the other, by a dictionary read from a file."""
    c = lexicon.counted(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), dictionary(spark, sf_dir))
    return c.withColumn("sentiment", lexicon.mood(F.col("good"), F.col("bad")))


@query("n4_event_classifier", """SELECT conv_id, turn, CASE WHEN role = 'system' OR lower(text) LIKE '%war%' THEN 'geopolitical' WHEN lower(text) LIKE '%tax%' OR lower(text) LIKE '%vote%' THEN 'political' ELSE 'other' END AS category FROM conversations""")
def n4_event_classifier(spark, sf_dir):
    text = F.lower("text")
    category = F.when((F.col("role") == "system") | text.contains("war"), "geopolitical").when(text.contains("tax") | text.contains("vote"), "political").otherwise("other")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", category.alias("category"))


@query("n8_alert_detection", f"""WITH {FUSED}, c AS (SELECT date, ticker, {TIER} AS tier, lag({TIER}) OVER ({WT}) AS before, abs(composite) > 1.8 AS extreme FROM fused)
  SELECT date, ticker, 'rating_change' AS type FROM c WHERE before IS NOT NULL AND tier <> before UNION ALL SELECT date, ticker, 'gap' FROM c WHERE extreme""")  # fmt: skip
def n8_alert_detection(spark, sf_dir):
    c = fused(spark, sf_dir).withColumn("tier", tier(F.col("composite"))).withColumn("before", F.lag("tier").over(b.own()))
    kinds = F.array(F.when(F.col("tier") != F.col("before"), "rating_change"), F.when(F.abs("composite") > 1.8, "gap"))
    return c.select("date", "ticker", F.explode(F.array_compact(kinds)).alias("type"))


@query("n9_alert_queue", "SELECT user_id AS ticker, event_type AS type, CAST(floor(epoch(ts) / 1800) AS BIGINT) AS bucket, min(event_id) AS first_event FROM events GROUP BY ALL")
def n9_alert_queue(spark, sf_dir):
    """One alert per ticker, type and half hour."""
    bucket = F.floor(F.unix_timestamp("ts") / 1800)
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("ticker"), F.col("event_type").alias("type"), bucket.alias("bucket")).agg(F.min("event_id").alias("first_event"))


@query("n7_event_study", """WITH bars AS (SELECT user_id % 20 AS ticker, date_trunc('minute', ts) AS ts, avg(value) AS close FROM events GROUP BY ALL), ev AS (SELECT event_id, user_id % 20 AS ticker, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
  j AS (SELECT event_id, b.ts, b.close FROM ev e JOIN bars b ON b.ticker = e.ticker AND b.ts BETWEEN e.ts AND e.ts + INTERVAL 60 MINUTE)
  SELECT event_id, arg_min(close, ts) AS a, round(arg_max(close, ts) / nullif(arg_min(close, ts), 0) - 1, 6) + 0.0 AS car, count(*) AS bars FROM j GROUP BY event_id HAVING count(*) >= 2""")  # fmt: skip
def n7_event_study(spark, sf_dir):
    """First to last close within the hour after an event: hours are the equality part of the interval join."""
    e = table(spark, sf_dir, "events")
    bars = e.groupBy((F.col("user_id") % 20).alias("ticker"), F.date_trunc("minute", "ts").alias("bar")).agg(F.avg("value").alias("close")).withColumn("hour", F.date_trunc("hour", "bar"))
    first = e.agg(F.min("event_type").alias("event_type"))
    ev = e.join(F.broadcast(first), "event_type").select("event_id", (F.col("user_id") % 20).alias("ticker"), "ts")  # one row
    hours = F.explode(F.array(F.date_trunc("hour", "ts"), F.date_trunc("hour", "ts") + F.expr("interval 1 hour")))
    j = ev.withColumn("hour", hours).join(bars, ["ticker", "hour"]).where("bar between ts and ts + interval 60 minutes")
    g = j.groupBy("event_id").agg(F.min_by("close", "bar").alias("a"), F.max_by("close", "bar").alias("z"), F.count("*").alias("bars")).where("bars >= 2")
    return g.select("event_id", "a", rounded(F.when(F.col("a") != 0, F.col("z") / F.col("a") - 1)).alias("car"), "bars")


# -- books ---------------------------------------------------------------------------------------------------------


@query("l9_market_fills", f"""WITH {PRICES_SQL}, s AS (SELECT event_id, user_id AS ticker, CAST(ts AS DATE) AS d FROM events WHERE value > 100)
  SELECT s.event_id, s.ticker, min(p.date) AS fill_date, arg_min(p.close, p.date) AS fill_price FROM s LEFT JOIN prices p ON p.ticker = s.ticker AND p.date > s.d GROUP BY ALL
  UNION ALL SELECT o.order_id, o.ticker, min(p.date), arg_min(p.close, p.date) FROM (SELECT -o_orderkey AS order_id, o_custkey % 150 + 1 AS ticker, DATE '2024-01-01' + CAST(o_orderkey % 40 AS INT) - 5 AS d FROM orders) o
    LEFT JOIN prices p ON p.ticker = o.ticker AND p.date > o.d GROUP BY ALL""")  # fmt: skip
def l9_market_fills(spark, sf_dir):
    """Each order fills at its ticker's first close after its date, whether or not the ticker has a bar on that date.

    The orders are the events over 100, and all ``orders`` with dates that bars need not have.
    """
    bars = prices_daily(spark, sf_dir).select("ticker", "date", "close")
    s = table(spark, sf_dir, "events").where("value > 100").select(F.col("event_id").alias("order_id"), F.col("user_id").alias("ticker"), F.to_date("ts").alias("signal_date"))
    day = F.date_add(F.lit("2023-12-27").cast("date"), (F.col("o_orderkey") % 40).cast("int"))
    o = table(spark, sf_dir, "orders").select((-F.col("o_orderkey")).alias("order_id"), (F.col("o_custkey") % 150 + 1).alias("ticker"), day.alias("signal_date"))
    filled = next_after(s.unionByName(o), bars, "ticker", "signal_date", "date", ["close"])
    return filled.select(F.col("order_id").alias("event_id"), "ticker", F.col("date").alias("fill_date"), F.col("close").alias("fill_price"))


@query("l14_benchmark_index", f"WITH {PANEL_SQL}, m AS (SELECT date, avg(close) AS level FROM panel GROUP BY date) SELECT date, {r('level / nullif(first_value(level) OVER (ORDER BY date), 0) * 100')} AS idx FROM m")
def l14_benchmark_index(spark, sf_dir):
    m = panel(spark, sf_dir).groupBy("date").agg(F.avg("close").alias("level"))
    return m.select("date", rounded(F.try_divide("level", F.first("level").over(Window.partitionBy(F.lit(0)).orderBy("date"))) * 100).alias("idx"))


@query("l15_run_changes", f"""WITH {FUSED}, k AS (SELECT *, {TIER} AS tier, row_number() OVER (PARTITION BY date ORDER BY composite DESC, ticker) AS n FROM fused),
  ds AS (SELECT DISTINCT date FROM k ORDER BY date DESC LIMIT 2), a AS (SELECT * FROM k WHERE n <= 50 AND date = (SELECT max(date) FROM ds)), c AS (SELECT * FROM k WHERE n <= 50 AND date = (SELECT min(date) FROM ds))
  SELECT coalesce(a.ticker, c.ticker) AS ticker, CASE WHEN c.ticker IS NULL THEN 'added' WHEN a.ticker IS NULL THEN 'removed' WHEN a.tier <> c.tier THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN c ON a.ticker = c.ticker""")  # fmt: skip
def l15_run_changes(spark, sf_dir):
    k = fused(spark, sf_dir).withColumn("tier", tier(F.col("composite"))).withColumn("n", F.row_number().over(b.day().orderBy(F.desc("composite"), "ticker"))).where("n <= 50")
    days = k.select("date").distinct().orderBy(F.desc("date")).limit(2).agg(F.max("date").alias("now"), F.min("date").alias("then"))
    k = k.join(F.broadcast(days))  # one row
    now = k.where("date = now").select("ticker", F.col("tier").alias("a"))
    then = k.where("date = then").select("ticker", F.col("tier").alias("c"))
    change = F.when(F.col("c").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("c"), "changed").otherwise("same")
    return now.join(then, "ticker", "full").select("ticker", change.alias("change"))
