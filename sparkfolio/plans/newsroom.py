"""Queries of news, events, alerts and the health of the feeds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.functions import lexicon
from sparkfolio.functions.staging import new_folder, staged
from sparkfolio.operators import backtest as b
from sparkfolio.operators import upkeep
from sparkfolio.operators.technical import clipped
from sparkfolio.plans.common import query, rounded
from sparkfolio.plans.common import sql_rounded as r
from sparkfolio.plans.research import FUSED, SIG, TIER, dictionary, fused, signals, tier
from sparkfolio.plans.validation import PREDS, v14_outcomes_fast_and_slow
from sparkfolio.sources import feeds
from sparkfolio.sources.dictionary import LEARNED_SQL
from sparkfolio.sources.feeds import DIRECTION, HASH_SQL, IMPACT, MACRO_SQL, NEWS_SQL, macro_events, news_items
from sparkfolio.sources.market import prices_daily, table
from sparkfolio.sources.versions import DatedTable

# -- stories --------------------------------------------------------------------------------------------------------


@query("n1_story_hash", f"WITH {NEWS_SQL}, h AS (SELECT item_id, {HASH_SQL} AS hash FROM news) SELECT hash, min(item_id) AS item_id, count(*) AS copies FROM h GROUP BY hash")
def n1_story_hash(spark, sf_dir):
    """Stories by ticker, address without query and headline without punctuation; the first of a hash stays."""
    h = news_items(spark, sf_dir).withColumn("hash", feeds.story_hash(F.col("ticker"), F.col("url"), F.col("headline")))
    return h.groupBy("hash").agg(F.min("item_id").alias("item_id"), F.count("*").alias("copies"))


@query("n2_insert_once", f"WITH {NEWS_SQL}, h AS (SELECT item_id, source, {HASH_SQL} AS hash FROM news), st AS (SELECT DISTINCT hash FROM h WHERE source = 'alpha'), fresh AS (SELECT hash, min(item_id) AS item_id FROM h WHERE source <> 'alpha' AND hash NOT IN (SELECT hash FROM st) GROUP BY hash) SELECT item_id, hash, count(*) OVER () AS inserted FROM fresh")
def n2_insert_once(spark, sf_dir):
    """Items whose hash the store (here: the first source) does not hold, the first of each, and how many go in."""
    h = news_items(spark, sf_dir).select("item_id", "source", feeds.story_hash(F.col("ticker"), F.col("url"), F.col("headline")).alias("hash"))
    fresh = h.where("source <> 'alpha'").join(h.where("source = 'alpha'"), "hash", "left_anti").groupBy("hash").agg(F.min("item_id").alias("item_id"))
    n = fresh.agg(F.count("*").alias("inserted"))
    return fresh.join(F.broadcast(n)).select("item_id", "hash", "inserted")  # one row


@query("n5_source_failover", f"WITH {NEWS_SQL}, p AS (SELECT *, CASE source WHEN 'beta' THEN 1 WHEN 'alpha' THEN 2 ELSE 3 END AS priority FROM news), b AS (SELECT *, min(priority) OVER (PARTITION BY ticker) AS best FROM p) SELECT ticker, source, item_id FROM b WHERE priority = best")
def n5_source_failover(spark, sf_dir):
    """Per ticker the items of the first source that has any: the best one is found by a small aggregate, not by a window over a ticker's news."""
    priority = F.when(F.col("source") == "beta", 1).when(F.col("source") == "alpha", 2).otherwise(3)
    p = news_items(spark, sf_dir).select("ticker", "source", "item_id", priority.alias("priority"))
    best = p.groupBy("ticker").agg(F.min("priority").alias("priority"))
    return p.join(best, ["ticker", "priority"], "left_semi").select("ticker", "source", "item_id")


_SPAN = ("2024-01-02", "2024-01-10")


@query("n6_events_of_tickers", f"""WITH {NEWS_SQL}, {MACRO_SQL}, u AS (SELECT ticker, 'news' AS type, item_id AS id, published_at FROM news UNION ALL SELECT unnest(tickers), 'macro', event_id, published_at FROM macro),
  k AS (SELECT *, row_number() OVER (PARTITION BY ticker, type ORDER BY published_at DESC, id) AS n FROM u WHERE published_at >= TIMESTAMP '{_SPAN[0]}' AND published_at < TIMESTAMP '{_SPAN[1]}') SELECT ticker, type, id, n FROM k WHERE n <= 200""")  # fmt: skip
def n6_events_of_tickers(spark, sf_dir):
    """News and macro events of every ticker in a period, the newest 200 of each kind; Spark keeps no more than those before the shuffle."""
    news = news_items(spark, sf_dir).select("ticker", F.lit("news").alias("type"), F.col("item_id").alias("id"), "published_at")
    macro = macro_events(spark, sf_dir).select(F.explode("tickers").alias("ticker"), F.lit("macro").alias("type"), F.col("event_id").alias("id"), "published_at")
    inside = F.col("published_at").between(F.lit(_SPAN[0]).cast("timestamp"), F.lit(_SPAN[1]).cast("timestamp") - F.expr("interval 1 microsecond"))
    n = F.row_number().over(Window.partitionBy("ticker", "type").orderBy(F.desc("published_at"), "id"))
    return news.unionByName(macro).where(inside).withColumn("n", n).where("n <= 200").select("ticker", "type", "id", "n")


@query("n4_classified_events", f"WITH {MACRO_SQL} SELECT event_id, {lexicon.sql_event_class('author', 'title', 'body')} AS category FROM macro")
def n4_classified_events(spark, sf_dir):
    return macro_events(spark, sf_dir).select("event_id", lexicon.event_class(F.col("author"), F.col("title"), F.col("body")).alias("category"))


_IMPACT_SQL = "CASE impact " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in IMPACT.items()) + " END"
_SIGN_SQL = "CASE direction " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DIRECTION.items()) + " END"


def _score_sql(text: str) -> str:
    mood = lexicon.sql_mood(lexicon.sql_hits(text, lexicon.POSITIVE), lexicon.sql_hits(text, lexicon.NEGATIVE))
    return f"CASE WHEN impact IS NOT NULL AND direction IS NOT NULL THEN CAST({_IMPACT_SQL} * {_SIGN_SQL} AS DOUBLE) ELSE CASE {mood} WHEN 'bullish' THEN 0.7 WHEN 'bearish' THEN -0.7 ELSE 0 END END AS score, impact IS NOT NULL AND direction IS NOT NULL AS judged"


def scored(items: DataFrame, key: str, text: Column, words: DataFrame) -> DataFrame:
    """``score`` (impact times direction, or what the dictionary says of the text where they are missing) and ``judged``.

    Texts are told apart by ``key``; only those that need it are looked up.
    """
    of = lambda c, table: F.coalesce(*[F.when(F.col(c) == k, F.lit(float(v))) for k, v in table.items()])
    judged = F.col("impact").isNotNull() & F.col("direction").isNotNull()
    items = staged(items)
    open_ = items.where(~judged).select(key, text.alias("said")).dropDuplicates([key])
    items = items.join(lexicon.counted(open_, key, F.col("said"), words), key, "left")
    mood = lexicon.mood(F.coalesce("good", F.lit(0)), F.coalesce("bad", F.lit(0)))
    fallback = F.when(mood == "bullish", 0.7).when(mood == "bearish", -0.7).otherwise(0.0)
    return items.withColumn("judged", judged).withColumn("score", F.when(judged, of("impact", IMPACT) * of("direction", DIRECTION)).otherwise(fallback))


_SENTIMENT = f"count(*) AS n, {r('avg(score)')} AS mean, {r('greatest(-3.0, least(3.0, 2 * avg(score)))')} AS z, CASE WHEN bool_and(judged) THEN 0.7::DOUBLE WHEN bool_or(judged) THEN 0.5 ELSE 0.3 END AS confidence"


def sentiment(items: DataFrame) -> DataFrame:
    """Per ticker: items, mean score, the bounded z, and a confidence by how many were judged."""
    confidence = F.when(F.bool_and("judged"), 0.7).when(F.bool_or("judged"), 0.5).otherwise(0.3)
    return items.groupBy("ticker").agg(F.count("*").alias("n"), rounded(F.avg("score")).alias("mean"), rounded(clipped(2 * F.avg("score"))).alias("z"), confidence.alias("confidence"))


def newest(items: DataFrame, span: str, most: int, id_column: str) -> DataFrame:
    """The newest ``most`` items of each ticker within a span before the last item of all."""
    last = items.agg(F.max("published_at").alias("now"))
    recent = items.join(F.broadcast(last)).where(f"published_at > now - interval {span}").drop("now")  # one row
    return recent.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("published_at"), id_column))).where(F.col("k") <= most)


@query("s10_news_sentiment", f"""WITH {NEWS_SQL}, {LEARNED_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY published_at DESC, item_id) AS k FROM news WHERE published_at > (SELECT max(published_at) FROM news) - INTERVAL 24 HOUR),
  s AS (SELECT ticker, {_score_sql('headline')} FROM q, sides WHERE k <= 50) SELECT ticker, {_SENTIMENT} FROM s GROUP BY ticker""")  # fmt: skip
def s10_news_sentiment(spark, sf_dir):
    """Sentiment of each ticker's newest 50 stories of the last day."""
    return sentiment(scored(newest(news_items(spark, sf_dir), "24 hours", 50, "item_id"), "item_id", F.col("headline"), dictionary(spark, sf_dir)))


@query("s11_event_impact", f"""WITH {MACRO_SQL}, {LEARNED_SQL}, x AS (SELECT *, unnest(tickers) AS ticker FROM macro WHERE published_at > (SELECT max(published_at) FROM macro) - INTERVAL 7 DAY), q AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY published_at DESC, event_id) AS k FROM x),
  s AS (SELECT ticker, {lexicon.sql_event_class('author', 'title', 'body')} AS category, {_score_sql("title || ' ' || body")} FROM q, sides WHERE k <= 30) SELECT ticker, category, {_SENTIMENT} FROM s WHERE category <> 'other' GROUP BY ticker, category""")  # fmt: skip
def s11_event_impact(spark, sf_dir):
    """Political and geopolitical impact: each ticker's newest 30 events of a week, classed after they are picked."""
    x = macro_events(spark, sf_dir).withColumn("ticker", F.explode("tickers"))
    q = newest(x, "7 days", 30, "event_id").withColumn("category", lexicon.event_class(F.col("author"), F.col("title"), F.col("body"))).where("category <> 'other'")
    s = scored(q, "event_id", F.concat_ws(" ", "title", "body"), dictionary(spark, sf_dir))
    confidence = F.when(F.bool_and("judged"), 0.7).when(F.bool_or("judged"), 0.5).otherwise(0.3)
    return s.groupBy("ticker", "category").agg(F.count("*").alias("n"), rounded(F.avg("score")).alias("mean"), rounded(clipped(2 * F.avg("score"))).alias("z"), confidence.alias("confidence"))


@query("n7_event_study_net", """WITH b AS (SELECT user_id AS ticker, date_trunc('minute', ts) AS bar, avg(value) AS close FROM events GROUP BY ALL), m AS (SELECT bar, avg(close) AS close FROM b GROUP BY bar), e AS (SELECT event_id, user_id AS ticker, ts FROM events WHERE value IS NOT NULL),
  t AS (SELECT event_id, arg_min(close, bar) AS a, arg_max(close, bar) AS z, count(close) AS n FROM e JOIN b ON b.ticker = e.ticker AND bar >= ts AND bar <= ts + INTERVAL 60 MINUTE GROUP BY event_id),
  s AS (SELECT event_id, arg_min(close, bar) AS a, arg_max(close, bar) AS z, count(close) AS n FROM e JOIN m ON bar >= ts AND bar <= ts + INTERVAL 60 MINUTE GROUP BY event_id)
  SELECT t.event_id, round((t.z / t.a - 1) - (s.z / s.a - 1), 6) + 0.0 AS car, least(t.n, s.n) AS bars FROM t JOIN s USING (event_id) WHERE t.n >= 2 AND s.n >= 2 AND t.a <> 0 AND s.a <> 0""")  # fmt: skip
def n7_event_study_net(spark, sf_dir):
    """Return over the hour after each event less the market's: both legs are interval joins on the hour, the market's bars being one per minute."""
    e = table(spark, sf_dir, "events").where("value is not null")
    bars = e.groupBy(F.col("user_id").alias("ticker"), F.date_trunc("minute", "ts").alias("bar")).agg(F.avg("value").alias("close"))
    market = bars.groupBy("bar").agg(F.avg("close").alias("close"))
    hours = F.explode(F.array(F.date_trunc("hour", "ts"), F.date_trunc("hour", "ts") + F.expr("interval 1 hour")))
    ev = e.select("event_id", F.col("user_id").alias("ticker"), "ts", hours.alias("hour"))

    def leg(bars: DataFrame, keys: list[str]) -> DataFrame:
        j = ev.join(bars.withColumn("hour", F.date_trunc("hour", "bar")), [*keys, "hour"]).where("bar >= ts and bar <= ts + interval 60 minutes")
        g = j.groupBy("event_id").agg(F.min_by("close", "bar").alias("a"), F.max_by("close", "bar").alias("z"), F.count("close").alias("n")).where("n >= 2 and a <> 0")
        return g.select("event_id", (F.col("z") / F.col("a") - 1).alias("ret"), "n")

    own, base = leg(bars, ["ticker"]), leg(market, []).withColumnsRenamed({"ret": "base", "n": "m"})
    return own.join(base, "event_id").select("event_id", rounded(F.col("ret") - F.col("base")).alias("car"), F.least("n", "m").alias("bars"))


# -- alerts ---------------------------------------------------------------------------------------------------------


@query("n8_card_alerts", f"""WITH {FUSED}, nc AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, count(*) AS n_news FROM events GROUP BY ALL), w AS (SELECT date, ticker, max(z) FILTER (signal = 'reversal') AS gap, max(z) FILTER (signal = 'activity') AS act FROM sig GROUP BY ALL),
  c AS (SELECT f.date, f.ticker, {TIER} AS tier, lag({TIER}) OVER (PARTITION BY f.ticker ORDER BY f.date) AS before, gap, act, 100 * percent_rank() OVER (PARTITION BY f.date ORDER BY round(act, 9)) AS iv, coalesce(n_news, 0) AS n_news FROM fused f JOIN w USING (date, ticker) LEFT JOIN nc USING (date, ticker))
  SELECT date, ticker, unnest(list_filter([CASE WHEN before IS NOT NULL AND tier <> before THEN 'rating_change' END, CASE WHEN abs(gap) > 3.0 THEN 'gap_3sigma' END, CASE WHEN act IS NOT NULL AND iv > 90 THEN 'iv_spike' END, CASE WHEN n_news >= 10 THEN 'news_velocity' END], lambda x: x IS NOT NULL)) AS type FROM c""")  # fmt: skip
def n8_card_alerts(spark, sf_dir):
    """Alerts of a card beside the one before it: another rating, a gap beyond three sigmas, a volatility percentile over 90, ten news."""
    s = signals(spark, sf_dir)
    of = lambda name: F.max(F.when(F.col("signal") == name, F.col("z")))
    w = s.groupBy("date", "ticker").agg(of("reversal").alias("gap"), of("activity").alias("act"))
    news = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).agg(F.count("*").alias("n_news"))
    c = fused(spark, sf_dir).select("date", "ticker", tier(F.col("composite")).alias("tier")).join(w, ["date", "ticker"]).join(news, ["date", "ticker"], "left")
    c = c.withColumn("before", F.lag("tier").over(b.own())).withColumn("iv", 100 * F.percent_rank().over(b.day().orderBy(F.round("act", 9).asc_nulls_last())))
    kinds = [
        F.when(F.col("tier") != F.col("before"), "rating_change"), F.when(F.abs("gap") > 3.0, "gap_3sigma"),
        F.when(F.col("act").isNotNull() & (F.col("iv") > 90), "iv_spike"), F.when(F.coalesce("n_news", F.lit(0)) >= 10, "news_velocity"),
    ]
    return c.select("date", "ticker", F.explode(F.array_compact(F.array(*kinds))).alias("type"))


#: Alerts are all events: the kind by event type, facts from the value and id.
_KIND = "CASE event_type WHEN 'purchase' THEN 'rating_change' WHEN 'error' THEN 'gap_3sigma' WHEN 'view' THEN 'iv_spike' WHEN 'click' THEN 'news_velocity' ELSE 'score_spike' END"
_SEVERITY = """CASE kind WHEN 'rating_change' THEN CASE WHEN event_id % 5 IN (3, 4) THEN 'critical' ELSE 'warning' END WHEN 'gap_3sigma' THEN CASE WHEN value / 20 >= 4.0 THEN 'critical' ELSE 'warning' END
  WHEN 'iv_spike' THEN CASE WHEN value >= 95 THEN 'critical' ELSE 'warning' END WHEN 'news_velocity' THEN CASE WHEN value >= 30 THEN 'critical' WHEN value >= 20 THEN 'warning' ELSE 'info' END ELSE CASE WHEN value / 100 >= 0.35 THEN 'warning' ELSE 'info' END END"""
_POINTS = "CASE severity WHEN 'critical' THEN 25 WHEN 'warning' THEN 15 ELSE 5 END"
_FRESH = "CASE WHEN age <= 1 THEN 20 WHEN age <= 6 THEN 15 WHEN age <= 24 THEN 10 WHEN age <= 72 THEN 5 ELSE 0 END"
_SURE = "CASE WHEN event_id % 4 >= 3 THEN 15 WHEN event_id % 4 = 2 THEN 10 ELSE 5 END"
_RELEVANT = "CASE WHEN in_position THEN 'position' WHEN in_recommendation THEN 'recommendation' WHEN ticker IN (1, 2) THEN 'market' WHEN in_watchlist THEN 'watchlist' ELSE 'record' END"
_RELEVANCE = "CASE relevance WHEN 'position' THEN 40 WHEN 'recommendation' THEN 30 WHEN 'market' THEN 20 WHEN 'watchlist' THEN 15 ELSE 0 END"
TRIAGE = f"""{FUSED}, rk AS (SELECT ticker, row_number() OVER (ORDER BY round(composite, 9) DESC, ticker) AS n FROM fused WHERE date = (SELECT max(date) FROM fused)), pos AS (SELECT DISTINCT o_custkey % 150 + 1 AS ticker FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_custkey % 10 = 3),
  wl AS (SELECT DISTINCT c_custkey % 150 + 1 AS ticker FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey % 4 = 0), nw AS (SELECT max(ts) AS now FROM events),
  al AS (SELECT event_id, user_id AS ticker, value, {_KIND} AS kind, greatest(0, date_diff('microsecond', ts, now) / 3600000000.0) AS age, user_id IN (SELECT ticker FROM pos) AS in_position, user_id IN (SELECT ticker FROM rk WHERE n <= 50) AS in_recommendation, user_id IN (SELECT ticker FROM wl) AS in_watchlist FROM events, nw),
  a1 AS (SELECT *, {_SEVERITY} AS severity, {_RELEVANT} AS relevance FROM al), tri AS (SELECT *, least(100, {_RELEVANCE} + {_POINTS} + {_FRESH} + {_SURE}) AS score, age > 168 AS stale FROM a1)"""


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alert with its severity, relevance to positions, recommendations and watchlist, score and staleness."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("now"))
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3600000000.0
    al = e.join(F.broadcast(last)).select("event_id", F.col("user_id").alias("ticker"), "value", F.expr(_KIND).alias("kind"), F.greatest(age, F.lit(0.0)).alias("age"))  # one row
    latest = fused(spark, sf_dir)
    latest = latest.join(latest.agg(F.max("date").alias("date")), "date", "left_semi")
    top = latest.orderBy(F.round("composite", 9).desc(), "ticker").limit(50).select("ticker", F.lit(True).alias("in_recommendation"))
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT' and o_custkey % 10 = 3").select((F.col("o_custkey") % 150 + 1).alias("ticker")).distinct().withColumn("in_position", F.lit(True))
    watched = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY' and c_custkey % 4 = 0").select((F.col("c_custkey") % 150 + 1).alias("ticker")).distinct().withColumn("in_watchlist", F.lit(True))
    a = al.join(held, "ticker", "left").join(top, "ticker", "left").join(watched, "ticker", "left").fillna(False, ["in_position", "in_recommendation", "in_watchlist"])
    a = a.withColumn("severity", F.expr(_SEVERITY)).withColumn("relevance", F.expr(_RELEVANT))
    return a.withColumn("score", F.expr(f"least(100, {_RELEVANCE} + {_POINTS} + {_FRESH} + {_SURE})")).withColumn("stale", F.col("age") > 168)


@query("n10_triaged_alerts", f"WITH {TRIAGE} SELECT event_id, kind, severity, relevance, CAST(score AS INT) AS score, stale FROM tri")
def n10_triaged_alerts(spark, sf_dir):
    return triage(spark, sf_dir).select("event_id", "kind", "severity", "relevance", F.col("score").cast("int").alias("score"), "stale")


_STATE = "CASE WHEN event_id % 7 = 1 THEN 'resolved' WHEN event_id % 7 = 3 AND age < 48 THEN 'snoozed' ELSE 'open' END"


@query("n11_inbox_counts", f"""WITH {TRIAGE}, s AS (SELECT *, {_STATE} AS state FROM tri)
  SELECT ticker, count(*) FILTER (state = 'open' AND score >= 45) AS needs_action, count(*) FILTER (state = 'snoozed' OR state = 'open' AND score >= 25 AND score < 45) AS watch, count(*) FILTER (state = 'open' AND score < 25) AS record, count(*) FILTER (state = 'resolved') AS resolved,
    arg_max(event_id, (score, -age, event_id)) AS top_alert FROM s GROUP BY ticker""")  # fmt: skip
def n11_inbox_counts(spark, sf_dir):
    """Per ticker: open alerts by band of score, snoozed and resolved ones, and the first of the list. A snooze of two days that has run out is open."""
    s = triage(spark, sf_dir).withColumn("state", F.expr(_STATE))
    count = lambda c: F.count_if(F.expr(c))
    return s.groupBy("ticker").agg(
        count("state = 'open' and score >= 45").alias("needs_action"), count("state = 'snoozed' or state = 'open' and score >= 25 and score < 45").alias("watch"), count("state = 'open' and score < 25").alias("record"),
        count("state = 'resolved'").alias("resolved"), F.max_by("event_id", F.struct("score", -F.col("age"), "event_id")).alias("top_alert"),
    )


# -- upkeep ---------------------------------------------------------------------------------------------------------


#: Days that signals and news are kept.
KEPT = 10


@query("n12_retention", f"""WITH {PREDS}, {NEWS_SQL}, k AS (SELECT (SELECT max(date) FROM oc WHERE rating <> 'HOLD' AND extract('day' FROM date) <= 25) AS through, max(date) - {KEPT} AS cut FROM sig), n AS (SELECT max(published_at) - INTERVAL {KEPT} DAY AS cut FROM news)
  SELECT 'signals' AS kind, date, count(*) AS kept FROM sig, k WHERE through IS NULL OR NOT (date < cut AND date <= through) GROUP BY date UNION ALL SELECT 'news', CAST(published_at AS DATE), count(*) FROM news, n WHERE published_at >= n.cut GROUP BY ALL""")  # fmt: skip
def n12_retention(spark, sf_dir):
    """What stays of stored news and signals: old signals go only up to the date whose verdicts are stored, and none where nothing is.

    Tables are stored by date; dates leave by a new version of the table, and only then their folders go.
    """
    kept = DatedTable(spark, new_folder(spark, "signals"), "ticker long, date date, signal string, z double")
    kept.replace(signals(spark, sf_dir))
    known = DatedTable(spark, new_folder(spark, "verdicts"), "ticker long, date date, hit boolean")
    known.replace(v14_outcomes_fast_and_slow(spark, sf_dir).where(F.dayofmonth("date") <= 25))
    if kept.last() is not None:
        upkeep.prune(kept, known, kept.last(), KEPT)
    news = DatedTable(spark, new_folder(spark, "news"), "item_id long, published_at timestamp, date date")
    news.replace(news_items(spark, sf_dir).select("item_id", "published_at", F.to_date("published_at").alias("date")))
    last = news.read(since=news.last()).agg(F.max("published_at")).first()[0]
    if last is not None:
        upkeep.prune_items(news, "published_at", last - dt.timedelta(days=KEPT))
    left = lambda kind, t: t.read().groupBy("date").agg(F.count("*").alias("kept")).select(F.lit(kind).alias("kind"), "date", "kept")
    return left("signals", kept).unionByName(left("news", news))


JOBS = {"click": (24, 10), "error": (12, 4), "purchase": (48, 12), "view": (6, 2), "nightly": (24, 1)}


@query("n13_pipeline_health", f"""WITH rq AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {h}, {k})" for n, (h, k) in JOBS.items())}) v(name, cadence, required)), nw AS (SELECT max(ts) AS now FROM events),
  rn AS (SELECT event_type AS name, ts AS started, CASE WHEN event_id % 11 <> 0 THEN ts + INTERVAL 5 MINUTE END AS finished, value < 95 AS ok, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS errors FROM events)
  SELECT rq.name, max(finished) AS observed_at, coalesce(bool_and(ok) FILTER (started >= now - to_hours(cadence) AND finished IS NOT NULL), false) AS ok, CAST(coalesce(sum(errors) FILTER (started >= now - to_hours(cadence)), 0) AS BIGINT) AS errors,
    count(*) FILTER (started >= now - to_hours(cadence) AND finished IS NOT NULL) AS runs, any_value(required) AS required FROM rq CROSS JOIN nw LEFT JOIN rn USING (name) GROUP BY rq.name""")  # fmt: skip
def n13_pipeline_health(spark, sf_dir):
    """Each required job within its cadence: all runs right, errors, finished runs; a job that never ran stays in the list."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("now"))
    hours = F.coalesce(*[F.when(F.col("event_type") == n, F.lit(h)) for n, (h, _) in JOBS.items()])
    rn = e.join(F.broadcast(last)).where(F.col("event_type").isin(*JOBS)).withColumn("since", F.col("now") - F.make_dt_interval(F.lit(0), hours))  # one row
    finished = F.when(F.col("event_id") % 11 != 0, F.col("ts") + F.expr("interval 5 minutes"))
    late = F.col("ts") >= F.col("since")
    done = late & finished.isNotNull()
    g = rn.groupBy(F.col("event_type").alias("name")).agg(F.max(finished).alias("observed_at"), F.bool_and(F.when(done, F.col("value") < 95)).alias("ok"), F.sum(F.when(late & (F.col("event_id") % 3 == 0), 1).otherwise(0)).alias("errors"), F.count_if(done).alias("runs"))
    rq = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{n}', {k})" for n, (_, k) in JOBS.items()) + " AS t(name, required)")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rq.join(g, "name", "left").select("name", "observed_at", F.coalesce("ok", F.lit(False)).alias("ok"), zero("errors"), zero("runs"), "required")


_KNOWN = ["alpha", "beta", "gamma", "delta"]


@query("n14_source_freshness", f"""WITH {NEWS_SQL}, {MACRO_SQL}, u AS (SELECT source, published_at, impact IS NULL OR direction IS NULL AS backlog FROM news UNION ALL SELECT 'delta', published_at, impact IS NULL OR direction IS NULL FROM macro WHERE event_id % 3 = 0),
  nw AS (SELECT max(published_at) AS now FROM u), k AS (SELECT unnest([{", ".join(f"'{x}'" for x in _KNOWN)}, 'never']) AS source)
  SELECT k.source, max(published_at) AS last_at, count(*) FILTER (published_at > now - INTERVAL 24 HOUR) AS items_24h, count(*) FILTER (backlog) AS backlog FROM k CROSS JOIN nw LEFT JOIN u USING (source) GROUP BY k.source""")  # fmt: skip
def n14_source_freshness(spark, sf_dir):
    """Each known source's last item, items of the last day, and items that are not judged yet."""
    backlog = (F.col("impact").isNull() | F.col("direction").isNull()).alias("backlog")
    u = news_items(spark, sf_dir).select("source", "published_at", backlog).unionByName(macro_events(spark, sf_dir).where("event_id % 3 = 0").select(F.lit("delta").alias("source"), "published_at", backlog))
    u = u.join(F.broadcast(u.agg(F.max("published_at").alias("now"))))  # one row
    g = u.groupBy("source").agg(F.max("published_at").alias("last_at"), F.count_if(F.expr("published_at > now - interval 24 hours")).alias("items_24h"), F.count_if("backlog").alias("backlog"))
    known = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{x}')" for x in [*_KNOWN, "never"]) + " AS t(source)")
    return known.join(g, "source", "left").select("source", F.col("last_at").cast("timestamp_ntz").alias("last_at"), F.coalesce("items_24h", F.lit(0)).alias("items_24h"), F.coalesce("backlog", F.lit(0)).alias("backlog"))


_EPOCH = "CAST(epoch(date_trunc('second', published_at)) AS BIGINT)"


@query("n15_json_payloads", f"WITH {NEWS_SQL} SELECT upper(ticker) AS ticker, CAST(item_id AS VARCHAR) AS source_id, headline, url, {_EPOCH} AS published FROM news WHERE headline <> '' AND item_id % 13 <> 0")
def n15_json_payloads(spark, sf_dir):
    """Payloads as JSON lists of one ticker and day, read back: entries without an address or a headline go."""
    n = news_items(spark, sf_dir)
    url = F.when(F.col("item_id") % 13 != 0, F.col("url")).otherwise("")
    entry = F.struct(F.col("item_id").alias("id"), "headline", url.alias("url"), F.unix_seconds("published_at").alias("datetime"), F.lit(None).cast("string").alias("summary"))
    payloads = n.groupBy("ticker", "source", F.to_date("published_at").alias("day")).agg(F.to_json(F.collect_list(entry)).alias("payload"))
    items = feeds.read_json_payloads(payloads, F.lit("1970-01-01").cast("timestamp"))
    return items.select("ticker", "source_id", "headline", "url", F.unix_seconds("published_at").alias("published"))


@query("n15_rss_payloads", f"WITH {MACRO_SQL} SELECT CAST(event_id AS VARCHAR) AS source_id, 'title ' || event_id AS title, CAST(epoch(published_at) AS BIGINT) AS published FROM macro WHERE event_id % 9 <> 0 AND published_at >= TIMESTAMP '2024-01-03'")
def n15_rss_payloads(spark, sf_dir):
    """Payloads as RSS documents with RFC-822 times, read back: entries without a title or older than asked for go."""
    m = macro_events(spark, sf_dir)
    title = F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("title "), "event_id")).otherwise("")
    when = F.concat(F.lit("Mon, "), F.date_format("published_at", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>http://x/"), "event_id", F.lit("</link><guid>"), "event_id", F.lit("</guid><pubDate>"), when, F.lit("</pubDate><description>d</description></item>"))
    payloads = m.groupBy("author", F.to_date("published_at").alias("day")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("payload"))
    items = feeds.read_rss_payloads(payloads.withColumn("source", F.lit("rss")), F.lit("2024-01-03").cast("timestamp"), F.lit("1970-01-01").cast("timestamp"))
    return items.select("source_id", "title", F.unix_seconds("published_at").alias("published"))


@query("n16_news_of_sessions", f"""WITH {NEWS_SQL}, ss AS (SELECT DISTINCT CAST(ts AS DATE) AS session FROM events WHERE dayofweek(ts) BETWEEN 1 AND 5), f AS (SELECT ticker, CAST(published_at AS DATE) AS day FROM news)
  SELECT ticker, session, count(*) AS n FROM (SELECT ticker, (SELECT min(session) FROM ss WHERE session >= day) AS session FROM f) WHERE session IS NOT NULL GROUP BY ticker, session""")  # fmt: skip
def n16_news_of_sessions(spark, sf_dir):
    """News by the session whose day ends next: weekend news belongs to Monday. Dates find their session once, then news meet it by date."""
    n = news_items(spark, sf_dir).select("ticker", F.to_date("published_at").alias("date"))
    sessions = prices_daily(spark, sf_dir).select("date").distinct().where(~F.dayofweek("date").isin(1, 7)).select("date", F.col("date").alias("session"))
    days = n.select("date").distinct().join(sessions, "date", "full")
    following = F.first("session", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(0, Window.unboundedFollowing))
    return n.join(days.select("date", following.alias("session")).where("session is not null"), "date").groupBy("ticker", "session").agg(F.count("*").alias("n"))
