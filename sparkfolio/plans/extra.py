"""Further queries: membership, screening, outcomes, weights, alerts, ledgers and expression analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkfolio.operators import backtest as b
from sparkfolio.plans.backtests import BOOK, LIB, ORDINAL, factor_frame, library_returns
from sparkfolio.plans.common import query, rounded
from sparkfolio.plans.common import sql_rounded as r
from sparkfolio.plans.factors import LIBRARY, WT
from sparkfolio.plans.research import FUSED, SIG, TIER, fused, signals, tier
from sparkfolio.sources.market import PANEL_SQL, PRICES_SQL, panel, prices_daily, table
from sparkfolio.sources.tables import FILINGS_SQL, WEEKLY_SQL, WEIGHTS, filings, prices_weekly

# -- assembly ------------------------------------------------------------------------------------------------------

SNAPSHOTS = f"{WEEKLY_SQL}, snap AS (SELECT DISTINCT CAST(date_trunc('quarter', date) AS DATE) AS since, ticker FROM weekly WHERE volume > 30)"


@query("p5_index_membership", f"""WITH {SNAPSHOTS}, d AS (SELECT DISTINCT since FROM snap), o AS (SELECT since, lead(since) OVER (ORDER BY since) AS until FROM d)
  SELECT w.ticker, w.date FROM weekly w JOIN o ON (w.date >= o.since OR o.since = (SELECT min(since) FROM o)) AND (w.date < o.until OR o.until IS NULL) AND NOT (w.date < o.since AND o.since <> (SELECT min(since) FROM o))
  JOIN snap s ON s.since = o.since AND s.ticker = w.ticker""")  # fmt: skip
def p5_index_membership(spark, sf_dir):
    """Members by the latest snapshot at or before a date; earlier dates use the first snapshot.

    Dates are matched to snapshots once (few rows on both sides), and rows then meet members by equality.
    """
    w = prices_weekly(spark, sf_dir)
    snap = w.where("volume > 30").select(F.date_trunc("quarter", "date").cast("date").alias("since"), "ticker").distinct()
    days = w.select("date").distinct().select("date", F.lit(1).alias("side")).unionByName(snap.select(F.col("since").alias("date")).distinct().withColumn("side", F.lit(0)))
    line = Window.partitionBy(F.lit(0)).orderBy("date", "side")
    at = F.last(F.when(F.col("side") == 0, F.col("date")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(F.when(F.col("side") == 0, F.col("date"))).over(Window.partitionBy(F.lit(0)))
    days = days.withColumn("since", F.coalesce(at, first)).where("side = 1").select("date", "since")
    return w.select("ticker", "date").join(days, "date").join(snap, ["since", "ticker"], "left_semi").select("ticker", "date")


@query("p7_sparse_ticker_days", f"""WITH {PANEL_SQL}, x AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, sum(value) AS net, count(*) AS n FROM events WHERE value > 60 GROUP BY ALL)
  SELECT p.ticker, p.date, {r('net')} AS net, n FROM panel p LEFT JOIN x USING (ticker, date)""")  # fmt: skip
def p7_sparse_ticker_days(spark, sf_dir):
    x = table(spark, sf_dir, "events").where("value > 60").groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).agg(F.sum("value").alias("net"), F.count("*").alias("n"))
    return panel(spark, sf_dir).select("ticker", "date").join(x, ["ticker", "date"], "left").select("ticker", "date", rounded(F.col("net")).alias("net"), "n")


@query("io7_net_value_30_days", f"""WITH {FILINGS_SQL}, m AS (SELECT max(filing_date) AS d FROM filings), f AS (SELECT ticker, filing_id, sum(CASE WHEN filing_id % 2 = 0 THEN amount ELSE -amount END) AS net FROM filings, m WHERE filing_date > d - INTERVAL 30 DAY GROUP BY ALL)
  SELECT ticker, {r('sum(net)')} AS net, count(*) FILTER (net <> 0) AS n FROM f GROUP BY ticker""")  # fmt: skip
def io7_net_value_30_days(spark, sf_dir):
    f = filings(spark, sf_dir)
    last = f.agg(F.max("filing_date").alias("d"))
    near = f.join(F.broadcast(last)).where("filing_date > date_sub(d, 30)")  # one row
    files = near.groupBy("ticker", "filing_id").agg(F.sum(F.when(F.col("filing_id") % 2 == 0, F.col("amount")).otherwise(-F.col("amount"))).alias("net"))
    return files.groupBy("ticker").agg(rounded(F.sum("net")).alias("net"), F.count_if(F.col("net") != 0).alias("n"))


@query("io9_rebuild_quarters", f"""WITH {WEEKLY_SQL}, q AS (SELECT ticker, date, floor(volume / 50) AS field FROM weekly), c AS (SELECT *, lag(field) OVER w AS before, row_number() OVER w AS k FROM q WINDOW w AS (PARTITION BY ticker ORDER BY date))
  SELECT ticker, date AS period, CAST(date + INTERVAL 45 DAY AS DATE) AS filing_date, CAST(field AS DOUBLE) AS field FROM c WHERE k = 1 OR field IS DISTINCT FROM before""")  # fmt: skip
def io9_rebuild_quarters(spark, sf_dir):
    c = prices_weekly(spark, sf_dir).withColumn("field", F.floor(F.col("volume") / 50).cast("double"))
    c = c.withColumn("before", F.lag("field").over(b.own())).withColumn("k", F.row_number().over(b.own()))
    return c.where((F.col("k") == 1) | ~F.col("field").eqNullSafe(F.col("before"))).select("ticker", F.col("date").alias("period"), F.date_add("date", 45).alias("filing_date"), "field")


# -- screening -----------------------------------------------------------------------------------------------------


@query("k1_universe_filter", f"WITH {PRICES_SQL}, a AS (SELECT ticker, any_value(sector) AS sector, avg(close * volume) AS cap FROM prices GROUP BY ticker) SELECT ticker, sector, {r('cap')} AS cap FROM a WHERE lower(sector) = 's1' AND ticker NOT IN (6, 11) AND cap BETWEEN 1000 AND 1000000")
def k1_universe_filter(spark, sf_dir):
    a = prices_daily(spark, sf_dir).groupBy("ticker").agg(F.first("sector").alias("sector"), F.avg(F.col("close") * F.col("volume")).alias("cap"))
    return a.where((F.lower("sector") == "s1") & ~F.col("ticker").isin(6, 11) & F.col("cap").between(1000, 1000000)).withColumn("cap", rounded(F.col("cap")))


@query("k5_latest_scores", f"""WITH {FUSED}, l AS (SELECT ticker, max(date) AS date, last(composite ORDER BY date) AS composite FROM fused GROUP BY ticker),
  ds AS (SELECT DISTINCT date FROM prices ORDER BY date DESC LIMIT 3) SELECT ticker, date, {r('composite')} AS composite FROM l WHERE composite IS NOT NULL AND ticker IN (SELECT ticker FROM prices WHERE date IN (SELECT date FROM ds))""")  # fmt: skip
def k5_latest_scores(spark, sf_dir):
    l = fused(spark, sf_dir).groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("composite", "date").alias("composite")).where("composite is not null")
    p = prices_daily(spark, sf_dir).select("ticker", "date")
    alive = p.join(p.select("date").distinct().orderBy(F.desc("date")).limit(3), "date", "left_semi").select("ticker")
    return l.join(alive, "ticker", "left_semi").select("ticker", "date", rounded(F.col("composite")).alias("composite"))


@query("k6_priority_order", f"""WITH {FUSED}, l AS (SELECT ticker, abs(last(composite ORDER BY date)) AS size FROM fused GROUP BY ticker), t AS (SELECT DISTINCT ticker FROM prices)
  SELECT ticker, {r('size')} AS size FROM t LEFT JOIN l USING (ticker) ORDER BY size DESC NULLS LAST, ticker LIMIT 40 OFFSET 20""")  # fmt: skip
def k6_priority_order(spark, sf_dir):
    l = fused(spark, sf_dir).groupBy("ticker").agg(F.abs(F.max_by("composite", "date")).alias("size"))
    t = prices_daily(spark, sf_dir).select("ticker").distinct().join(l, "ticker", "left")
    return t.orderBy(F.desc_nulls_last("size"), "ticker").offset(20).limit(40).select("ticker", rounded(F.col("size")).alias("size"))


# -- fusion and weights --------------------------------------------------------------------------------------------

_CAPPED = "least(w, 0.35)"


@query("f2_capped_weights", f"WITH {SIG} SELECT date, ticker, {r(f'CAST(sum({_CAPPED} * z) AS DOUBLE)')} AS composite FROM sig WHERE confidence > 0 GROUP BY date, ticker")
def f2_capped_weights(spark, sf_dir):
    """Weights above the cap are cut, and what is cut off goes nowhere."""
    weight = F.coalesce(*[F.when(F.col("signal") == s, F.lit(min(x, 0.35))) for s, x in WEIGHTS.items()])
    return signals(spark, sf_dir).where("confidence > 0").groupBy("date", "ticker").agg(rounded(F.sum(weight * F.col("z"))).alias("composite"))


@query("v4_ewma_icir", f"""WITH {ORDINAL}, m AS (SELECT max(date) AS d FROM ic), e AS (SELECT ic, power(0.5, date_diff('day', date, d) / 30.0) AS w FROM ic, m), a AS (SELECT sum(w * ic) / sum(w) AS mean FROM e)
  SELECT {r('CASE WHEN count(*) >= 2 AND sqrt(sum(w * power(ic - mean, 2)) / sum(w)) > 1e-12 THEN any_value(mean) / sqrt(sum(w * power(ic - mean, 2)) / sum(w)) END')} AS icir FROM e, a""")  # fmt: skip
def v4_ewma_icir(spark, sf_dir):
    """Weighted moments in one aggregate: the spread comes from the weighted sums."""
    ic = b.ordinal_ic(factor_frame(spark, sf_dir))
    e = ic.join(F.broadcast(ic.agg(F.max("date").alias("d")))).withColumn("w", F.pow(F.lit(0.5), F.datediff("d", "date") / 30.0))  # one row
    e = e.withColumn("mean", F.sum(F.col("w") * F.col("ic")).over(Window.partitionBy("d")) / F.sum("w").over(Window.partitionBy("d")))
    return e.groupBy("d").agg(F.first("mean").alias("mean"), F.sqrt(F.sum(F.col("w") * F.pow(F.col("ic") - F.col("mean"), 2)) / F.sum("w")).alias("spread"), F.count("*").alias("n")).select(rounded(F.when((F.col("n") >= 2) & (F.col("spread") > 1e-12), F.col("mean") / F.col("spread"))).alias("icir"))


OUTCOMES = f"""{FUSED}, nx AS (SELECT date, ticker, lead(close, 1) OVER ({WT}) / nullif(close, 0) - 1 AS fwd FROM panel), c AS (SELECT date, ticker, {TIER} AS tier FROM fused),
  oc AS (SELECT date, ticker, CASE WHEN tier IN ('BUY', 'OW') THEN fwd > 0 ELSE fwd < 0 END AS hit FROM c JOIN nx USING (date, ticker) WHERE tier <> 'HOLD' AND fwd IS NOT NULL)"""


def outcomes(spark, sf_dir):
    ahead = panel(spark, sf_dir).select("date", "ticker", b.forward_return(1).alias("fwd"))
    c = fused(spark, sf_dir).withColumn("tier", tier(F.col("composite"))).where("tier <> 'HOLD'").join(ahead, ["date", "ticker"]).where("fwd is not null")
    return c.select("date", "ticker", F.when(F.col("tier").isin("BUY", "OW"), F.col("fwd") > 0).otherwise(F.col("fwd") < 0).alias("hit"))


@query("v14_directional_outcomes", f"WITH {OUTCOMES} SELECT date, ticker, hit FROM oc")
def v14_directional_outcomes(spark, sf_dir):
    return outcomes(spark, sf_dir)


@query("v16_hit_rate_windows", f"""WITH {OUTCOMES}, ds AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS age FROM (SELECT DISTINCT date FROM prices)), j AS (SELECT hit, age, CASE WHEN hit THEN 1.0 ELSE 0 END AS y, ticker FROM oc JOIN ds USING (date))
  SELECT ticker, {r('CASE WHEN count(*) FILTER (age <= 6) >= 3 THEN avg(y) FILTER (age <= 6) END')} AS d5, {r('CASE WHEN count(*) FILTER (age <= 22) >= 10 THEN avg(y) FILTER (age <= 22) END')} AS m1, {r('CASE WHEN count(*) >= 5 THEN avg(y) END')} AS hist FROM j GROUP BY ticker""")  # fmt: skip
def v16_hit_rate_windows(spark, sf_dir):
    days = prices_daily(spark, sf_dir).select("date").distinct()
    age = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("date")))
    j = outcomes(spark, sf_dir).join(days.withColumn("age", age), "date").withColumn("y", F.col("hit").cast("double"))

    def rate(most: int, least: int):
        y = F.when(F.col("age") <= most, F.col("y"))
        return rounded(F.when(F.count(y) >= least, F.avg(y)))

    return j.groupBy("ticker").agg(rate(6, 3).alias("d5"), rate(22, 10).alias("m1"), rate(10**6, 5).alias("hist"))


@query("v25_decay_alerts", f"""WITH {LIB}, i AS (SELECT factor_name, date, ret, row_number() OVER (PARTITION BY factor_name ORDER BY date DESC) AS k FROM lr),
  g AS (SELECT factor_name, max(ret) FILTER (k = 1) AS latest, avg(ret) FILTER (k > 1) AS earlier, count(*) AS n FROM i GROUP BY factor_name)
  SELECT factor_name, {r('latest')} AS latest, {r('earlier')} AS earlier, abs(earlier) >= 1e-6 AND 1 - latest / nullif(earlier, 0) > 0.5 AND latest > 0 AND earlier > 0 AS alert FROM g WHERE n >= 3""")  # fmt: skip
def v25_decay_alerts(spark, sf_dir):
    i = library_returns(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("factor_name").orderBy(F.desc("date"))))
    g = i.groupBy("factor_name").agg(F.max(F.when(F.col("k") == 1, F.col("ret"))).alias("x"), F.avg(F.when(F.col("k") > 1, F.col("ret"))).alias("y"), F.count("*").alias("n")).where("n >= 3")
    faded = (F.abs("y") >= 1e-6) & (1 - F.try_divide("x", "y") > 0.5) & (F.col("x") > 0) & (F.col("y") > 0)
    return g.select("factor_name", rounded(F.col("x")).alias("latest"), rounded(F.col("y")).alias("earlier"), faded.alias("alert"))


# -- alerts and ledgers --------------------------------------------------------------------------------------------

_SEVERITY = "CASE event_type WHEN 'purchase' THEN 40 WHEN 'error' THEN 35 ELSE 15 END"


@query("n10_alert_triage", f"""WITH m AS (SELECT max(ts) AS now FROM events), a AS (SELECT event_id, {_SEVERITY} AS severity, CASE WHEN user_id % 3 = 0 THEN 30 WHEN user_id % 3 = 1 THEN 15 ELSE 5 END AS relevance, date_diff('second', ts, now) / 3600.0 AS age FROM events, m)
  SELECT event_id, {r('least(100.0, severity + relevance + greatest(0.0, 20.0 - age / 12))')} AS score, age > 168 AS stale FROM a""")  # fmt: skip
def n10_alert_triage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("now"))
    kind = F.col("event_type")
    severity = F.when(kind == "purchase", 40).when(kind == "error", 35).otherwise(15)
    relevance = F.when(F.col("user_id") % 3 == 0, 30).when(F.col("user_id") % 3 == 1, 15).otherwise(5)
    age = (F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600.0
    a = e.join(F.broadcast(last)).select("event_id", (severity + relevance).alias("s"), age.alias("age"))  # one row
    score = F.least(F.lit(100.0), F.col("s") + F.greatest(F.lit(0.0), 20.0 - F.col("age") / 12))
    return a.select("event_id", rounded(score).alias("score"), (F.col("age") > 168).alias("stale"))


@query("l4_rebalance_dates", """WITH RECURSIVE d AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events)), r AS (SELECT date, k FROM d WHERE k = 1 UNION ALL SELECT d.date, d.k FROM r JOIN d ON d.k = r.k + 5) SELECT date FROM r""")
def l4_rebalance_dates(spark, sf_dir):
    """The first run, then each run five sessions or more after the chosen one: a fold over the calendar's one array."""
    days = prices_daily(spark, sf_dir).select("date").distinct().agg(F.array_sort(F.collect_set("date")).alias("days"))
    start = F.struct(F.array().cast("array<date>").alias("chosen"), F.lit(-5).alias("last"), F.lit(0).alias("k"))
    step = lambda acc, d: F.struct(
        F.when(acc["k"] - acc["last"] >= 5, F.concat(acc["chosen"], F.array(d))).otherwise(acc["chosen"]).alias("chosen"),
        F.when(acc["k"] - acc["last"] >= 5, acc["k"]).otherwise(acc["last"]).alias("last"),
        (acc["k"] + 1).alias("k"),
    )
    return days.select(F.explode(F.aggregate("days", start, step)["chosen"]).alias("date"))


@query("l12_account_equity", f"""WITH {PRICES_SQL}, held AS (SELECT o_custkey % 50 AS account, o_custkey % 150 + 1 AS ticker, sum(o_orderkey % 10 + 1) AS shares FROM orders GROUP BY ALL), p AS (SELECT ticker, last(close ORDER BY date) AS close FROM prices GROUP BY ticker)
  SELECT account, {r('sum(shares * coalesce(close, 10))')} AS equity, count(*) AS names FROM held LEFT JOIN p USING (ticker) GROUP BY account""")  # fmt: skip
def l12_account_equity(spark, sf_dir):
    held = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("account"), (F.col("o_custkey") % 150 + 1).alias("ticker")).agg(F.sum(F.col("o_orderkey") % 10 + 1).alias("shares"))
    p = prices_daily(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "date").alias("close"))
    value = F.col("shares") * F.coalesce("close", F.lit(10.0))
    return held.join(p, "ticker", "left").groupBy("account").agg(rounded(F.sum(value)).alias("equity"), F.count("*").alias("names"))


@query("b25_book_turnover", f"WITH {BOOK}, t AS (SELECT date, sum(abs(weight - coalesce(before, 0))) AS t FROM (SELECT *, lag(weight) OVER ({WT}) AS before FROM bk) GROUP BY date) SELECT {r('CAST(avg(t) AS DOUBLE)')} AS turnover FROM t")
def b25_book_turnover(spark, sf_dir):
    bk = b.book(factor_frame(spark, sf_dir)).withColumn("moved", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(b.own()), F.lit(0.0))))
    return bk.groupBy("date").agg(F.sum("moved").alias("t")).agg(rounded(F.avg("t")).alias("turnover"))


# -- expressions of the library: one row per factor and date that has it -------------------------------------------

_EXPR = " UNION ALL ".join(f"SELECT '{n}' AS factor_name, '{e}' AS expression" for n, (e, _) in LIBRARY.items())


def _expression():
    return F.coalesce(*[F.when(F.col("factor_name") == n, F.lit(e)) for n, (e, _) in LIBRARY.items()])


@query("m6_m7_signatures_and_families", f"""WITH {LIB}, ex AS ({_EXPR}) SELECT lr.factor_name, regexp_replace(regexp_replace(expression, '[0-9]+', 'N', 'g'), ' ', '', 'g') AS signature,
  CASE WHEN regexp_matches(expression, 'volume|adv') THEN 'activity' WHEN regexp_matches(expression, 'std') THEN 'risk' WHEN regexp_matches(expression, 'returns') THEN 'trend' ELSE 'price' END AS family, count(*) AS days, {r('avg(ret)')} AS mean_ret
  FROM lr JOIN ex USING (factor_name) GROUP BY ALL""")  # fmt: skip
def m6_m7_signatures_and_families(spark, sf_dir):
    e = F.col("expression")
    family = F.when(e.rlike("volume|adv"), "activity").when(e.rlike("std"), "risk").when(e.rlike("returns"), "trend").otherwise("price")
    x = library_returns(spark, sf_dir).withColumn("expression", _expression()).withColumn("signature", F.regexp_replace(F.regexp_replace("expression", "[0-9]+", "N"), " ", ""))
    return x.withColumn("family", family).groupBy("factor_name", "signature", "family").agg(F.count("*").alias("days"), rounded(F.avg("ret")).alias("mean_ret"))
