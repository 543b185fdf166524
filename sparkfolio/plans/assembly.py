"""Queries of stores, vendor tables, filings and quality reports, and of the screens built on panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkfolio.functions.staging import new_folder, staged
from sparkfolio.operators import backtest as b
from sparkfolio.operators.expression import evaluate
from sparkfolio.operators.joins import global_ordinal, next_after
from sparkfolio.plans.common import query, rounded
from sparkfolio.plans.common import sql_rounded as r
from sparkfolio.plans.factors import WT, full, w
from sparkfolio.plans.research import FUSED, SIG, fused, signals
from sparkfolio.sources import store
from sparkfolio.sources.market import PANEL_SQL, PRICES_SQL, panel, prices_daily, table
from sparkfolio.sources.tables import BARS_SQL, FILINGS_SQL, WEIGHTS, WPANEL_SQL, bars_weekly, filings, panel_weekly

# -- stores ---------------------------------------------------------------------------------------------------------


def _folder(spark) -> str:
    return new_folder(spark, "store")


@query("io1_universe_and_benchmark", f"WITH {BARS_SQL} SELECT u.ticker, u.date, u.close, m.close AS benchmark FROM wbars u LEFT JOIN wbars m ON m.ticker = 1 AND m.date = u.date WHERE u.ticker NOT IN (1, 2)")
def io1_universe_and_benchmark(spark, sf_dir):
    """A stored panel read with its benchmarks apart, and the first benchmark's close beside each row of the universe."""
    path = _folder(spark)
    bars_weekly(spark, sf_dir).write.parquet(path)
    universe, benchmarks = store.read_panel(spark, path, [1, 2])
    m = benchmarks.where("ticker = 1").select("date", F.col("close").alias("benchmark"))
    return universe.select("ticker", "date", "close").join(m, "date", "left").select("ticker", "date", "close", "benchmark")


@query("io2_ticker_cache", f"WITH {BARS_SQL} SELECT ticker, date, CASE WHEN date >= DATE '1999-06-01' THEN close + 1 ELSE close END AS close FROM wbars WHERE ticker IN (3, 4, 7) AND date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'")
def io2_ticker_cache(spark, sf_dir):
    """Bars written to a cache, later days written back over it with other closes, then some tickers and days read."""
    path = _folder(spark)
    bars = staged(bars_weekly(spark, sf_dir).select("ticker", "date", "close"))
    store.write_cache(bars, path)
    store.update_cache(spark, path, bars.where("date >= date'1999-06-01'").withColumn("close", F.col("close") + 1), staged)
    return store.read_cache(spark, path, [3, 4, 7], "1999-01-01", "1999-12-31").select("ticker", "date", "close")


@query("io3_membership_files", f"WITH {BARS_SQL} SELECT DISTINCT CAST(date_trunc('quarter', date) AS DATE) AS date, 'B-' || ticker AS ticker FROM wbars WHERE volume > 30")
def io3_membership_files(spark, sf_dir):
    """Snapshots written as CSV files of comma-joined symbols, and read back as one row per member."""
    path = _folder(spark)
    snap = bars_weekly(spark, sf_dir).where("volume > 30").select(F.date_trunc("quarter", "date").cast("date").alias("date"), F.concat(F.lit(" B."), "ticker").alias("t")).distinct()
    snap.groupBy("date").agg(F.array_join(F.collect_list("t"), ",").alias("tickers")).write.option("header", True).csv(path)
    return store.read_membership(spark, path)


@query("io4_vendor_schema", f"WITH {BARS_SQL} SELECT date, CAST(ticker AS VARCHAR) AS ticker, open, CASE WHEN ticker % 7 <> 0 THEN high END AS high, low, close, CAST(NULL AS DOUBLE) AS volume FROM wbars")
def io4_vendor_schema(spark, sf_dir):
    """A vendor's table of texts under names of its own, brought to the schema of prices; what is no number becomes null."""
    text = lambda c: F.col(c).cast("string")
    bad = F.when(F.col("ticker") % 7 != 0, text("high")).otherwise("n/a")
    vendor = bars_weekly(spark, sf_dir).select(text("date").alias("Trade Date"), text("ticker").alias("Symbol"), text("open").alias("Open"), bad.alias("High"), text("low").alias("Low"), text("close").alias("Adj.Close"), F.lit("x").alias("note"))
    return store.normalize(vendor, {"Trade Date": "date", "Symbol": "ticker", "Adj.Close": "close"})


@query("io5_upsert_merge", f"""WITH st AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, last(value ORDER BY ts, event_id) AS close FROM events WHERE event_id % 2 = 0 AND value > 0 GROUP BY ALL), nw AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, last(value ORDER BY ts, event_id) AS close FROM events WHERE event_id % 3 = 0 AND value > 5 GROUP BY ALL)
  SELECT ticker, date, coalesce(n.close, s.close) AS close FROM st s FULL JOIN nw n USING (ticker, date)""")  # fmt: skip
def io5_upsert_merge(spark, sf_dir):
    """New closes merged into stored ones; closes of five and less stand for refused ones here, sent as negative numbers."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"), F.col("value").alias("close"), "ts", "event_id")
    order = F.struct("ts", "event_id")
    stored = e.where("event_id % 2 = 0 and close > 0").groupBy("ticker", "date").agg(F.max_by("close", order).alias("close"))
    new = e.where("event_id % 3 = 0").withColumn("close", F.when(F.col("close") > 5, F.col("close")).otherwise(-1.0))
    return store.upsert(stored, new, order)


_CODE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'P' WHEN '2-HIGH' THEN 'S' WHEN '3-MEDIUM' THEN 'A' ELSE 'M' END"
_SIDE = "CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'D' ELSE 'X' END"


@query("io6_insider_forms", f"""WITH t AS (SELECT o_custkey % 150 + 1 AS ticker, CAST(o_orderdate AS DATE) AS date, {_CODE} AS code, CASE {_SIDE} WHEN 'A' THEN 1.0 WHEN 'D' THEN -1.0 ELSE 0 END * CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey % 100 + 1 END * CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_orderkey % 50 END AS dollars FROM orders)
  SELECT ticker, date, {r('CAST(sum(dollars) AS DOUBLE)')} AS net_dollars, count(*) FILTER (code = 'P') AS n_buys, count(*) FILTER (code = 'S') AS n_sells FROM t WHERE code IN ('P', 'S') AND dollars IS NOT NULL GROUP BY ticker, date""")  # fmt: skip
def io6_insider_forms(spark, sf_dir):
    """Forms as XML, several transactions each, read back to ticker-days; a transaction without a number of shares goes, one without a price is worth nothing."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}><value>"), value.cast("string"), F.lit(f"</value></{name}>"))
    shares = F.when(F.col("o_orderkey") % 17 == 0, "many").otherwise((F.col("o_orderkey") % 100 + 1).cast("string"))
    price = F.when(F.col("o_orderkey") % 13 == 0, F.lit("")).otherwise(tag("transactionPricePerShare", F.col("o_orderkey") % 50))
    one = F.concat(
        F.lit("<nonDerivativeTransaction>"), tag("transactionDate", F.to_date("o_orderdate")), F.lit("<transactionCoding><transactionCode>"), F.expr(_CODE), F.lit("</transactionCode></transactionCoding><transactionAmounts>"),
        tag("transactionShares", shares), price, tag("transactionAcquiredDisposedCode", F.expr(_SIDE)), F.lit("</transactionAmounts></nonDerivativeTransaction>"),
    )
    o = table(spark, sf_dir, "orders").withColumn("ticker", F.col("o_custkey") % 150 + 1).groupBy("ticker", (F.col("o_orderkey") % 40).alias("form"), F.year("o_orderdate").alias("y")).agg(F.array_join(F.collect_list(one), "").alias("body"))
    forms = o.select("ticker", F.concat(F.lit("<ownershipDocument><nonDerivativeTable>"), "body", F.lit("</nonDerivativeTable></ownershipDocument>")).alias("xml"))
    return store.insider_days(forms).withColumn("net_dollars", rounded(F.col("net_dollars")))


@query("io10_filing_dates", f"""WITH {FILINGS_SQL}, p AS (SELECT DISTINCT ticker, last_day(filing_date) AS period FROM filings), n AS (SELECT p.ticker, p.period, min(f.filing_date) AS first FROM p LEFT JOIN filings f ON f.ticker = p.ticker AND f.filing_date > p.period GROUP BY ALL)
  SELECT ticker, period, CASE WHEN first <= period + 120 THEN first ELSE period + 45 END AS filing_date FROM n""")  # fmt: skip
def io10_filing_dates(spark, sf_dir):
    """The first announcement after a period's end within 120 days, else 45 days after it."""
    f = filings(spark, sf_dir).select("ticker", "filing_date").distinct()  # a ticker's dates, however many statements they have
    periods = f.select("ticker", F.last_day("filing_date").alias("period")).distinct()
    n = next_after(periods, f, "ticker", "period", "filing_date", [])
    late = F.coalesce(F.datediff("filing_date", "period") <= 120, F.lit(False))
    return n.select("ticker", "period", F.when(late, F.col("filing_date")).otherwise(F.date_add("period", 45)).alias("filing_date"))


@query("p2_trailing_volumes", f"WITH {WPANEL_SQL} SELECT date, ticker, " + ", ".join(f"{r(full(n, f'avg(volume) {w(n)}'))} AS adv{n}" for n in (5, 10, 20, 60, 120, 180)) + " FROM wpanel")
def p2_trailing_volumes(spark, sf_dir):
    """Mean volume of the last 5 to 180 sessions, all over one sort of each ticker."""
    p = panel_weekly(spark, sf_dir).withColumn("rn", F.row_number().over(b.own()))
    return p.select("date", "ticker", *[rounded(F.when(F.col("rn") >= n, F.avg("volume").over(b.own().rowsBetween(-(n - 1), 0)))).alias(f"adv{n}") for n in (5, 10, 20, 60, 120, 180)])


@query("p9_calendar_guard", f"WITH {PRICES_SQL} SELECT date, count(*) AS n_rows, min(ticker) AS example FROM prices WHERE date NOT IN (SELECT CAST(d AS DATE) FROM (SELECT unnest(generate_series((SELECT min(date) FROM prices)::TIMESTAMP, (SELECT max(date) FROM prices)::TIMESTAMP, INTERVAL 1 DAY)) AS d) WHERE dayofweek(d) BETWEEN 1 AND 5) GROUP BY date")
def p9_calendar_guard(spark, sf_dir):
    """Dates of the panel that the exchange's sessions (here: weekdays) do not have."""
    p = prices_daily(spark, sf_dir).select("date", "ticker")
    span = p.agg(F.min("date").alias("a"), F.max("date").alias("z"))
    sessions = span.select(F.explode(F.sequence("a", "z")).alias("date")).where(~F.dayofweek("date").isin(1, 7))
    return p.join(sessions, "date", "left_anti").groupBy("date").agg(F.count("*").alias("n_rows"), F.min("ticker").alias("example"))


_RAW = {
    "ticker": "user_id", "moment": "date_trunc('hour', ts)", "day": "CAST(ts AS DATE)", "open": "CASE WHEN event_id % 97 = 0 THEN -1 ELSE value END", "high": "value * CASE WHEN event_id % 50 = 0 THEN 0.9 ELSE 1.1 END",
    "low": "value * CASE WHEN event_id % 60 = 0 THEN 1.05 ELSE 0.9 END", "close": "CASE WHEN event_id % 71 = 0 THEN NULL ELSE value END", "volume": "CAST(event_id % 40 AS DOUBLE)",
}
RULES = {
    "non_negative": ("error", "least(open, high, low, close, volume) < 0"), "open_above_high": ("error", "open > high"), "low_above_open": ("error", "low > open"), "volume_not_positive": ("warning", "volume <= 0"),
    "duplicate_time": ("error", "copies > 1"), "gap_over_5_days": ("warning", "gap > 5"), "missing_price": ("error", "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL"),
}


@query("p12_quality_rules", f"""WITH q AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _RAW.items())} FROM events), g AS (SELECT *, count(*) OVER (PARTITION BY ticker, moment) AS copies, date_diff('day', lag(day) OVER (PARTITION BY ticker ORDER BY moment, open, high), day) AS gap FROM q),
  s AS (SELECT ticker, {", ".join(f"count(*) FILTER ({c}) AS {n}" for n, (_, c) in RULES.items())} FROM g GROUP BY ticker), u AS ({" UNION ALL ".join(f"SELECT ticker, '{n}' AS rule, '{sev}' AS severity, {n} AS affected FROM s" for n, (sev, _) in RULES.items())})
  SELECT ticker, rule, severity, affected, affected = 0 AS passed, bool_and(affected = 0) OVER (PARTITION BY ticker) AS all_passed FROM u""")  # fmt: skip
def p12_quality_rules(spark, sf_dir):
    """Seven rules per ticker with the rows they affect, their severity, and whether all of them hold."""
    q = table(spark, sf_dir, "events").select(*[F.expr(e).alias(n) for n, e in _RAW.items()])
    history = Window.partitionBy("ticker").orderBy("moment", "open", "high")
    g = q.withColumn("copies", F.count("*").over(Window.partitionBy("ticker", "moment"))).withColumn("gap", F.datediff("day", F.lag("day").over(history)))
    s = g.groupBy("ticker").agg(*[F.count_if(F.expr(c)).alias(n) for n, (_, c) in RULES.items()])
    u = s.withColumn("all_passed", F.greatest(*RULES) == 0).unpivot(["ticker", "all_passed"], list(RULES), "rule", "affected")
    severity = F.coalesce(*[F.when(F.col("rule") == n, F.lit(sev)) for n, (sev, _) in RULES.items()])
    return u.select("ticker", "rule", severity.alias("severity"), "affected", (F.col("affected") == 0).alias("passed"), "all_passed")


# -- screens --------------------------------------------------------------------------------------------------------

STOCK = {"short": (12, 60), "long": (252, 126)}


def _stock_sql(name: str) -> str:
    m, s = STOCK[name]
    rank = lambda x: f"CASE WHEN {x} IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY {x} NULLS LAST, ticker) / CAST(count({x}) OVER (PARTITION BY date) AS DOUBLE) END"
    return f"{name}_l AS (SELECT date, ticker, {full(m, f'avg(returns) {w(m)}')} AS m, {full(s, f'stddev_pop(returns) {w(s)}')} AS s FROM wpanel), {name}_f AS (SELECT date, ticker, {rank('m')} - {rank('s')} AS v FROM {name}_l), {name}_d AS (SELECT ticker, v FROM {name}_f WHERE date = (SELECT max(date) FROM wpanel) AND v IS NOT NULL)"


@query("e4_stock_factors", f"WITH {WPANEL_SQL}, {_stock_sql('short')}, {_stock_sql('long')} " + " UNION ALL ".join(f"SELECT '{n}' AS horizon, ticker, {r('CASE WHEN stddev_pop(v) OVER () > 1e-12 THEN greatest(-3.0, least(3.0, (v - avg(v) OVER ()) / stddev_pop(v) OVER ())) ELSE 0 END')} AS z FROM {n}_d" for n in STOCK))
def e4_stock_factors(spark, sf_dir):
    """Both stock expressions at the last date, scored over the tickers; no spread gives zeros."""
    p = staged(panel_weekly(spark, sf_dir).select("date", "ticker", "returns"))
    last = p.agg(F.max("date").alias("date"))

    def at_last(name: str):
        m, s = STOCK[name]
        f = evaluate(p, f"subtract(rank(ts_mean(returns, {m})), rank(ts_std(returns, {s})))", out="v").join(last, "date", "left_semi").where("v is not null")
        spread = F.stddev_pop("v").over(b.day())
        z = F.when(spread > 1e-12, F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.col("v") - F.avg("v").over(b.day())) / spread))).otherwise(0.0)
        return f.select(F.lit(name).alias("horizon"), "ticker", rounded(z).alias("z"))

    return at_last("short").unionByName(at_last("long"))


SCREEN = {"momentum": ("long", 0.5), "reversal": ("long", 0.3), "activity": ("short_only", 0.2)}
METHODS = ("equal", "user", "ic")
_SIGN = "CASE signal " + " ".join(f"WHEN '{s}' THEN {-1 if d == 'short_only' else 1}" for s, (d, _) in SCREEN.items()) + " END"
_USER = "CASE signal " + " ".join(f"WHEN '{s}' THEN {x}" for s, (_, x) in SCREEN.items()) + " END"
SCREENED = f"""{SIG}, nx1 AS (SELECT date, ticker, lead(close, 1) OVER ({WT}) / nullif(close, 0) - 1 AS fwd1 FROM panel), ls AS (SELECT max(date) AS last FROM panel),
  rw AS (SELECT signal, ticker, {_SIGN} * z AS raw FROM sig, ls WHERE date = last AND ticker % 10 <> 0), sc AS (SELECT *, CASE WHEN count(raw) OVER g < 2 OR raw IS NULL THEN NULL WHEN stddev_samp(raw) OVER g > 1e-12 THEN (raw - avg(raw) OVER g) / stddev_samp(raw) OVER g ELSE 0 END AS zs FROM rw WINDOW g AS (PARTITION BY signal)),
  dk AS (SELECT signal, date, row_number() OVER (PARTITION BY signal, date ORDER BY z, ticker) AS a, row_number() OVER (PARTITION BY signal, date ORDER BY fwd1, ticker) AS f FROM sig JOIN nx1 USING (date, ticker) WHERE z IS NOT NULL AND fwd1 IS NOT NULL),
  di AS (SELECT signal, date, coalesce(CASE WHEN count(*) >= 3 AND stddev_pop(a) * stddev_pop(f) > 1e-12 THEN covar_pop(a, f) / (stddev_pop(a) * stddev_pop(f)) END, 0) AS ic FROM dk GROUP BY signal, date), wi AS (SELECT signal, avg(ic) AS ic FROM di, ls WHERE date >= last - 20 GROUP BY signal),
  wu AS (SELECT 'equal' AS method, signal, 1.0 / 3 AS wt FROM wi UNION ALL SELECT 'user', signal, {_USER} FROM wi UNION ALL SELECT 'ic', signal, greatest(ic, 0) FROM wi), wn AS (SELECT method, signal, CASE WHEN sum(wt) OVER (PARTITION BY method) > 0 THEN wt / sum(wt) OVER (PARTITION BY method) ELSE 1.0 / 3 END AS wt FROM wu),
  cp AS (SELECT method, ticker, sum(wt * coalesce(zs, 0)) AS composite FROM sc JOIN wn USING (signal) GROUP BY method, ticker HAVING count(zs) > 0)"""


def screen(spark, sf_dir):
    """method, ticker, signal, raw, zs, wt: the last date's screen by three ways of weighing, long form."""
    s = staged(signals(spark, sf_dir))
    p = panel(spark, sf_dir)
    last = p.agg(F.max("date").alias("last"))
    sign = F.coalesce(*[F.when(F.col("signal") == n, F.lit(-1 if d == "short_only" else 1)) for n, (d, _) in SCREEN.items()])
    rw = s.join(F.broadcast(last)).where("date = last and ticker % 10 <> 0").select("signal", "ticker", (sign * F.col("z")).alias("raw"))  # one row
    g = Window.partitionBy("signal")
    spread = F.stddev_samp("raw").over(g)
    zs = F.when((F.count("raw").over(g) >= 2) & F.col("raw").isNotNull(), F.when(spread > 1e-12, (F.col("raw") - F.avg("raw").over(g)) / spread).otherwise(0.0))
    sc = rw.withColumn("zs", zs)
    ahead = p.select("date", "ticker", b.forward_return(1).alias("fwd1")).where("fwd1 is not null")
    at = Window.partitionBy("signal", "date")
    dk = s.where("z is not null").join(ahead, ["date", "ticker"]).withColumn("a", F.row_number().over(at.orderBy("z", "ticker"))).withColumn("f", F.row_number().over(at.orderBy("fwd1", "ticker")))
    di = dk.groupBy("signal", "date").agg(F.coalesce(F.when(F.count("*") >= 3, b.correlation(F.col("a"), F.col("f"))), F.lit(0.0)).alias("ic"))
    wi = di.join(F.broadcast(last)).where("date >= date_sub(last, 20)").groupBy("signal").agg(F.avg("ic").alias("ic"))  # one row
    user = F.coalesce(*[F.when(F.col("signal") == n, F.lit(x)) for n, (_, x) in SCREEN.items()])
    wu = wi.select("signal", F.lit(1 / 3).alias("equal"), user.alias("user"), F.greatest("ic", F.lit(0.0)).alias("ic")).unpivot("signal", list(METHODS), "method", "wt")
    total = F.sum("wt").over(Window.partitionBy("method"))
    wn = wu.withColumn("wt", F.when(total > 0, F.col("wt") / total).otherwise(1 / 3))
    return sc.join(F.broadcast(wn), "signal")  # a row per signal and method


@query("k2_weighted_screen", f"WITH {SCREENED} SELECT method, ticker, {r('CAST(composite AS DOUBLE)')} AS composite FROM cp")
def k2_weighted_screen(spark, sf_dir):
    """Composite of three factors at the last date with equal, given and IC weights; a missing score counts 0 unless all miss."""
    m = screen(spark, sf_dir).groupBy("method", "ticker").agg(F.sum(F.col("wt") * F.coalesce("zs", F.lit(0.0))).alias("c"), F.count("zs").alias("n")).where("n > 0")
    return m.select("method", "ticker", rounded(F.col("c")).alias("composite"))


@query("k3_top_with_parts", f"""WITH {SCREENED}, t AS (SELECT method, ticker, composite, row_number() OVER (PARTITION BY method ORDER BY round(composite, 9) DESC, ticker) AS place FROM cp), p AS (SELECT method, ticker, string_agg(signal || ':' || round(coalesce(raw, 0), 4) || ':' || round(coalesce(zs, 0), 4), ',' ORDER BY signal) AS parts FROM sc JOIN wn USING (signal) GROUP BY method, ticker)
  SELECT method, place, ticker, {r('CAST(composite AS DOUBLE)')} AS composite, parts FROM t JOIN p USING (method, ticker) WHERE place <= 10""")  # fmt: skip
def k3_top_with_parts(spark, sf_dir):
    """The ten best names of each way of weighing, with each factor's raw value and score."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    part = F.struct("signal", F.concat_ws(":", "signal", (F.round(zero("raw"), 4) + 0.0).cast("string"), (F.round(zero("zs"), 4) + 0.0).cast("string")).alias("s"))
    m = screen(spark, sf_dir).groupBy("method", "ticker").agg(F.sum(F.col("wt") * zero("zs")).alias("c"), F.count("zs").alias("n"), F.array_sort(F.collect_list(part)).alias("p")).where("n > 0")
    place = F.row_number().over(Window.partitionBy("method").orderBy(F.round("c", 9).desc(), "ticker"))
    top = m.withColumn("place", place).where("place <= 10")
    return top.select("method", "place", "ticker", rounded(F.col("c")).alias("composite"), F.array_join(F.transform("p", lambda x: x["s"]), ",").alias("parts"))


_FAST = "ticker % 4 <> extract('day' FROM date) % 4"


@query("k5_ranked_picks", f"""WITH {FUSED}, fa AS (SELECT ticker, max(date) AS date, last(composite ORDER BY date) AS score, false AS partial FROM fused WHERE composite IS NOT NULL AND {_FAST} GROUP BY ticker),
  sl AS (SELECT ticker, max(date) AS date, last(score ORDER BY date) AS score, true AS partial FROM (SELECT ticker, date, sum(w * z) / sum(w) AS score FROM live WHERE signal <> 'activity' GROUP BY ticker, date) GROUP BY ticker),
  u AS (SELECT ticker, arg_max((score, partial), (date, NOT partial)) AS p, max(date) AS date FROM (SELECT * FROM fa UNION ALL SELECT * FROM sl) GROUP BY ticker), ds AS (SELECT min(date) AS since FROM (SELECT DISTINCT date FROM prices ORDER BY date DESC LIMIT 3)),
  a AS (SELECT ticker, date, p[1] AS score, p[2] AS partial FROM u WHERE ticker IN (SELECT ticker FROM prices, ds WHERE date >= since))
  SELECT ticker, date, {r('score')} AS score, partial, row_number() OVER (ORDER BY partial, round(score, 9) DESC, ticker) AS place FROM a ORDER BY place LIMIT 100""")  # fmt: skip
def k5_ranked_picks(spark, sf_dir):
    """The newest card of each ticker, full or partial, of tickers whose feed is alive; full ones come first, then the score."""
    cards = fused(spark, sf_dir).where("composite is not null").where(F.col("ticker") % 4 != F.dayofmonth("date") % 4).select("ticker", "date", F.col("composite").alias("score"), F.lit(False).alias("partial"))
    weight = F.coalesce(*[F.when(F.col("signal") == s, F.lit(x)) for s, x in WEIGHTS.items()])
    slow = signals(spark, sf_dir).where("confidence > 0 and signal <> 'activity'").groupBy("ticker", "date").agg((F.sum(weight * F.col("z")) / F.sum(weight)).alias("score")).withColumn("partial", F.lit(True))
    newest = F.max(F.struct("date", (~F.col("partial")).alias("whole"), "score"))
    u = cards.unionByName(slow).groupBy("ticker").agg(newest.alias("p")).select("ticker", "p.*")
    p = prices_daily(spark, sf_dir).select("ticker", "date")
    alive = p.join(p.select("date").distinct().orderBy(F.desc("date")).limit(3), "date", "left_semi").select("ticker")
    top = u.join(alive, "ticker", "left_semi").orderBy(F.desc("whole"), F.round("score", 9).desc(), "ticker").limit(100)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("whole"), F.round("score", 9).desc(), "ticker"))  # of a hundred rows
    return top.select("ticker", "date", rounded(F.col("score")).alias("score"), (~F.col("whole")).alias("partial"), place.alias("place"))


#: A slow policy beside the one in force: its weights and its core.
SLOW = {"momentum": 0.7, "reversal": 0.0, "activity": 0.3}
_SLOWW = "CASE signal " + " ".join(f"WHEN '{s}' THEN {x}" for s, x in SLOW.items()) + " END"


@query("k8_long_horizon_rank", f"""WITH {SIG}, ls AS (SELECT max(date) AS last FROM sig), lg AS (SELECT date, ticker, CASE WHEN rn >= 10 THEN avg(returns) OVER ({WT} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS m FROM panel), lz AS (SELECT ticker, date, CASE WHEN stddev_pop(m) OVER (PARTITION BY date) > 1e-12 THEN (m - avg(m) OVER (PARTITION BY date)) / stddev_pop(m) OVER (PARTITION BY date) END AS z_long FROM lg),
  s AS (SELECT s.ticker, signal, CASE WHEN signal = 'momentum' THEN z_long ELSE z END AS z, {_SLOWW} AS w FROM sig s JOIN ls ON s.date = last LEFT JOIN lz ON lz.ticker = s.ticker AND lz.date = s.date), lv AS (SELECT * FROM s WHERE w > 0 AND z IS NOT NULL),
  f AS (SELECT ticker, sum(w * z) / sum(w) * sqrt(sum(w)) AS score, sum(w) AS coverage FROM lv GROUP BY ticker) SELECT ticker, {r('CAST(score AS DOUBLE)')} AS score, {r('CAST(coverage AS DOUBLE)')} AS coverage, row_number() OVER (ORDER BY round(score, 9) DESC, ticker) AS place FROM f""")  # fmt: skip
def k8_long_horizon_rank(spark, sf_dir):
    """Cards of the last date fused anew: the factor's z is the long one (without it the factor drops out), under the slow policy's weights and coverage."""
    p = evaluate(panel(spark, sf_dir), "zscore(ts_mean(returns, 10))", out="z_long").select("date", "ticker", "z_long")
    s = signals(spark, sf_dir)
    cards = s.join(s.agg(F.max("date").alias("date")), "date", "left_semi").groupBy("date", "ticker").agg(F.collect_list(F.struct("signal", "z")).alias("breakdown")).join(p, ["date", "ticker"], "left")
    weight = lambda name: F.coalesce(*[F.when(name == n, F.lit(x)) for n, x in SLOW.items()], F.lit(0.0))
    swapped = F.transform("breakdown", lambda e: F.struct(F.when(e["signal"] == "momentum", F.col("z_long")).otherwise(e["z"]).alias("z"), weight(e["signal"]).alias("w")))
    live = F.filter(swapped, lambda e: (e["w"] > 0) & e["z"].isNotNull())
    fold = F.aggregate(live, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda acc, e: F.struct((acc["s"] + e["w"] * e["z"]).alias("s"), (acc["w"] + e["w"]).alias("w")))
    f = cards.select("ticker", fold.alias("f")).where("f.w > 0").select("ticker", (F.col("f.s") / F.col("f.w") * F.sqrt("f.w")).alias("score"), F.col("f.w").alias("coverage"))
    f = global_ordinal(f, None, [F.round("score", 9).desc(), "ticker"], "place")
    return f.select("ticker", rounded(F.col("score")).alias("score"), rounded(F.col("coverage")).alias("coverage"), "place")


# -- normalising and grades -----------------------------------------------------------------------------------------


@query("f7_universe_scores", f"""WITH {PANEL_SQL}, v AS (SELECT date, ticker, volume AS raw, ticker % 9 <> 0 AS trusted FROM panel WHERE volume IS NOT NULL), m AS (SELECT date, avg(raw) AS mu, stddev_pop(raw) AS sd FROM v WHERE trusted GROUP BY date)
  SELECT date, ticker, {r('CASE WHEN trusted AND sd > 1e-12 THEN greatest(-3.0, least(3.0, (raw - mu) / sd)) ELSE 0 END')} AS z FROM v LEFT JOIN m USING (date)""")  # fmt: skip
def f7_universe_scores(spark, sf_dir):
    """Raw values of a date as bounded scores; those without confidence take no part in mean and spread and score 0. Moments come from an aggregate per date, not from a window over it."""
    v = panel(spark, sf_dir).where("volume is not null").select("date", "ticker", F.col("volume").alias("raw"), (F.col("ticker") % 9 != 0).alias("trusted"))
    m = v.where("trusted").groupBy("date").agg(F.avg("raw").alias("mu"), F.stddev_pop("raw").alias("sd"))
    z = F.when(F.col("trusted") & (F.col("sd") > 1e-12), F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.col("raw") - F.col("mu")) / F.col("sd")))).otherwise(0.0)
    return v.join(m, "date", "left").select("date", "ticker", rounded(z).alias("z"))


#: Letters by score. Dimensions group signals; one without a live member can't be graded.
BANDS = [(1.5, "A+"), (1.0, "A"), (0.5, "B"), (0.0, "C+"), (-0.5, "C"), (-1.0, "D")]
DIMENSIONS = {"Momentum": ("momentum",), "Flow": ("activity", "reversal"), "Insider": ("insider",)}
_BAND = "CASE " + " ".join(f"WHEN round(v, 9) >= {c} THEN '{x}'" for c, x in BANDS) + " ELSE 'F' END"
_DIMS = " UNION ALL ".join(f"SELECT '{d}' AS dimension, '{s}' AS signal" for d, ms in DIMENSIONS.items() for s in ms)


@query("f8_graded_dimensions", f"""WITH {SIG}, lt AS (SELECT ticker, signal, arg_max(z, date) AS z FROM sig WHERE z IS NOT NULL GROUP BY ticker, signal), lv AS (SELECT signal FROM lt GROUP BY signal HAVING count(*) >= 20 AND stddev_pop(z) >= 1e-6), dm AS ({_DIMS}),
  d AS (SELECT dimension, ticker, avg(z) AS m FROM lt JOIN lv USING (signal) JOIN dm USING (signal) GROUP BY dimension, ticker), th AS (SELECT dimension, avg(m) AS mu, stddev_pop(m) AS sd FROM d GROUP BY dimension HAVING count(*) >= 20 AND stddev_pop(m) >= 1e-6),
  g AS (SELECT t.ticker, n.dimension, (m - mu) / sd AS v FROM (SELECT DISTINCT ticker FROM lt) t CROSS JOIN (SELECT DISTINCT dimension FROM dm) n LEFT JOIN d ON d.ticker = t.ticker AND d.dimension = n.dimension LEFT JOIN th ON th.dimension = n.dimension)
  SELECT ticker, dimension, CASE WHEN v IS NULL THEN '—' ELSE {_BAND} END AS grade FROM g""")  # fmt: skip
def f8_graded_dimensions(spark, sf_dir):
    """Letters per ticker and dimension from its latest signals: only signals that vary over the universe count, and dimensions are scored over it."""
    lt = signals(spark, sf_dir).where("z is not null").groupBy("ticker", "signal").agg(F.max_by("z", "date").alias("z"))
    lt = staged(lt)
    live = lt.groupBy("signal").agg(F.count("*").alias("n"), F.stddev_pop("z").alias("sd")).where("n >= 20 and sd >= 1e-6").select("signal")
    dims = F.coalesce(*[F.when(F.col("signal").isin(*ms), F.lit(d)) for d, ms in DIMENSIONS.items()])
    d = lt.join(live, "signal", "left_semi").withColumn("dimension", dims).groupBy("dimension", "ticker").agg(F.avg("z").alias("m"))
    th = d.groupBy("dimension").agg(F.avg("m").alias("mu"), F.stddev_pop("m").alias("sd"), F.count("*").alias("n")).where("n >= 20 and sd >= 1e-6")
    every = lt.select("ticker").distinct().withColumn("dimension", F.explode(F.array(*[F.lit(x) for x in DIMENSIONS])))
    g = every.join(d, ["ticker", "dimension"], "left").join(F.broadcast(th), "dimension", "left").withColumn("v", (F.col("m") - F.col("mu")) / F.col("sd"))  # a row per dimension
    grade = F.when(F.col("v").isNull(), "—")
    for cut, letter in BANDS:
        grade = grade.when(F.round("v", 9) >= cut, letter)
    return g.select("ticker", "dimension", grade.otherwise("F").alias("grade"))


# -- series dialect: elementwise with IEEE rules --------------------------------------------------------------------


@query("r12_ieee_elementwise", f"""WITH {PRICES_SQL}, q AS (SELECT date, ticker, close, open - close AS d, lag(close) OVER ({WT}) AS p FROM prices)
  SELECT date, ticker, CASE WHEN d = 0 THEN CASE WHEN close > 0 THEN 'inf' WHEN close < 0 THEN '-inf' ELSE 'nan' END END AS ratio_kind, {r('CASE WHEN d <> 0 THEN close / d END')} AS ratio, CASE WHEN p IS NULL OR p > 50 THEN close ELSE d END AS chosen, CASE WHEN p IS NULL THEN 0 WHEN close > p THEN 1 ELSE 0 END AS above, CASE WHEN p IS NULL THEN 0 WHEN close <= p THEN 1 ELSE 0 END AS at_most, {r('CASE WHEN d > 0 THEN ln(d) END')} AS log_d,
    {r('CASE WHEN d = 0 THEN 0 ELSE abs(d) * sign(d) END')} AS same FROM q""")  # fmt: skip
def r12_ieee_elementwise(spark, sf_dir):
    """Arithmetic of the series dialect: division by zero gives infinities, comparisons 0 or 1, and If with a missing test takes its first branch."""
    from sparkfolio.functions import series as s

    q = prices_daily(spark, sf_dir).withColumn("d", F.col("open") - F.col("close")).withColumn("p", F.lag("close").over(b.own()))
    ratio = s.ieee_divide(F.col("close"), F.col("d"))
    kind = F.when(F.isnan(ratio), "nan").when(ratio == float("inf"), "inf").when(ratio == float("-inf"), "-inf")
    finite = F.when(kind.isNull(), ratio)
    log = s.ieee_log(F.col("d"))
    return q.select(
        "date", "ticker", kind.alias("ratio_kind"), rounded(finite).alias("ratio"), s.ieee_if(s.compared(F.col("p") > 50, F.col("p")), F.col("close"), F.col("d")).alias("chosen"),
        s.compared(F.col("close") > F.col("p"), F.lit(0.0)).cast("int").alias("above"), s.compared(F.col("close") <= F.col("p"), F.lit(0.0)).cast("int").alias("at_most"),
        rounded(F.when((F.col("d") > 0), log)).alias("log_d"), rounded(F.abs("d") * F.signum("d")).alias("same"),
    )
