"""Queries of runs, forward books and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.staging import staged
from sparkfolio.operators import backtest as b
from sparkfolio.operators import books
from sparkfolio.plans.common import query, rounded
from sparkfolio.plans.common import sql_rounded as r
from sparkfolio.plans.validation import LEDGER, ledger
from sparkfolio.sources.market import prices_daily, table

_RUNS = """runs AS (SELECT o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderpriority < '4' THEN 'daily_close' ELSE 'intraday' END AS type, CASE WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'complete' END AS status,
  CASE WHEN o_custkey % 7 <> 0 THEN o_orderkey % 86400 END AS finished FROM orders)"""


@query("l1_canonical_runs", f"WITH {_RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY finished DESC NULLS LAST, run_id DESC) AS n FROM runs WHERE type = 'daily_close' AND status = 'complete') SELECT date, run_id FROM k WHERE n = 1")
def l1_canonical_runs(spark, sf_dir):
    """The newest complete run of each date, by one maximum per date; runs without an end come last."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority < '4' and o_orderstatus <> 'P'")
    finished = F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderkey") % 86400)
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.max_by("o_orderkey", F.struct(F.coalesce(finished, F.lit(-1)), "o_orderkey")).alias("run_id"))


MIN_ELIGIBLE, MIN_COVERAGE = 20, 0.95
GATES = f"""{LEDGER}, ep AS (SELECT l.*, p.close IS NOT NULL AS priced, l.eligible AND p.close IS NOT NULL AS ok FROM ld l LEFT JOIN prices p USING (date, ticker)),
  er AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY date ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, round(composite, 9) DESC, ticker) END AS rank FROM ep), gt AS (SELECT date, count(*) FILTER (ok) AS n_eligible, count(*) FILTER (eligible) AS candidates, bool_or(ticker = 1 AND priced) AS benchmark FROM er GROUP BY date),
  gr AS (SELECT date, n_eligible, CASE WHEN candidates > 0 THEN n_eligible / CAST(candidates AS DOUBLE) ELSE 0 END AS coverage, benchmark, dayofweek(date) IN (0, 6) AS stale FROM gt)"""


def snapshots(spark, sf_dir) -> DataFrame:
    """date, ticker, composite, tier, whole (enough signals), ok (and a close on the date) and rank over those."""
    p = prices_daily(spark, sf_dir).select("date", "ticker", F.lit(True).alias("priced"))
    s = ledger(spark, sf_dir).select("date", "ticker", "composite", "tier", F.col("eligible").alias("whole")).join(p, ["date", "ticker"], "left").withColumn("priced", F.coalesce("priced", F.lit(False)))
    s = s.withColumn("ok", F.col("whole") & F.col("priced"))
    rank = F.row_number().over(b.day().orderBy(F.desc("ok"), F.round("composite", 9).desc(), "ticker"))
    return s.withColumn("rank", F.when(F.col("ok"), rank))


@query("l2_run_gates", f"""WITH {GATES} SELECT date, n_eligible, {r('coverage')} AS coverage, array_to_string(list_filter([CASE WHEN n_eligible < {MIN_ELIGIBLE} THEN 'insufficient_eligible' END, CASE WHEN NOT benchmark THEN 'no_benchmark' END, CASE WHEN stale THEN 'stale_market_date' END, CASE WHEN coverage < {MIN_COVERAGE} THEN 'insufficient_price_coverage' END], lambda x: x IS NOT NULL), ',') AS reasons FROM gr""")
def l2_run_gates(spark, sf_dir):
    """Each run's eligible cards and coverage, and what keeps it from being complete (no reason: it is)."""
    g = snapshots(spark, sf_dir).groupBy("date").agg(F.count_if("ok").alias("n_eligible"), F.count_if("whole").alias("c"), F.bool_or((F.col("ticker") == 1) & F.col("priced")).alias("benchmark"))
    g = g.withColumn("coverage", F.when(F.col("c") > 0, F.col("n_eligible") / F.col("c")).otherwise(0.0))
    reasons = [
        F.when(F.col("n_eligible") < MIN_ELIGIBLE, "insufficient_eligible"), F.when(~F.col("benchmark"), "no_benchmark"),
        F.when(F.dayofweek("date").isin(1, 7), "stale_market_date"), F.when(F.col("coverage") < MIN_COVERAGE, "insufficient_price_coverage"),
    ]
    return g.select("date", "n_eligible", rounded(F.col("coverage")).alias("coverage"), F.array_join(F.array_compact(F.array(*reasons)), ",").alias("reasons"))


TOP_N, MAX_POSITION, COST = 10, 0.15, 10.0
PICKED = f"""{GATES}, pk0 AS (SELECT date, ticker, tier, rank, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN tier IN ('BUY', 'OW') THEN 0 ELSE 1 END, rank) AS place FROM er WHERE ok), pk AS (SELECT *, least(1.0 / count(*) OVER (PARTITION BY date), {MAX_POSITION}) AS weight FROM pk0 WHERE place <= {TOP_N})"""


def picked(spark, sf_dir, top_n: int = TOP_N) -> DataFrame:
    """date, ticker, tier, rank, place, weight: eligible names, the two upper tiers first, then by rank; unused weight stays cash."""
    s = snapshots(spark, sf_dir).where("ok")
    place = F.row_number().over(b.day().orderBy(F.when(F.col("tier").isin("BUY", "OW"), 0).otherwise(1), "rank"))
    k = s.withColumn("place", place).where(F.col("place") <= top_n)
    return k.withColumn("weight", F.least(1 / F.count("*").over(b.day()), F.lit(MAX_POSITION))).select("date", "ticker", "tier", "rank", "place", "weight")


@query("l3_select_eligible", f"WITH {PICKED} SELECT date, ticker, tier, rank, place, {r('CAST(weight AS DOUBLE)')} AS weight FROM pk")
def l3_select_eligible(spark, sf_dir):
    return picked(spark, sf_dir).withColumn("weight", rounded(F.col("weight")))


EVERY = 5
FILLS = f"""{PICKED}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM prices)), rb AS (SELECT date, nxt AS fill_date, coalesce(lead(nxt) OVER (ORDER BY date), (SELECT max(date) FROM cal)) AS mark_date FROM cal WHERE k % {EVERY} = 0 AND nxt IS NOT NULL),
  fo AS (SELECT pk.date, pk.ticker, pk.weight, rb.fill_date, rb.mark_date, p.close AS fill_price FROM pk JOIN rb USING (date) LEFT JOIN prices p ON p.ticker = pk.ticker AND p.date = rb.fill_date)"""


def periods(spark, sf_dir) -> DataFrame:
    """date, fill_date, mark_date of every fifth session: filled the session after, marked when the next book is filled."""
    line = Window.partitionBy(F.lit(0)).orderBy("date")
    cal = prices_daily(spark, sf_dir).select("date").distinct().withColumn("k", F.row_number().over(line) - 1).withColumn("fill_date", F.lead("date").over(line)).withColumn("last", F.max("date").over(Window.partitionBy(F.lit(0))))
    rb = cal.where((F.col("k") % EVERY == 0) & F.col("fill_date").isNotNull())
    return rb.select("date", "fill_date", F.coalesce(F.lead("fill_date").over(line), "last").alias("mark_date"))


def fills(spark, sf_dir, top_n: int = TOP_N) -> DataFrame:
    px = prices_daily(spark, sf_dir).select("ticker", F.col("date").alias("fill_date"), F.col("close").alias("fill_price"))
    return picked(spark, sf_dir, top_n).join(F.broadcast(periods(spark, sf_dir)), "date").join(px, ["ticker", "fill_date"], "left")  # one row per fifth session


@query("l5_book_fills", f"WITH {FILLS} SELECT date, ticker, fill_date, fill_price, CASE WHEN fill_price IS NULL THEN 'unfilled' ELSE 'filled' END AS status, CASE WHEN fill_price IS NULL THEN 'dead_feed_at_fill' END AS reason FROM fo")
def l5_book_fills(spark, sf_dir):
    """A book's orders at the next session's close; a name without one is unfilled, with the reason."""
    missing = F.col("fill_price").isNull()
    return fills(spark, sf_dir).select("date", "ticker", "fill_date", "fill_price", F.when(missing, "unfilled").otherwise("filled").alias("status"), F.when(missing, "dead_feed_at_fill").alias("reason"))


MARKS = f"""{FILLS}, mkt AS (SELECT date, avg(close) AS level, sum(close * volume) / sum(volume) AS weighted FROM prices GROUP BY date),
  mp AS (SELECT fo.*, m.close AS mark_price FROM fo LEFT JOIN prices m ON m.ticker = fo.ticker AND m.date = fo.mark_date WHERE fill_price IS NOT NULL),
  pe AS (SELECT date, fill_date, mark_date, coalesce(sum(weight * (mark_price / nullif(fill_price, 0) - 1)), 0) AS gross, sum(weight) AS turnover, count(mark_price) AS n_positions, count(*) - count(mark_price) AS missing FROM mp GROUP BY ALL),
  pr AS (SELECT pe.*, gross - 2 * {COST} / 10000 * turnover AS net, z.weighted / a.weighted - 1 AS spy, z.level / a.level - 1 AS rsp FROM pe JOIN mkt a ON a.date = fill_date JOIN mkt z ON z.date = mark_date)"""


def marked(spark, sf_dir) -> DataFrame:
    """date, fill_date, mark_date, gross, turnover, n_positions, missing, net, spy, rsp per period; a name without a mark adds nothing."""
    p = prices_daily(spark, sf_dir)
    px = p.select("ticker", F.col("date").alias("mark_date"), F.col("close").alias("mark_price"))
    m = fills(spark, sf_dir).where("fill_price is not null").join(px, ["ticker", "mark_date"], "left")
    ret = F.when(F.col("fill_price") != 0, F.col("mark_price") / F.col("fill_price") - 1)
    pe = m.groupBy("date", "fill_date", "mark_date").agg(F.coalesce(F.sum(F.col("weight") * ret), F.lit(0.0)).alias("gross"), F.sum("weight").alias("turnover"), F.count("mark_price").alias("n_positions"), (F.count("*") - F.count("mark_price")).alias("missing"))
    mkt = staged(p.groupBy("date").agg(F.avg("close").alias("level"), (F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("weighted")))
    at = lambda d: mkt.select(F.col("date").alias(f"{d}_date"), F.col("level").alias(f"{d}_l"), F.col("weighted").alias(f"{d}_w"))
    pr = pe.join(at("fill"), "fill_date").join(at("mark"), "mark_date")
    return pr.withColumn("net", F.col("gross") - 2 * COST / 10_000 * F.col("turnover")).withColumn("spy", F.try_divide("mark_w", "fill_w") - 1).withColumn("rsp", F.try_divide("mark_l", "fill_l") - 1)


_MARKS = ["gross", "turnover", "net", "spy", "rsp"]


@query("l6_marked_periods", f"WITH {MARKS} SELECT date, fill_date, mark_date, n_positions, missing, {', '.join(f'{r(f'CAST({c} AS DOUBLE)')} AS {c}' for c in _MARKS)} FROM pr")
def l6_marked_periods(spark, sf_dir):
    """Each period's return before and after both sides' costs, beside two benchmarks over the same days."""
    return marked(spark, sf_dir).select("date", "fill_date", "mark_date", "n_positions", "missing", *[rounded(F.col(c)).alias(c) for c in _MARKS])


@query("l7_share_book")
def l7_share_book(spark, sf_dir):
    """Continuous books of whole shares, of three sizes: a strategy's targets and the prices of all names it ever picked are one small group."""
    sizes = (5, 10, 15)
    cal = periods(spark, sf_dir)
    px = prices_daily(spark, sf_dir).select("ticker", F.col("date").alias("fill_date"), F.col("close").alias("price"))
    largest = staged(picked(spark, sf_dir, max(sizes)).select("date", "ticker", "place").join(F.broadcast(cal.select("date", "fill_date")), "date"))  # one row per fifth session
    orders = largest.withColumn("strategy", F.explode(F.array(*[F.lit(n) for n in sizes]))).where("place <= strategy")
    orders = orders.withColumn("weight", F.least(1 / F.count("*").over(Window.partitionBy("strategy", "date")), F.lit(MAX_POSITION)))
    names = orders.select("strategy", "ticker").distinct()
    frame = names.join(px.join(F.broadcast(cal.select("fill_date")), "fill_date", "left_semi"), "ticker").join(orders.select("strategy", "ticker", "fill_date", "weight"), ["strategy", "ticker", "fill_date"], "full")

    def run(key, pdf):
        out = books.share_book(pdf)
        out.insert(0, "strategy", key[0])
        return out

    schema = "strategy int, fill_date date, cash double, nav double, ret double, turnover double, fees double, unfilled long, n_positions long, cumulative double"
    return frame.select("strategy", "ticker", "fill_date", "weight", "price").groupBy("strategy").applyInPandas(run, schema)


_BPS = (5, 10, 20)


@query("l8_book_summary", f"""WITH {MARKS}, c AS (SELECT *, product(1 + net) OVER o AS nv FROM pr WINDOW o AS (ORDER BY date ROWS UNBOUNDED PRECEDING)), d AS (SELECT *, nv / greatest(max(nv) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 1) - 1 AS fall FROM c)
  SELECT count(*) AS n_periods, {r('product(1 + net) - 1')} AS net_total, {r('product(1 + spy) - 1')} AS spy_total, {r('product(1 + rsp) - 1')} AS rsp_total, {r('CASE WHEN count(*) >= 2 AND var_pop(spy) > 1e-18 THEN covar_pop(net, spy) / var_pop(spy) END')} AS beta, {r('least(min(fall), 0)')} AS drawdown,
    {", ".join(f"{r(f'product(1 + gross - 2 * {x}.0 / 10000 * turnover) - 1')} AS net_{x}bps" for x in _BPS)} FROM d""")  # fmt: skip
def l8_book_summary(spark, sf_dir):
    """The book's compounded return beside the benchmarks', its beta and drawdown, and what other costs would leave."""
    line = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    c = marked(spark, sf_dir).withColumn("nv", F.product(1 + F.col("net")).over(line))
    d = c.withColumn("fall", F.col("nv") / F.greatest(F.max("nv").over(line), F.lit(1.0)) - 1)
    grow = lambda x: rounded(F.product(1 + x) - 1)
    beta = F.when((F.count("*") >= 2) & (F.var_pop("spy") > 1e-18), F.covar_pop("net", "spy") / F.var_pop("spy"))
    costs = [grow(F.col("gross") - 2 * x / 10_000 * F.col("turnover")).alias(f"net_{x}bps") for x in _BPS]
    return d.agg(F.count("*").alias("n_periods"), grow(F.col("net")).alias("net_total"), grow(F.col("spy")).alias("spy_total"), grow(F.col("rsp")).alias("rsp_total"), rounded(beta).alias("beta"), rounded(F.least(F.min("fall"), F.lit(0.0))).alias("drawdown"), *costs)


@query("l8_sector_exposure", f"WITH {PICKED} SELECT date, 'S' || (ticker % 5) AS sector, count(*) AS names, {r('CAST(sum(weight) AS DOUBLE)')} AS weight FROM pk GROUP BY ALL")
def l8_sector_exposure(spark, sf_dir):
    return picked(spark, sf_dir).groupBy("date", F.concat(F.lit("S"), F.col("ticker") % 5).alias("sector")).agg(F.count("*").alias("names"), rounded(F.sum("weight")).alias("weight"))


ACCOUNTS = 50


def account_fills(spark, sf_dir) -> DataFrame:
    """Orders of accounts with their fill prices: order_id, account, ticker, side, qty, price."""
    o = table(spark, sf_dir, "orders")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 28).cast("int"))
    orders = o.select(F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % ACCOUNTS).alias("account"), (F.col("o_custkey") % 150 + 1).alias("ticker"), F.when(F.col("o_orderstatus") == "O", "sell").otherwise("buy").alias("side"), (F.col("o_orderkey") % 40 + 1).alias("qty"), day.alias("date"))
    px = prices_daily(spark, sf_dir).select("ticker", "date", F.col("close").alias("price"))
    return orders.join(px, ["ticker", "date"], "left").drop("date")


def account_book(spark, sf_dir) -> DataFrame:
    """:func:`books.apply_fills` per account."""
    rows = account_fills(spark, sf_dir)

    def run(key, pdf):
        out = books.apply_fills(pdf)
        out.insert(0, "account", key[0])
        return out

    return rows.groupBy("account").applyInPandas(run, "account long, order_id long, ticker long, status string, realized double, cash double, position long, mean_cost double")


@query("l11_applied_fills")
def l11_applied_fills(spark, sf_dir):
    """Fills applied to accounts in the order of their ids: cash, shares, mean cost and realized gains after each."""
    a = account_book(spark, sf_dir)
    return a.select("account", "order_id", "ticker", "status", *[rounded(F.col(c)).alias(c) for c in ("realized", "cash", "mean_cost")], "position")


@query("l12_account_days")
def l12_account_days(spark, sf_dir):
    """Each account at the end: cash, value of what is held (at the last close, else at cost), realized and unrealized gains, the benchmark from 100."""
    a = staged(account_book(spark, sf_dir))
    last = a.groupBy("account", "ticker").agg(F.max_by(F.struct("position", "mean_cost"), "order_id").alias("p")).select("account", "ticker", "p.*").where("position > 0")
    p = prices_daily(spark, sf_dir)
    close = p.groupBy("ticker").agg(F.max_by("close", "date").alias("close"))
    price = F.coalesce("close", "mean_cost")
    held = last.join(close, "ticker", "left").groupBy("account").agg(F.sum(price * F.col("position")).alias("held"), F.sum((price - F.col("mean_cost")) * F.col("position")).alias("unrealized"), F.count("*").alias("names"))
    own = a.groupBy("account").agg(F.max_by("cash", "order_id").alias("cash"), F.sum("realized").alias("realized"))
    level = p.groupBy("date").agg(F.avg("close").alias("level"))
    bench = level.agg((F.try_divide(F.max_by("level", "date"), F.min_by("level", "date")) * 100).alias("benchmark"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    j = own.join(held, "account", "left").join(F.broadcast(bench))  # one row
    return j.select("account", rounded(F.col("cash")).alias("cash"), rounded(F.col("cash") + zero("held")).alias("equity"), rounded(zero("unrealized")).alias("unrealized"), rounded(F.col("realized")).alias("realized"), F.coalesce("names", F.lit(0)).alias("names"), rounded(F.col("benchmark")).alias("benchmark"))


@query("l13_attribution", f"""WITH prices0 AS (SELECT user_id AS ticker, last(value ORDER BY CAST(ts AS DATE), ts, event_id) AS close FROM events GROUP BY user_id), pos AS (SELECT user_id AS ticker, count(*) AS qty, avg(value) AS cost FROM events WHERE event_type = 'purchase' GROUP BY user_id),
  tr AS (SELECT o_custkey % 200 + 1 AS ticker, count(*) AS trades, count(*) FILTER (o_orderstatus = 'O') AS sells, count(*) FILTER (o_orderpriority = '1-URGENT') AS from_recommendation, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice / 1000 ELSE 0 END) AS realized FROM orders GROUP BY ALL)
  SELECT coalesce(pos.ticker, tr.ticker) AS ticker, coalesce(qty, 0) AS qty, {r('coalesce((close - cost) * qty, 0)')} AS unrealized, {r('coalesce(realized, 0)')} AS realized, {r('coalesce((close - cost) * qty, 0) + coalesce(realized, 0)')} AS total, coalesce(trades, 0) AS trades, coalesce(sells, 0) AS sells, coalesce(from_recommendation, 0) AS from_recommendation
  FROM pos LEFT JOIN prices0 USING (ticker) FULL JOIN tr ON tr.ticker = pos.ticker""")  # fmt: skip
def l13_attribution(spark, sf_dir):
    """Gains per ticker from what is held and what was traded, and where its orders came from: a full outer join of both."""
    e = table(spark, sf_dir, "events")
    close = e.groupBy(F.col("user_id").alias("ticker")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    pos = e.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("ticker")).agg(F.count("*").alias("qty"), F.avg("value").alias("cost")).join(close, "ticker", "left")
    sold = F.col("o_orderstatus") == "O"
    tr = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 200 + 1).alias("ticker")).agg(F.count("*").alias("trades"), F.count_if(sold).alias("sells"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("from_recommendation"), F.sum(F.when(sold, F.col("o_totalprice") / 1000).otherwise(0.0)).alias("realized"))
    open_gain, closed = F.coalesce((F.col("close") - F.col("cost")) * F.col("qty"), F.lit(0.0)), F.coalesce("realized", F.lit(0.0))
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return pos.join(tr, "ticker", "full").select("ticker", count("qty"), rounded(open_gain).alias("unrealized"), rounded(closed).alias("realized"), rounded(open_gain + closed).alias("total"), count("trades"), count("sells"), count("from_recommendation"))


@query("l15_run_turnover", f"""WITH {GATES}, ds AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM er WHERE rank IS NOT NULL)), tp AS (SELECT date, ticker, tier FROM er WHERE rank <= 50),
  j AS (SELECT coalesce(a.date, z.date) AS date, a.ticker AS cur, z.ticker AS prv, a.tier AS tn, z.tier AS tb FROM (SELECT tp.* FROM tp JOIN ds USING (date) WHERE before IS NOT NULL) a FULL JOIN (SELECT ds.date, tp.ticker, tp.tier FROM tp JOIN ds ON ds.before = tp.date) z ON a.date = z.date AND a.ticker = z.ticker)
  SELECT date, count(*) FILTER (prv IS NULL) AS added, count(*) FILTER (cur IS NULL) AS removed, count(*) FILTER (tn <> tb) AS changed, {r('count(*) FILTER (prv IS NULL) / nullif(CAST(count(cur) AS DOUBLE), 0)')} AS turnover FROM j GROUP BY date""")  # fmt: skip
def l15_run_turnover(spark, sf_dir):
    """Names added to, gone from and re-rated within the top fifty of each run against the run before; the first run has none."""
    s = staged(snapshots(spark, sf_dir).where("rank is not null").select("date", "ticker", "tier", "rank"))
    ds = s.select("date").distinct().withColumn("before", F.lag("date").over(Window.partitionBy(F.lit(0)).orderBy("date"))).where("before is not null")
    top = s.where(F.col("rank") <= 50)
    now = top.join(F.broadcast(ds), "date").select("date", "ticker", F.col("tier").alias("tn"), F.lit(1).alias("a"))  # a row per date
    then = top.select(F.col("date").alias("before"), "ticker", F.col("tier").alias("tb")).join(F.broadcast(ds), "before").select("date", "ticker", "tb", F.lit(1).alias("z"))  # a row per date
    g = now.join(then, ["date", "ticker"], "full").groupBy("date").agg(F.count_if(F.col("z").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("removed"), F.count_if(F.col("tn") != F.col("tb")).alias("changed"), F.count("a").alias("n"))
    return g.select("date", "added", "removed", "changed", rounded(F.when(F.col("n") != 0, F.col("added") / F.col("n"))).alias("turnover"))
