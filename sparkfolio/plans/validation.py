"""Queries of stored signals held against later returns, and of weights that follow from it."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.functions.staging import new_folder, staged
from sparkfolio.operators import backtest as b
from sparkfolio.operators import upkeep
from sparkfolio.operators.joins import global_ordinal
from sparkfolio.plans.backtests import CORR
from sparkfolio.plans.common import query, rounded
from sparkfolio.plans.common import sql_rounded as r
from sparkfolio.plans.factors import WT, full, w
from sparkfolio.plans.research import FUSED, SIG, TIER, fused, signals, tier
from sparkfolio.sources.market import prices_daily
from sparkfolio.sources.tables import WEIGHTS, WPANEL_SQL, panel_weekly
from sparkfolio.sources.versions import DatedTable, Manifest
from sparkfolio.operators.expression import evaluate

#: Horizons of each signal: the common one of five rows and its own.
NATIVE = {"momentum": 10, "reversal": 5, "activity": 3}
WINDOWS, LEAST_PAIRS = (30, 60, 90), 10
_CELLS = sorted({(s, h) for s, own in NATIVE.items() for h in (5, own)})
_HORIZONS = sorted({h for _, h in _CELLS})


def _day_line(*by: str):
    return Window.partitionBy(*(by or (F.lit(0),))).orderBy("date")


# -- information coefficients ---------------------------------------------------------------------------------------

_FW = " UNION ALL ".join(f"SELECT ticker, date, {h} AS h, close AS ce, lead(close, {h}) OVER ({WT}) AS cx, lead(date, {h}) OVER ({WT}) AS dx FROM prices" for h in _HORIZONS)


@query("v1_v2_ic_grid", f"""WITH {SIG}, fw AS ({_FW}), hz AS (SELECT * FROM (VALUES {", ".join(f"('{s}', {h})" for s, h in _CELLS)}) v(signal, h)), nw AS (SELECT max(date) + 1 AS today FROM prices),
  p AS (SELECT s.signal, hz.h, g.w, s.z, s.date, s.ticker, cx / ce - 1 AS fwd FROM sig s JOIN hz USING (signal) JOIN fw USING (ticker, date, h) CROSS JOIN nw JOIN (SELECT unnest([{", ".join(map(str, WINDOWS))}]) AS w) g ON s.date >= today - g.w AND s.date <= today - h
    WHERE z IS NOT NULL AND ce > 0 AND cx IS NOT NULL AND dx - s.date <= 2 * h + 4),
  k AS (SELECT signal, w, h, CAST(row_number() OVER (PARTITION BY signal, w, h ORDER BY round(z, 9), date, ticker) AS DOUBLE) AS a, CAST(row_number() OVER (PARTITION BY signal, w, h ORDER BY round(fwd, 9), date, ticker) AS DOUBLE) AS f FROM p)
  SELECT signal, CAST(w AS INT) AS window_days, CAST(h AS INT) AS horizon, {r(CORR.format(x="a", y="f"))} AS ic, count(*) AS n FROM k GROUP BY signal, w, h HAVING count(*) >= {LEAST_PAIRS}""")  # fmt: skip
def v1_v2_ic_grid(spark, sf_dir):
    """Pooled rank correlation of each signal with the return over its horizons' next rows, for three windows of dates.

    Exits over missing rows may be no more than twice the horizon and four days away.  Cells are few and large, so ranks
    within one come from ranges and offsets.  What is ranked has nine places: sums over windows differ in the last
    bits from run to run, and ties must not depend on them.
    """
    own = b.own()
    ahead = lambda h: F.struct(F.lit(h).alias("horizon"), F.lead("close", h).over(own).alias("cx"), F.lead("date", h).over(own).alias("dx"))
    fw = prices_daily(spark, sf_dir).select("ticker", "date", F.col("close").alias("ce"), *[ahead(h).alias(f"h{h}") for h in _HORIZONS])
    fw = fw.select("ticker", "date", "ce", F.explode(F.array(*[f"h{h}" for h in _HORIZONS])).alias("x")).select("ticker", "date", "ce", "x.*").where("ce > 0 and cx is not null and datediff(dx, date) <= 2 * horizon + 4")
    cells = F.coalesce(*[F.when(F.col("signal") == s, F.array(*[F.lit(h) for q, h in _CELLS if q == s])) for s in NATIVE])
    s = signals(spark, sf_dir).where("z is not null").select("date", "ticker", "signal", "z", F.explode(cells).alias("horizon"))
    today = prices_daily(spark, sf_dir).agg(F.date_add(F.max("date"), 1).alias("today"))
    p = s.join(fw, ["ticker", "date", "horizon"]).join(F.broadcast(today)).withColumn("window_days", F.explode(F.array(*[F.lit(x) for x in WINDOWS])))
    p = p.where("date >= date_sub(today, window_days) and date <= date_sub(today, horizon)").withColumn("cell", F.concat_ws("|", "signal", "window_days", "horizon"))
    p = p.select("cell", "signal", "window_days", "horizon", "date", "ticker", F.round("z", 9).alias("z"), F.round(F.col("cx") / F.col("ce") - 1, 9).alias("fwd"))
    p = global_ordinal(p, "cell", ["z", "date", "ticker"], "a")
    p = global_ordinal(p, "cell", ["fwd", "date", "ticker"], "f")
    return p.groupBy("signal", "window_days", "horizon").agg(rounded(b.correlation(F.col("a").cast("double"), F.col("f").cast("double"))).alias("ic"), F.count("*").alias("n")).where(F.col("n") >= LEAST_PAIRS)


#: Sets of weights that are compared: those in force and even ones.
SETS = {"live": WEIGHTS, "even": {s: 1 / 3 for s in WEIGHTS}}
_AHEAD5 = f"nx AS (SELECT date, ticker, lead(close, 5) OVER ({WT}) / nullif(close, 0) - 1 AS fwd, lead(close, 1) OVER ({WT}) / nullif(close, 0) - 1 AS fwd1 FROM prices)"


def next_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fwd over a ticker's next five own rows, fwd1 over the next."""
    return prices_daily(spark, sf_dir).select("date", "ticker", b.forward_return(5).alias("fwd"), b.forward_return(1).alias("fwd1"))


def composites(spark: SparkSession, sf_dir: str, sets: dict[str, dict[str, float]]) -> DataFrame:
    """weight_set, date, ticker, composite, fwd: the weighted sum of signals beside the five-row return."""
    weight = lambda ws: F.coalesce(*[F.when(F.col("signal") == s, F.lit(x)) for s, x in ws.items()], F.lit(0.0))
    s = signals(spark, sf_dir).where("z is not null").join(next_returns(spark, sf_dir).where("fwd is not null"), ["date", "ticker"])
    wide = s.groupBy("date", "ticker").agg(F.first("fwd").alias("fwd"), *[F.sum(weight(ws) * F.col("z")).alias(n) for n, ws in sets.items()])
    return wide.unpivot(["date", "ticker", "fwd"], list(sets), "weight_set", "composite")


def _composites_sql(sets: dict[str, dict[str, float]]) -> str:
    case = lambda ws: "CASE signal " + " ".join(f"WHEN '{s}' THEN {x!r}" for s, x in ws.items()) + " ELSE 0 END"
    return "comp AS (" + " UNION ALL ".join(f"SELECT '{n}' AS weight_set, date, ticker, sum(CAST({case(ws)} AS DOUBLE) * z) AS composite, any_value(fwd) AS fwd FROM sig JOIN nx USING (date, ticker) WHERE z IS NOT NULL AND fwd IS NOT NULL GROUP BY date, ticker" for n, ws in sets.items()) + ")"


@query("v3_composite_ic", f"""WITH {SIG}, {_AHEAD5}, {_composites_sql(SETS)}, nw AS (SELECT max(date) + 1 AS today FROM prices), q AS (SELECT comp.*, round(composite, 9) AS c9 FROM comp, nw WHERE date >= today - 90 AND date <= today - 5),
  k AS (SELECT weight_set, composite, CAST(row_number() OVER (PARTITION BY weight_set ORDER BY c9, date, ticker) AS DOUBLE) AS a, CAST(row_number() OVER (PARTITION BY weight_set ORDER BY round(fwd, 9), date, ticker) AS DOUBLE) AS f FROM q)
  SELECT weight_set, CASE WHEN count(*) >= {LEAST_PAIRS} AND stddev_pop(composite) >= 1e-9 THEN {r(CORR.format(x="a", y="f"))} END AS ic, count(*) AS n FROM k GROUP BY weight_set""")  # fmt: skip
def v3_composite_ic(spark, sf_dir):
    """Rank correlation of the weighted sum of signals with the five-row return, pooled over the last 90 days."""
    today = prices_daily(spark, sf_dir).agg(F.date_add(F.max("date"), 1).alias("today"))
    q = composites(spark, sf_dir, SETS).join(F.broadcast(today)).where("date >= date_sub(today, 90) and date <= date_sub(today, 5)").withColumn("c9", F.round("composite", 9)).drop("today")  # one row
    q = global_ordinal(q.withColumn("fwd", F.round("fwd", 9)), "weight_set", ["c9", "date", "ticker"], "a")
    q = global_ordinal(q, "weight_set", ["fwd", "date", "ticker"], "f")
    known = (F.count("*") >= LEAST_PAIRS) & (F.stddev_pop("composite") >= 1e-9)
    return q.groupBy("weight_set").agg(F.when(known, rounded(b.correlation(F.col("a").cast("double"), F.col("f").cast("double")))).alias("ic"), F.count("*").alias("n"))


#: How many dates the three windows of the IC history reach back.
TRAILING = {30: 3, 60: 6, 90: 9}
HIST = f"""{SIG}, {_AHEAD5}, sp AS (SELECT signal, date, row_number() OVER (PARTITION BY signal, date ORDER BY z, ticker) AS a, row_number() OVER (PARTITION BY signal, date ORDER BY fwd, ticker) AS f FROM sig JOIN nx USING (date, ticker) WHERE z IS NOT NULL AND fwd IS NOT NULL),
  sic AS (SELECT signal, date, {CORR.format(x="a", y="f")} AS ic FROM sp GROUP BY signal, date HAVING count(*) >= {LEAST_PAIRS}),
  hist AS ({" UNION ALL ".join(f"SELECT signal, {wd} AS window_days, date, avg(ic) OVER (PARTITION BY signal ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS ic FROM sic" for wd, n in TRAILING.items())})"""


def ic_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal, window_days, date, ic: the mean daily rank IC of the last dates of each window."""
    p = signals(spark, sf_dir).where("z is not null").join(next_returns(spark, sf_dir).where("fwd is not null"), ["date", "ticker"])
    at = Window.partitionBy("signal", "date")
    p = p.withColumn("a", F.row_number().over(at.orderBy("z", "ticker"))).withColumn("f", F.row_number().over(at.orderBy("fwd", "ticker")))
    sic = p.groupBy("signal", "date").agg(b.correlation(F.col("a"), F.col("f")).alias("ic"), F.count("*").alias("n")).where(F.col("n") >= LEAST_PAIRS)
    means = F.array(*[F.struct(F.lit(wd).alias("window_days"), F.avg("ic").over(_day_line("signal").rowsBetween(-(n - 1), 0)).alias("ic")) for wd, n in TRAILING.items()])
    return staged(sic.select("signal", "date", means.alias("m")).select("signal", "date", F.explode("m").alias("m")).select("signal", "m.window_days", "date", "m.ic"))


# -- weights --------------------------------------------------------------------------------------------------------

#: How weights follow the evidence.
HALF_LIFE, CHANGE_CAP, CAP_REFERENCE, FLOOR, MOST_BAD, PER_ICIR, STREAK = 30.0, 0.15, 0.05, 0.02, 3, 0.10, 5
SHRINK_AT, SHRINK_MOVE, BLEND, DEGRADED = 30.0, 0.05, 0.10, 0.05

_LIVE_SQL = "CASE signal " + " ".join(f"WHEN '{s}' THEN {x!r}" for s, x in WEIGHTS.items()) + " END"
CANDIDATES = f"""{HIST}, lt AS (SELECT *, max(date) OVER (PARTITION BY signal, window_days) AS latest, count(*) OVER (PARTITION BY signal, window_days) AS n FROM hist WHERE ic IS NOT NULL),
  ew AS (SELECT *, power(0.5, date_diff('day', date, latest) / {HALF_LIFE}) AS wt FROM lt), em AS (SELECT *, sum(wt * ic) OVER (PARTITION BY signal, window_days) / sum(wt) OVER (PARTITION BY signal, window_days) AS mean FROM ew),
  er AS (SELECT signal, window_days, any_value(n) AS n, any_value(mean) AS mean, sqrt(sum(wt * power(ic - mean, 2)) / sum(wt)) AS std FROM em GROUP BY ALL),
  ir AS (SELECT signal, avg(mean / std) FILTER (n >= 2 AND std >= 1e-9) AS icir FROM er GROUP BY signal),
  bd AS (SELECT signal, count(*) FILTER (date > coalesce(good, DATE '1900-01-01') AND date < latest) AS bad FROM (SELECT *, max(CASE WHEN ic > 0 AND date < latest THEN date END) OVER (PARTITION BY signal) AS good FROM lt WHERE window_days = 30) GROUP BY signal),
  cw AS (SELECT signal, CAST({_LIVE_SQL} AS DOUBLE) AS live, icir, bad, coalesce(greatest(icir, 0) * {PER_ICIR}, 0) AS raw FROM ir JOIN bd USING (signal)),
  fl AS (SELECT *, CASE WHEN icir > 0 THEN raw WHEN bad + 1 >= {MOST_BAD} THEN 0.0 ELSE {FLOOR} END AS floored, coalesce(icir, 0) <= 0 AND bad + 1 >= {MOST_BAD} AS dropped, CASE WHEN icir > 0 THEN 0 ELSE bad + 1 END AS bad_now FROM cw),
  cand AS (SELECT *, least(greatest(floored, live - {CHANGE_CAP} * greatest(abs(live), {CAP_REFERENCE})), live + {CHANGE_CAP} * greatest(abs(live), {CAP_REFERENCE})) AS weight FROM fl)"""


def candidate_weights(history: DataFrame) -> DataFrame:
    """signal, live, icir, bad_now, dropped, floored, weight: the next weights by the decayed mean IC over its spread.

    A bad reading shrinks a signal to the floor, three in a row drop it, and no weight moves by more than its cap.
    """
    cell = Window.partitionBy("signal", "window_days")
    h = history.where("ic is not null").withColumn("latest", F.max("date").over(cell))
    e = h.withColumn("wt", F.pow(F.lit(0.5), F.datediff("latest", "date") / HALF_LIFE))
    e = e.withColumn("mean", F.sum(F.col("wt") * F.col("ic")).over(cell) / F.sum("wt").over(cell))
    spread = F.sqrt(F.sum(F.col("wt") * F.pow(F.col("ic") - F.col("mean"), 2)) / F.sum("wt"))
    cells = e.groupBy("signal", "window_days").agg(F.count("*").alias("n"), F.first("mean").alias("mean"), spread.alias("std"))
    icir = cells.groupBy("signal").agg(F.avg(F.when((F.col("n") >= 2) & (F.col("std") >= 1e-9), F.col("mean") / F.col("std"))).alias("icir"))
    before = h.where("window_days = 30").withColumn("good", F.max(F.when((F.col("ic") > 0) & (F.col("date") < F.col("latest")), F.col("date"))).over(Window.partitionBy("signal")))
    bad = before.groupBy("signal").agg(F.count_if((F.col("date") < F.col("latest")) & (F.col("good").isNull() | (F.col("date") > F.col("good")))).alias("bad"))
    live = F.coalesce(*[F.when(F.col("signal") == s, F.lit(x)) for s, x in WEIGHTS.items()])
    good = F.coalesce(F.col("icir") > 0, F.lit(False))
    c = icir.join(bad, "signal").withColumn("live", live)
    c = c.withColumn("dropped", ~good & (F.col("bad") + 1 >= MOST_BAD)).withColumn("bad_now", F.when(good, 0).otherwise(F.col("bad") + 1))
    c = c.withColumn("floored", F.when(good, F.col("icir") * PER_ICIR).when(F.col("dropped"), 0.0).otherwise(FLOOR))
    step = CHANGE_CAP * F.greatest(F.abs("live"), F.lit(CAP_REFERENCE))
    return c.withColumn("weight", F.least(F.greatest("floored", F.col("live") - step), F.col("live") + step))


@query("v5_candidate_weights", f"WITH {CANDIDATES} SELECT signal, {r('live')} AS live, {r('icir')} AS icir, CAST(bad_now AS BIGINT) AS bad_now, dropped, {r('CAST(floored AS DOUBLE)')} AS floored, {r('CAST(weight AS DOUBLE)')} AS weight FROM cand")
def v5_candidate_weights(spark, sf_dir):
    c = candidate_weights(ic_history(spark, sf_dir))
    return c.select("signal", *[rounded(F.col(x)).alias(x) for x in ("live", "icir")], F.col("bad_now").cast("long").alias("bad_now"), "dropped", *[rounded(F.col(x)).alias(x) for x in ("floored", "weight")])


_PAIR = lambda name, weight: f"{name} AS (SELECT date, sum({weight} * z) AS composite, ticker, any_value(fwd) AS fwd FROM sig JOIN nx USING (date, ticker) JOIN cand USING (signal) WHERE z IS NOT NULL AND fwd IS NOT NULL GROUP BY date, ticker)"
_DAY_IC = lambda name, source: f"{name} AS (SELECT date, {CORR.format(x='a', y='f')} AS ic FROM (SELECT date, row_number() OVER (PARTITION BY date ORDER BY round(composite, 9), ticker) AS a, row_number() OVER (PARTITION BY date ORDER BY fwd, ticker) AS f FROM {source}) GROUP BY date HAVING count(*) >= {LEAST_PAIRS})"


def daily_ics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ic_live, ic_shadow, n: each day's rank IC of the weights in force and of the candidates."""
    c = candidate_weights(ic_history(spark, sf_dir)).select("signal", "live", "weight")
    p = signals(spark, sf_dir).where("z is not null").join(F.broadcast(c), "signal").join(next_returns(spark, sf_dir).where("fwd is not null"), ["date", "ticker"])  # a row per signal
    p = p.groupBy("date", "ticker").agg(F.first("fwd").alias("fwd"), F.sum(F.col("live") * F.col("z")).alias("l"), F.sum(F.col("weight") * F.col("z")).alias("s"))
    at = Window.partitionBy("date")
    rank = lambda x: F.row_number().over(at.orderBy(x, "ticker"))
    p = p.withColumn("f", rank("fwd")).withColumn("a", rank(F.round("l", 9))).withColumn("z", rank(F.round("s", 9)))
    return p.groupBy("date").agg(b.correlation(F.col("a"), F.col("f")).alias("ic_live"), b.correlation(F.col("z"), F.col("f")).alias("ic_shadow"), F.count("*").alias("n")).where(F.col("n") >= LEAST_PAIRS)


@query("v6_promotion_rollback", f"""WITH {CANDIDATES}, {_PAIR('cl', 'live')}, {_PAIR('cs', 'weight')}, {_DAY_IC('il', 'cl')}, {_DAY_IC('ish', 'cs')}, j AS (SELECT ish.date, il.ic AS ic_live, ish.ic AS ic_shadow, round(ish.ic, 9) > 0 AND (il.ic IS NULL OR round(ish.ic, 9) >= round(il.ic, 9)) AS good FROM ish LEFT JOIN il USING (date)),
  g AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (ORDER BY date) AS island FROM j), s AS (SELECT *, sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY island ORDER BY date) AS streak FROM g),
  pm AS (SELECT *, good AND streak % {STREAK} = 0 AS promote FROM s), bl AS (SELECT *, last_value(CASE WHEN promote THEN ic_shadow END IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM pm)
  SELECT date, {r('ic_live')} AS ic_live, {r('ic_shadow')} AS ic_shadow, CAST(streak AS BIGINT) AS streak, promote, coalesce(round(ic_live, 9) < round(baseline - {DEGRADED}, 9), false) AS rollback FROM bl""")  # fmt: skip
def v6_promotion_rollback(spark, sf_dir):
    """Day by day: a candidate that stays positive and no worse than the live weights for five days is promoted; a live IC well below the last promotion's is rolled back."""
    j = daily_ics(spark, sf_dir)
    live, shadow = F.round("ic_live", 9), F.round("ic_shadow", 9)
    j = j.withColumn("good", F.coalesce((shadow > 0) & (live.isNull() | (shadow >= live)), F.lit(False)))
    j = j.withColumn("island", F.sum(F.when(F.col("good"), 0).otherwise(1)).over(_day_line())).withColumn("streak", F.sum(F.when(F.col("good"), 1).otherwise(0)).over(_day_line("island")))
    j = j.withColumn("promote", F.col("good") & (F.col("streak") % STREAK == 0))
    baseline = F.last(F.when(F.col("promote"), F.col("ic_shadow")), ignorenulls=True).over(_day_line().rowsBetween(Window.unboundedPreceding, -1))
    j = j.withColumn("rollback", F.coalesce(live < F.round(baseline - DEGRADED, 9), F.lit(False)))
    return j.select("date", rounded(F.col("ic_live")).alias("ic_live"), rounded(F.col("ic_shadow")).alias("ic_shadow"), F.col("streak").cast("long").alias("streak"), "promote", "rollback")


@query("v6_weight_state", f"""WITH RECURSIVE {CANDIDATES}, {_PAIR('cl', 'live')}, {_PAIR('cs', 'weight')}, {_DAY_IC('il', 'cl')}, {_DAY_IC('ish', 'cs')},
  dy AS (SELECT ish.date, round(il.ic, 9) AS base, round(ish.ic, 9) AS cand_ic, row_number() OVER (ORDER BY ish.date) AS k FROM ish LEFT JOIN il USING (date)),
  st AS (SELECT 0::BIGINT AS k, NULL::DATE AS date, 'base' AS live, []::STRUCT(prior VARCHAR, baseline DOUBLE)[] AS stack, 0 AS streak, '' AS action, NULL::DOUBLE AS ic
    UNION ALL
    SELECT k, date, CASE WHEN promoted THEN 'candidate' ELSE live END, CASE WHEN promoted THEN list_append(stack, {{'prior': live, 'baseline': cand_ic}}) ELSE stack END, CASE WHEN promoted THEN 0 ELSE streak END,
           trim(CASE WHEN back THEN 'rollback' ELSE '' END || CASE WHEN promoted THEN ' promote' ELSE '' END), now
    FROM (SELECT *, streak >= {STREAK} AS promoted FROM (
      SELECT k, date, live, stack, back, cand_ic, now, CASE WHEN coalesce(cand_ic > 0 AND (now IS NULL OR cand_ic >= now), false) THEN streak + 1 ELSE 0 END AS streak FROM (
        SELECT *, CASE live WHEN 'base' THEN base ELSE cand_ic END AS now FROM (
          SELECT k, date, base, cand_ic, streak, back, CASE WHEN back THEN stack[-1].prior ELSE live END AS live, CASE WHEN back THEN stack[:-2] ELSE stack END AS stack FROM (
            SELECT dy.*, st.live, st.stack, st.streak, coalesce(len(st.stack) > 0 AND CASE st.live WHEN 'base' THEN base ELSE cand_ic END < st.stack[-1].baseline - {DEGRADED}::DOUBLE, false) AS back
            FROM st JOIN dy ON dy.k = st.k + 1))))))
  SELECT date, k + 1 AS version, live, CAST(streak AS BIGINT) AS streak, CAST(len(stack) AS BIGINT) AS promotions, action FROM st WHERE k > 0""")  # fmt: skip
def v6_weight_state(spark, sf_dir):
    """The stored weights after each day: what was live, the streak, how many promotions stand, and what the day did.

    The day's figures come from Spark, one row a day; the state is one small file for each version.
    """
    c = candidate_weights(ic_history(spark, sf_dir)).select("signal", "live", "weight").collect()  # a row for each signal
    state = upkeep.WeightState(Manifest(spark, new_folder(spark, "weights")), STREAK, DEGRADED)
    state.seed("base", {x["signal"]: x["live"] for x in c})
    days = daily_ics(spark, sf_dir).select("date", F.round("ic_live", 9).alias("base"), F.round("ic_shadow", 9).alias("candidate")).orderBy("date").collect()  # a row for each day
    out = []
    for d in days:
        s = state.step(d["date"], {"base": d["base"], "candidate": d["candidate"]}, "candidate", {x["signal"]: x["weight"] for x in c})
        out.append((d["date"], len(out) + 2, s["live"], s["streak"], len(s["promotions"]), s["action"]))
    return spark.createDataFrame(out, "date date, version long, live string, streak long, promotions long, action string")


@query("v7_guarded_shrinkage", f"""WITH {CANDIDATES}, ne AS (SELECT signal, count(*) AS n FROM hist WHERE window_days = 30 GROUP BY signal), sh AS (SELECT signal, live, weight, n, n / (n + {SHRINK_AT}) AS pull FROM cand JOIN ne USING (signal)),
  mv AS (SELECT *, live + greatest(-{SHRINK_MOVE}, least({SHRINK_MOVE}, pull * (weight - live))) AS target FROM sh)
  SELECT signal, {r('pull')} AS pull, {r('CASE WHEN n <= 0 THEN live ELSE greatest(CASE WHEN live > 0 THEN ' + str(FLOOR) + ' ELSE 0 END, least(greatest(live, weight, 0.30), target)) END')} AS weight FROM mv""")  # fmt: skip
def v7_guarded_shrinkage(spark, sf_dir):
    """Weights pulled from the prior to the evidence by the size of its sample, moved by 0.05 at most and never to zero."""
    h = ic_history(spark, sf_dir)
    n = h.where("window_days = 30").groupBy("signal").agg(F.count("*").alias("n"))
    s = candidate_weights(h).join(n, "signal").withColumn("pull", F.col("n") / (F.col("n") + SHRINK_AT))
    target = F.col("live") + F.greatest(F.lit(-SHRINK_MOVE), F.least(F.lit(SHRINK_MOVE), F.col("pull") * (F.col("weight") - F.col("live"))))
    guarded = F.greatest(F.when(F.col("live") > 0, FLOOR).otherwise(0.0), F.least(F.greatest("live", "weight", F.lit(0.30)), target))
    return s.select("signal", rounded(F.col("pull")).alias("pull"), rounded(F.when(F.col("n") <= 0, F.col("live")).otherwise(guarded)).alias("weight"))


@query("v8_guarded_blend", f"""WITH {CANDIDATES}, ob AS (SELECT signal, count(*) AS n FROM hist GROUP BY signal), tail AS (SELECT * FROM hist WHERE date >= (SELECT max(date) FROM hist) - 30),
  inv AS (SELECT signal, count(*) >= 8 AND avg(ic) <= -0.01 AND avg(CASE WHEN ic < 0 THEN 1.0 ELSE 0 END) >= 0.6 AS inverted FROM tail GROUP BY signal)
  SELECT signal, inverted, {r(f'CASE WHEN inverted THEN 0 WHEN n >= 10 THEN greatest(0.0, {1 - BLEND} * live + {BLEND} * weight) ELSE live END')} AS weight FROM cand JOIN ob USING (signal) JOIN inv USING (signal)""")  # fmt: skip
def v8_guarded_blend(spark, sf_dir):
    """Nine parts of the static weight and one of the adaptive one, from ten readings on; signals that stay negative weigh nothing."""
    h = ic_history(spark, sf_dir)
    last = h.agg(F.max("date").alias("last"))
    tail = h.join(F.broadcast(last)).where("date >= date_sub(last, 30)")  # one row
    inverted = (F.count("*") >= 8) & (F.avg("ic") <= -0.01) & (F.avg((F.col("ic") < 0).cast("double")) >= 0.6)
    s = candidate_weights(h).join(h.groupBy("signal").agg(F.count("*").alias("n")), "signal").join(tail.groupBy("signal").agg(inverted.alias("inverted")), "signal")
    blend = F.greatest(F.lit(0.0), (1 - BLEND) * F.col("live") + BLEND * F.col("weight"))
    return s.select("signal", "inverted", rounded(F.when(F.col("inverted"), 0.0).when(F.col("n") >= 10, blend).otherwise(F.col("live"))).alias("weight"))


# -- calibration ----------------------------------------------------------------------------------------------------


def pooled_steps(steps) -> list[tuple[float, float, float]]:
    """Pool neighbours (x, hits, n) until hit rates do not fall: (low, high, rate) of each block."""
    blocks: list[list[float]] = []
    for x, hits, n in steps:
        blocks.append([hits, n, x, x])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            hits, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + hits, blocks[-1][1] + n, blocks[-1][2], high]
    return [(low, high, h / n) for h, n, low, high in blocks]


@query("v10_calibrated_confidence")
def v10_calibrated_confidence(spark, sf_dir):
    """Each card's confidence lowered to its calibrated hit rate: the monotone map's value between its knots, never above the raw one.

    Counts by rounded confidence are made first, so the map is pooled from 1001 rows at most; below 50 pairs there is none
    and confidences stay.
    """
    from sparkfolio.plans.research import v9_confidence_hits

    h = v9_confidence_hits(spark, sf_dir).withColumn("x", F.round("confidence", 3))
    steps = h.groupBy("x").agg(F.sum(F.col("hit").cast("double")).alias("hits"), F.count("*").cast("double").alias("n")).withColumn("key", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["n"].sum() < 50:
            return pd.DataFrame({"knots": []})
        blocks = pooled_steps(pdf.sort_values("x")[["x", "hits", "n"]].itertuples(index=False))
        knots = [{"x": x, "y": rate} for low, high, rate in blocks for x in sorted({low, high})]
        return pd.DataFrame({"knots": [knots]})

    one = steps.groupBy("key").applyInPandas(run, "knots array<struct<x:double,y:double>>")  # one row of at most 2002 knots
    one = h.agg(F.count("*").alias("pairs")).join(one, how="left")
    cards = fused(spark, sf_dir).select("date", "ticker", rounded(F.col("agreement")).alias("confidence")).join(F.broadcast(one))
    below = F.filter("knots", lambda k: k["x"] <= F.col("confidence"))
    above = F.filter("knots", lambda k: k["x"] > F.col("confidence"))
    a, z = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    between = a["y"] + (z["y"] - a["y"]) * (F.col("confidence") - a["x"]) / (z["x"] - a["x"])
    value = F.when(F.col("knots").isNull(), F.col("confidence")).otherwise(F.coalesce(between, a["y"], z["y"]))
    return cards.select("date", "ticker", "confidence", rounded(F.least(value, F.col("confidence"))).alias("calibrated"))


# -- tiers and outcomes ---------------------------------------------------------------------------------------------

#: Cards are eligible where enough of the core weight is present; a run is complete with enough eligible cards.
COVERED, COMPLETE = 0.7, 20
_ORDER = {"BUY": 0, "OW": 1, "HOLD": 2, "UW": 3, "SELL": 4}
_PLACE = "CASE tier " + " ".join(f"WHEN '{t}' THEN {i}" for t, i in _ORDER.items()) + " END"
LEDGER = f"""{FUSED}, {_AHEAD5}, ld AS (SELECT date, ticker, composite, coverage, {TIER} AS tier, round(coverage, 6) >= {COVERED} AS eligible, count(*) FILTER (round(coverage, 6) >= {COVERED}) OVER (PARTITION BY date) >= {COMPLETE} AS complete FROM fused)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ticker, composite, tier, eligible, complete: the rating snapshots and whether their run is complete."""
    c = fused(spark, sf_dir).select("date", "ticker", "composite", tier(F.col("composite")).alias("tier"), (F.round("coverage", 6) >= COVERED).alias("eligible"))
    return c.withColumn("complete", F.count_if("eligible").over(b.day()) >= COMPLETE)


@query("v12_tier_monotonicity", f"""WITH {LEDGER}, g AS (SELECT tier, {_PLACE} AS place, avg(fwd) AS mean_return, avg(CASE WHEN tier IN ('BUY', 'OW') THEN CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END WHEN tier IN ('UW', 'SELL') THEN CASE WHEN fwd < 0 THEN 1.0 ELSE 0 END END) AS hit_rate, count(*) AS n
    FROM ld JOIN nx USING (date, ticker) WHERE complete AND eligible AND fwd IS NOT NULL GROUP BY tier)
  SELECT tier, {r('mean_return')} AS mean_return, {r('hit_rate')} AS hit_rate, n, coalesce(round(mean_return, 12) < round(lead(mean_return) OVER (ORDER BY place), 12), false) AS violates FROM g""")  # fmt: skip
def v12_tier_monotonicity(spark, sf_dir):
    """Return and hit rate per tier of eligible cards of complete runs, and where a tier earns less than the next weaker one."""
    j = ledger(spark, sf_dir).where("complete and eligible").join(next_returns(spark, sf_dir).where("fwd is not null"), ["date", "ticker"])
    hit = F.when(F.col("tier").isin("BUY", "OW"), (F.col("fwd") > 0).cast("double")).when(F.col("tier").isin("UW", "SELL"), (F.col("fwd") < 0).cast("double"))
    g = j.groupBy("tier").agg(F.avg("fwd").alias("mean"), F.avg(hit).alias("hits"), F.count("*").alias("n")).withColumn("place", F.expr(_PLACE))
    weaker = F.lead(F.round("mean", 12)).over(Window.partitionBy(F.lit(0)).orderBy("place"))
    return g.select("tier", rounded(F.col("mean")).alias("mean_return"), rounded(F.col("hits")).alias("hit_rate"), "n", F.coalesce(F.round("mean", 12) < weaker, F.lit(False)).alias("violates"))


#: Limits of the five weaknesses.
WEAK = {"low_ic": 0.02, "redundant": 0.7, "poor_coverage": 0.5, "high_maintenance": 0.7, "no_forward_contribution": 0.0}


@query("v13_prune_candidates", f"""WITH {HIST}, ic1 AS (SELECT signal, avg(ic) AS ic FROM sic GROUP BY signal), cv AS (SELECT signal, count(z) / CAST(count(*) AS DOUBLE) AS coverage FROM sig GROUP BY signal),
  mc AS (SELECT a.signal, max(c) AS max_corr FROM (SELECT a.signal, {CORR.format(x="a.z", y="o.z")} AS c FROM sig a JOIN sig o ON a.date = o.date AND a.ticker = o.ticker AND a.signal <> o.signal WHERE a.z IS NOT NULL AND o.z IS NOT NULL GROUP BY a.signal, o.signal) a GROUP BY a.signal),
  m AS (SELECT signal, ic, max_corr, coverage, 1 - coverage AS maintenance, ic * coverage AS forward FROM ic1 JOIN cv USING (signal) LEFT JOIN mc USING (signal)),
  w AS (SELECT signal, list_filter([CASE WHEN abs(ic) < 0.02 THEN 'low_ic' END, CASE WHEN max_corr > 0.7 THEN 'redundant' END, CASE WHEN coverage < 0.5 THEN 'poor_coverage' END, CASE WHEN maintenance > 0.7 THEN 'high_maintenance' END, CASE WHEN forward <= 0 THEN 'no_forward_contribution' END], lambda x: x IS NOT NULL) AS reasons FROM m)
  SELECT signal, coalesce(array_to_string(reasons, ','), '') AS reasons, len(reasons) = 5 AS prune FROM w""")  # fmt: skip
def v13_prune_candidates(spark, sf_dir):
    """A signal's weaknesses; only one with all five is named for pruning."""
    s = staged(signals(spark, sf_dir))
    daily = s.where("z is not null").join(next_returns(spark, sf_dir).where("fwd is not null"), ["date", "ticker"])
    at = Window.partitionBy("signal", "date")
    daily = daily.withColumn("a", F.row_number().over(at.orderBy("z", "ticker"))).withColumn("f", F.row_number().over(at.orderBy("fwd", "ticker"))).groupBy("signal", "date").agg(b.correlation(F.col("a"), F.col("f")).alias("ic"), F.count("*").alias("n")).where(F.col("n") >= LEAST_PAIRS)
    ic = daily.groupBy("signal").agg(F.avg("ic").alias("ic"))
    coverage = s.groupBy("signal").agg((F.count("z") / F.count("*")).alias("coverage"))
    other = s.select("date", "ticker", F.col("signal").alias("other"), F.col("z").alias("oz")).where("oz is not null")
    corr = s.where("z is not null").join(other, ["date", "ticker"]).where("signal <> other").groupBy("signal", "other").agg(b.correlation(F.col("z"), F.col("oz")).alias("c")).groupBy("signal").agg(F.max("c").alias("max_corr"))
    m = ic.join(coverage, "signal").join(corr, "signal", "left").withColumn("maintenance", 1 - F.col("coverage")).withColumn("forward", F.col("ic") * F.col("coverage"))
    holds = {"low_ic": F.abs("ic") < 0.02, "redundant": F.col("max_corr") > 0.7, "poor_coverage": F.col("coverage") < 0.5, "high_maintenance": F.col("maintenance") > 0.7, "no_forward_contribution": F.col("forward") <= 0}
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in holds.items()]))
    return m.select("signal", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 5).alias("prune"))


_PARTIAL = "ticker % 4 <> extract('day' FROM date) % 4"
PREDS = f"""{FUSED}, {_AHEAD5}, fs AS (SELECT ticker, date, {TIER} AS rating, composite AS score, 1 AS pri FROM fused WHERE composite IS NOT NULL AND {_PARTIAL}),
  sl AS (SELECT ticker, date, NULL AS rating, sum(w * z) / sum(w) AS score, 0 AS pri FROM live WHERE signal <> 'activity' GROUP BY ticker, date),
  preds AS (SELECT ticker, date, arg_max(coalesce(rating, ''), pri) AS rating, arg_max(score, pri) AS score FROM (SELECT * FROM fs UNION ALL SELECT * FROM sl WHERE score IS NOT NULL) GROUP BY ticker, date),
  oc AS (SELECT ticker, date, fwd1, CASE WHEN rating <> '' THEN rating ELSE {TIER.replace('composite', 'round(score, 9)')} END AS rating, score FROM preds JOIN nx USING (ticker, date) WHERE fwd1 IS NOT NULL)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ticker, rating, score: fast cards, and slow partial ones where there is no fast one; their tier comes from the score."""
    fast = fused(spark, sf_dir).where("composite is not null").where(F.col("ticker") % 4 != F.dayofmonth("date") % 4).select("ticker", "date", tier(F.col("composite")).alias("rating"), F.col("composite").alias("score"), F.lit(1).alias("pri"))
    weight = F.coalesce(*[F.when(F.col("signal") == s, F.lit(x)) for s, x in WEIGHTS.items()])
    slow = signals(spark, sf_dir).where("confidence > 0 and signal <> 'activity'").groupBy("ticker", "date").agg((F.sum(weight * F.col("z")) / F.sum(weight)).alias("score"))
    slow = slow.where("score is not null").select("ticker", "date", F.lit(None).cast("string").alias("rating"), "score", F.lit(0).alias("pri"))
    preds = fast.unionByName(slow).groupBy("ticker", "date").agg(F.max_by(F.struct("rating", "score"), "pri").alias("p")).select("ticker", "date", "p.*")
    return preds.withColumn("rating", F.coalesce("rating", tier(F.round("score", 9))))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with fwd1, the return to the next row."""
    ahead = next_returns(spark, sf_dir).where("fwd1 is not null").select("ticker", "date", "fwd1")
    return cards(spark, sf_dir).join(ahead, ["ticker", "date"])


_HIT = "CASE WHEN rating IN ('BUY', 'OW') THEN fwd1 > 0 WHEN rating IN ('UW', 'SELL') THEN fwd1 < 0 END"


def _hit() -> Column:
    return F.when(F.col("rating").isin("BUY", "OW"), F.col("fwd1") > 0).when(F.col("rating").isin("UW", "SELL"), F.col("fwd1") < 0)


@query("v14_outcomes_fast_and_slow", f"WITH {PREDS} SELECT ticker, date, rating, {_HIT} AS hit FROM oc WHERE rating <> 'HOLD'")
def v14_outcomes_fast_and_slow(spark, sf_dir):
    return predictions(spark, sf_dir).where("rating <> 'HOLD'").select("ticker", "date", "rating", _hit().alias("hit"))


#: How many days of prices the first of two runs does not know yet.
BEHIND = 5


@query("v15_materialised_outcomes", f"""WITH {PREDS}, nd AS (SELECT ticker, date, lead(date) OVER ({WT}) AS known FROM prices), lv AS (SELECT ticker, date, {_HIT} AS hit, known FROM oc JOIN nd USING (ticker, date) WHERE rating <> 'HOLD'),
  st AS (SELECT max(date) AS last FROM lv WHERE known <= (SELECT max(date) FROM prices) - {BEHIND}) SELECT ticker, date, hit, coalesce(date > last - {upkeep.TAIL}, true) AS scanned FROM lv, st""")  # fmt: skip
def v15_materialised_outcomes(spark, sf_dir):
    """Verdicts in a stored table after two runs, of which the first does not know the last days' prices; ``scanned`` is what the second one looked at.

    Cards are stored by date, too: a run opens those of its tail alone, and prices are filtered in the scan.
    """
    cards_by_date = DatedTable(spark, new_folder(spark, "cards"), "ticker long, date date, rating string, score double")
    cards_by_date.replace(cards(spark, sf_dir))
    stored = DatedTable(spark, new_folder(spark, "verdicts"), "ticker long, date date, hit boolean")
    prices = prices_daily(spark, sf_dir).select("ticker", "date", "close")
    known = prices.agg(F.max("date")).first()[0]
    if known is not None:
        upkeep.materialise(stored, lambda after: verdicts(cards_by_date, prices.where(F.col("date") <= known - dt.timedelta(days=BEHIND)), after))
    after = upkeep.materialise(stored, lambda after: verdicts(cards_by_date, prices, after))
    return stored.read().withColumn("scanned", F.col("date") > F.lit(after) if after else F.lit(True))


def verdicts(cards_by_date: DatedTable, prices: DataFrame, after: dt.date | None) -> DataFrame:
    """ticker, date, hit of directional cards after a date (all if none is given), once the next row's price is known."""
    c = cards_by_date.read(since=after + dt.timedelta(days=1) if after else None)
    p = prices.where(F.col("date") > F.lit(after)) if after else prices
    ahead = p.select("ticker", "date", b.forward_return(1).alias("fwd1")).where("fwd1 is not null")
    return c.where("rating <> 'HOLD'").join(ahead, ["ticker", "date"]).select("ticker", "date", _hit().alias("hit"))


#: Market days of each window and how many verdicts it takes.
SPANS, LEAST = {"d5": 5, "m1": 21, "y1": 252}, {"d5": 3, "m1": 10, "y1": 120, "hist": 5}
_CUTS = "cd AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS age, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM prices)), cut AS (SELECT " + ", ".join(f"max(date) FILTER (age = least({n}, n)) AS {s}" for s, n in SPANS.items()) + " FROM cd)"
_RATE = lambda s: r(f"CASE WHEN count(*) FILTER ({'true' if s == 'hist' else f'date >= {s}'}) >= {LEAST[s]} THEN avg(CASE WHEN hit THEN 1.0 ELSE 0 END) FILTER ({'true' if s == 'hist' else f'date >= {s}'}) END")


def cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the first date of each window on the market's calendar."""
    days = prices_daily(spark, sf_dir).select("date").distinct()
    days = days.withColumn("age", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("date")))).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    return days.agg(*[F.max(F.when(F.col("age") == F.least(F.lit(n), F.col("n")), F.col("date"))).alias(s) for s, n in SPANS.items()])


def _rates(rows: DataFrame, names: list[str]) -> DataFrame:
    y = F.col("hit").cast("double")

    def rate(s: str) -> Column:
        inside = y if s == "hist" else F.when(F.col("date") >= F.col(s), y)
        return rounded(F.when(F.count(inside) >= LEAST[s], F.avg(inside))).alias(s)

    return rows.groupBy("ticker").agg(*[rate(s).alias(f"rate_{s}") for s in names])


@query("v16_hit_rates_with_year", f"WITH {PREDS}, {_CUTS}, lv AS (SELECT ticker, date, {_HIT} AS hit FROM oc WHERE rating <> 'HOLD') SELECT ticker, {', '.join(f'{_RATE(s)} AS rate_{s}' for s in LEAST)} FROM lv, cut GROUP BY ticker")
def v16_hit_rates_with_year(spark, sf_dir):
    """Hit rates of four windows by the market's calendar; too few verdicts give none."""
    rows = v14_outcomes_fast_and_slow(spark, sf_dir).join(F.broadcast(cutoffs(spark, sf_dir)))  # one row
    return _rates(rows, list(LEAST))


FLAT = 0.005


@query("v17_hold_inclusive_rates", f"WITH {PREDS}, {_CUTS}, lv AS (SELECT ticker, date, coalesce({_HIT}, abs(fwd1) <= {FLAT}) AS hit FROM oc) SELECT ticker, {_RATE('d5')} AS rate_d5, {_RATE('m1')} AS rate_m1 FROM lv, cut GROUP BY ticker")
def v17_hold_inclusive_rates(spark, sf_dir):
    """As the hit rates, with HOLD right where the next return stayed within half a percent."""
    rows = predictions(spark, sf_dir).withColumn("hit", F.coalesce(_hit(), F.abs("fwd1") <= FLAT)).join(F.broadcast(cutoffs(spark, sf_dir)))  # one row
    return _rates(rows, ["d5", "m1"])


# -- scoreboard -----------------------------------------------------------------------------------------------------

TOP, COST_BPS = 20, 10.0
_TOPS = f"""sb AS (SELECT date, ticker, round(score, 9) AS s, fwd1, rank() OVER (PARTITION BY date ORDER BY round(score, 9) DESC) AS up, rank() OVER (PARTITION BY date ORDER BY round(score, 9)) AS dn, count(*) OVER (PARTITION BY date) AS n FROM oc),
  bd AS (SELECT date, avg(fwd1) FILTER (up <= {TOP}) AS lr, avg(fwd1) FILTER (dn <= {TOP}) AS sr, avg(fwd1) AS mr, count(*) FILTER (up <= {TOP} AND fwd1 > 0) AS lu, count(*) FILTER (up <= {TOP}) AS ln, count(*) FILTER (dn <= {TOP} AND fwd1 < 0) AS sd, count(*) FILTER (dn <= {TOP}) AS sn,
    count(*) FILTER (fwd1 > 0) AS au, count(*) AS an FROM sb WHERE n >= {3 * TOP} GROUP BY date),
  pv AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM bd), ov AS (SELECT pv.date, count(*) AS same FROM pv JOIN sb a ON a.date = pv.date AND a.up <= {TOP} JOIN sb z ON z.date = pv.before AND z.ticker = a.ticker AND z.up <= {TOP} GROUP BY pv.date),
  mk AS (SELECT date, lead(level) OVER (ORDER BY date) / level - 1 AS bench FROM (SELECT date, avg(close) AS level FROM prices GROUP BY date)),
  dy AS (SELECT bd.*, CASE WHEN before IS NULL THEN 1.0 ELSE 1 - coalesce(same, 0) / {float(TOP)} END AS moved, bench FROM bd JOIN pv USING (date) LEFT JOIN ov USING (date) LEFT JOIN mk USING (date))"""


def basket_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per date of enough names: returns and counts of the top, bottom and all names, the top basket's turnover, the market's return.

    ``rank`` lets ties exceed the basket's size.  A date's basket meets the one of the date evaluated before it by equality.
    """
    s = predictions(spark, sf_dir).withColumn("s", F.round("score", 9))
    s = s.withColumn("up", F.rank().over(b.day().orderBy(F.desc("s")))).withColumn("dn", F.rank().over(b.day().orderBy("s"))).withColumn("n", F.count("*").over(b.day()))
    s = staged(s.where(F.col("n") >= 3 * TOP).select("date", "ticker", "fwd1", "up", "dn"))
    top, low, x = F.col("up") <= TOP, F.col("dn") <= TOP, F.col("fwd1")
    bd = s.groupBy("date").agg(
        F.avg(F.when(top, x)).alias("lr"), F.avg(F.when(low, x)).alias("sr"), F.avg(x).alias("mr"), F.count_if(top & (x > 0)).alias("lu"), F.count_if(top).alias("ln"),
        F.count_if(low & (x < 0)).alias("sd"), F.count_if(low).alias("sn"), F.count_if(x > 0).alias("au"), F.count("*").alias("an"),
    ).withColumn("before", F.lag("date").over(_day_line()))
    basket = s.where(top).select("date", "ticker")
    earlier = basket.select(F.col("date").alias("before"), "ticker")
    same = basket.join(bd.select("date", "before"), "date").join(earlier, ["before", "ticker"]).groupBy("date").agg(F.count("*").alias("same"))
    level = prices_daily(spark, sf_dir).groupBy("date").agg(F.avg("close").alias("level"))
    market = level.select("date", (F.lead("level").over(_day_line()) / F.col("level") - 1).alias("bench"))
    moved = F.when(F.col("before").isNull(), 1.0).otherwise(1 - F.coalesce("same", F.lit(0)) / float(TOP))
    return staged(bd.join(same, "date", "left").join(market, "date", "left").withColumn("moved", moved))


_NW_LAG = lambda n: f"greatest(1, CAST(floor(4.0 * power({n} / 100.0, 2.0 / 9.0)) AS BIGINT))"
_NW_SQL = lambda e, n: f"""sqrt(greatest((list_dot_product({e}, {e}) + list_sum(list_transform(range(1, {_NW_LAG(n)} + 1), lambda l: CASE WHEN l >= {n} THEN 0 ELSE 2.0 * (1 - l / ({_NW_LAG(n)} + 1.0)) * list_dot_product({e}[l + 1:], {e}[:{n} - l]) END))) / {n}, 1e-30) / {n})"""


def newey_west(residuals: str) -> Column:
    """Standard error of a mean from an array of residuals in order: Bartlett weights up to a lag that grows slowly with its size."""
    e, n = F.col(residuals), F.size(residuals)
    lag = F.greatest(F.lit(1), F.floor(4.0 * F.pow(n / 100.0, F.lit(2.0 / 9.0))).cast("int"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    terms = F.aggregate(F.sequence(F.lit(1), F.least(lag, n - 1)), F.lit(0.0), lambda acc, l: acc + 2.0 * (1 - l / (lag + 1.0)) * dot(F.slice(e, l + 1, n), F.slice(e, F.lit(1), n - l)))
    return F.when(n >= 2, F.sqrt(F.greatest((dot(e, e) + terms) / n, F.lit(1e-30)) / n))


@query("v18_scoreboard", f"""WITH {PREDS}, {_TOPS}, a AS (SELECT count(*) AS days, product(1 + lr) - 1 AS long_cum, product(1 + sr) - 1 AS short_cum, product(1 + mr) - 1 AS market_cum, product(1 + lr - sr) - 1 AS spread_cum, product(1 + coalesce(bench, 0)) - 1 AS bench_cum, sum(lu) / sum(ln) AS long_hits, sum(sd) / sum(sn) AS short_hits, sum(au) / sum(an) AS base_rate,
    avg(moved) AS turnover, product(1 + lr - moved * {COST_BPS} / 10000) - 1 AS net_cum, sum(moved) AS all_moved FROM dy)
  SELECT days, {", ".join(f"{r(f'CAST({c} AS DOUBLE)')} AS {c}" for c in ("long_cum", "short_cum", "market_cum", "spread_cum", "bench_cum", "long_hits", "short_hits", "base_rate", "turnover", "net_cum"))}, {r('(long_cum - bench_cum) / nullif(all_moved, 0) * 10000')} AS breakeven_bps FROM a WHERE days >= 3""")  # fmt: skip
def v18_scoreboard(spark, sf_dir):
    """Compounded returns of the baskets, the spread and the market, hit rates, turnover, net of cost, and the cost that would eat the edge."""
    d = basket_days(spark, sf_dir)
    grow = lambda c: F.product(1 + c) - 1
    share = lambda x, y: F.sum(x) / F.sum(y)
    a = d.agg(
        F.count("*").alias("days"), grow(F.col("lr")).alias("long_cum"), grow(F.col("sr")).alias("short_cum"), grow(F.col("mr")).alias("market_cum"), grow(F.col("lr") - F.col("sr")).alias("spread_cum"), grow(F.coalesce("bench", F.lit(0.0))).alias("bench_cum"),
        share("lu", "ln").alias("long_hits"), share("sd", "sn").alias("short_hits"), share("au", "an").alias("base_rate"), F.avg("moved").alias("turnover"), grow(F.col("lr") - F.col("moved") * COST_BPS / 10_000).alias("net_cum"), F.sum("moved").alias("all_moved"),
    ).where("days >= 3")
    figures = ["long_cum", "short_cum", "market_cum", "spread_cum", "bench_cum", "long_hits", "short_hits", "base_rate", "turnover", "net_cum"]
    even = F.when(F.col("all_moved") != 0, (F.col("long_cum") - F.col("bench_cum")) / F.col("all_moved") * 10_000)
    return a.select("days", *[rounded(F.col(c)).alias(c) for c in figures], rounded(even).alias("breakeven_bps"))


@query("v19_newey_west_alpha", f"""WITH {PREDS}, {_TOPS}, q AS (SELECT date, lr, bench FROM dy WHERE bench IS NOT NULL), f AS (SELECT regr_slope(lr, bench) AS beta, regr_intercept(lr, bench) AS alpha, count(*) AS n FROM q),
  e AS (SELECT any_value(beta) AS beta, any_value(alpha) AS alpha, any_value(n) AS n, list(lr - alpha - beta * bench ORDER BY date) AS res FROM q, f)
  SELECT {r('beta')} AS beta, {r('alpha * 252')} AS alpha_year, {r(f"alpha / {_NW_SQL('res', 'n')}")} AS alpha_t, n FROM e WHERE n >= 3""")  # fmt: skip
def v19_newey_west_alpha(spark, sf_dir):
    """Beta and yearly alpha of the top basket against the market, with a t value that allows for serial correlation."""
    q = basket_days(spark, sf_dir).where("bench is not null").select("date", "lr", "bench")
    f = q.agg(F.regr_slope("lr", "bench").alias("beta"), F.regr_intercept("lr", "bench").alias("alpha"), F.count("*").alias("n"))
    res = F.struct("date", (F.col("lr") - F.col("alpha") - F.col("beta") * F.col("bench")).alias("e"))
    e = q.join(F.broadcast(f)).groupBy("beta", "alpha", "n").agg(F.transform(F.array_sort(F.collect_list(res)), lambda x: x["e"]).alias("res")).where("n >= 3")  # one row
    return e.select(rounded(F.col("beta")).alias("beta"), rounded(F.col("alpha") * 252).alias("alpha_year"), rounded(F.col("alpha") / newey_west("res")).alias("alpha_t"), "n")


EDGES, BREADTH, LAST_DATES, LEAST_DATES, OUT_OF_SAMPLE = (5, 20, 60), 20, 90, 10, "2001-01-01"


@query("v20_basket_edge", f"""WITH {WPANEL_SQL}, wf AS (SELECT date, ticker, close, {full(5, f'avg(returns) {w(5)}')} AS composite, {", ".join(f"lead(close, {h}) OVER ({WT}) / nullif(close, 0) - 1 AS f{h}" for h in EDGES)} FROM wpanel),
  l AS ({" UNION ALL ".join(f"SELECT {h} AS horizon, date, ticker, composite, f{h} AS fwd FROM wf WHERE composite IS NOT NULL AND f{h} IS NOT NULL" for h in EDGES)}), ra AS (SELECT *, dense_rank() OVER (PARTITION BY horizon ORDER BY date DESC) AS age FROM l),
  k AS (SELECT *, row_number() OVER (PARTITION BY horizon, date ORDER BY composite, ticker) AS a, row_number() OVER (PARTITION BY horizon, date ORDER BY fwd, ticker) AS f, count(*) OVER (PARTITION BY horizon, date) AS n FROM ra WHERE age <= {LAST_DATES}),
  d AS (SELECT horizon, date, {CORR.format(x="a", y="f")} AS ic, avg(fwd) FILTER (a > n - greatest(1, n // 5)) AS lo, avg(fwd) FILTER (a <= greatest(1, n // 5)) AS sh FROM k WHERE n >= {BREADTH} GROUP BY horizon, date HAVING {CORR.format(x="a", y="f")} IS NOT NULL),
  m AS (SELECT horizon, avg(ic) AS mean FROM d GROUP BY horizon), e AS (SELECT horizon, count(*) AS n_days, any_value(mean) AS mean_ic, stddev_samp(ic) AS sd, avg(lo) AS lo, avg(sh) AS sh, avg(lo - sh) AS spread, list(ic - mean ORDER BY date) AS res, avg(ic) FILTER (date >= DATE '{OUT_OF_SAMPLE}') AS oos_ic, count(*) FILTER (date >= DATE '{OUT_OF_SAMPLE}') AS oos_days FROM d JOIN m USING (horizon) GROUP BY horizon),
  hz AS (SELECT unnest([{", ".join(map(str, EDGES))}]) AS horizon), x AS (SELECT hz.horizon, coalesce(n_days, 0) AS n_days, mean_ic, sd, lo, sh, spread, res, oos_ic, coalesce(oos_days, 0) AS oos_days FROM hz LEFT JOIN e USING (horizon))
  SELECT CAST(horizon AS INT) AS horizon, n_days, n_days < {LEAST_DATES} AS insufficient, {", ".join(f"{r(f'CASE WHEN n_days >= {LEAST_DATES} THEN {c} END')} AS {n}" for n, c in {"mean_ic": "mean_ic", "ic_ir": "mean_ic / nullif(sd, 0)", "long_return": "lo", "short_return": "sh", "spread": "spread", "ic_t": f"mean_ic / {_NW_SQL('res', 'n_days')}", "oos_ic": "oos_ic"}.items())},
    CASE WHEN n_days >= {LEAST_DATES} THEN oos_days ELSE 0 END AS oos_days FROM x""")  # fmt: skip
def v20_basket_edge(spark, sf_dir):
    """Per horizon: daily rank IC and quintile returns over the last dates with enough names, with a robust t value and the part after a cutoff."""
    f = evaluate(panel_weekly(spark, sf_dir), "ts_mean(returns, 5)", out="composite")
    cells = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("fwd")) for h in EDGES]))
    l = f.select("date", "ticker", "composite", *[b.forward_return(h).alias(f"f{h}") for h in EDGES]).select("date", "ticker", "composite", cells.alias("c")).select("date", "ticker", "composite", "c.*").where("composite is not null and fwd is not null")
    l = staged(l)
    dates = l.select("horizon", "date").distinct().withColumn("age", F.row_number().over(Window.partitionBy("horizon").orderBy(F.desc("date")))).where(F.col("age") <= LAST_DATES)
    at = Window.partitionBy("horizon", "date")
    k = l.join(dates, ["horizon", "date"], "left_semi").withColumn("a", F.row_number().over(at.orderBy("composite", "ticker"))).withColumn("f", F.row_number().over(at.orderBy("fwd", "ticker"))).withColumn("n", F.count("*").over(at)).where(F.col("n") >= BREADTH)
    size = F.greatest(F.lit(1), F.floor(F.col("n") / 5))
    d = k.groupBy("horizon", "date").agg(b.correlation(F.col("a"), F.col("f")).alias("ic"), F.avg(F.when(F.col("a") > F.col("n") - size, F.col("fwd"))).alias("lo"), F.avg(F.when(F.col("a") <= size, F.col("fwd"))).alias("sh")).where("ic is not null")
    d = d.withColumn("mean", F.avg("ic").over(Window.partitionBy("horizon")))
    late = F.col("date") >= F.lit(OUT_OF_SAMPLE).cast("date")
    e = d.groupBy("horizon").agg(
        F.count("*").alias("n_days"), F.first("mean").alias("mean_ic"), F.stddev_samp("ic").alias("sd"), F.avg("lo").alias("lo"), F.avg("sh").alias("sh"), F.avg(F.col("lo") - F.col("sh")).alias("spread"),
        F.transform(F.array_sort(F.collect_list(F.struct("date", (F.col("ic") - F.col("mean")).alias("e")))), lambda x: x["e"]).alias("res"), F.avg(F.when(late, F.col("ic"))).alias("oos_ic"), F.count_if(late).alias("oos_days"),
    )
    x = spark.createDataFrame([(h,) for h in EDGES], "horizon int").join(e, "horizon", "left").withColumn("n_days", F.coalesce("n_days", F.lit(0)))
    enough = F.col("n_days") >= LEAST_DATES
    figures = {"mean_ic": F.col("mean_ic"), "ic_ir": F.when(F.col("sd") != 0, F.col("mean_ic") / F.col("sd")), "long_return": F.col("lo"), "short_return": F.col("sh"), "spread": F.col("spread"), "ic_t": F.col("mean_ic") / newey_west("res"), "oos_ic": F.col("oos_ic")}
    return x.select("horizon", "n_days", (~enough).alias("insufficient"), *[rounded(F.when(enough, c)).alias(n) for n, c in figures.items()], F.when(enough, F.col("oos_days")).otherwise(0).alias("oos_days"))


# -- history --------------------------------------------------------------------------------------------------------

_LEADS = "best AS (SELECT date, arg_max(signal, (round(ic, 9), signal)) AS leader FROM sic GROUP BY date), chg AS (SELECT date, before || '>' || leader AS note, leader AS signal FROM (SELECT *, lag(leader) OVER (ORDER BY date) AS before FROM best) WHERE before <> leader)"


def leader_changes(history: DataFrame) -> DataFrame:
    """date, note, signal: dates on which another signal has the best IC than on the date before (the log of changes)."""
    best = history.where("window_days = 30").groupBy("date").agg(F.max_by("signal", F.struct(F.round("ic", 9), "signal")).alias("leader"))
    c = best.withColumn("before", F.lag("leader").over(_day_line())).where("before <> leader")
    return c.select("date", F.concat_ws(">", "before", "leader").alias("note"), F.col("leader").alias("signal"))


_LEADS30 = _LEADS.replace("FROM sic GROUP", "FROM hist WHERE window_days = 30 GROUP")


@query("v21_ic_annotations", f"""WITH {HIST}, {_LEADS30}, s AS (SELECT signal, window_days, date, ic, lag(ic) OVER (PARTITION BY signal ORDER BY date) AS before FROM hist WHERE window_days = 30), n AS (SELECT date, string_agg(note, ',' ORDER BY note) AS notes FROM chg GROUP BY date)
  SELECT signal, date, round(before, 5) + 0.0 AS previous, round(ic, 5) + 0.0 AS current, round(ic - before, 5) + 0.0 AS delta, (ic > 0 AND before < 0) OR (ic < 0 AND before > 0) AS sign_flip, notes FROM s LEFT JOIN n USING (date) WHERE round(abs(ic - before), 9) >= 0.05 OR (ic > 0 AND before < 0) OR (ic < 0 AND before > 0)""")  # fmt: skip
def v21_ic_annotations(spark, sf_dir):
    """Moves of a signal's IC by 0.05 or over zero, with the changes logged on the same date."""
    h = ic_history(spark, sf_dir)
    s = h.where("window_days = 30").withColumn("before", F.lag("ic").over(_day_line("signal")))
    flip = ((F.col("ic") > 0) & (F.col("before") < 0)) | ((F.col("ic") < 0) & (F.col("before") > 0))
    s = s.where((F.round(F.abs(F.col("ic") - F.col("before")), 9) >= 0.05) | flip)
    notes = leader_changes(h).groupBy("date").agg(F.array_join(F.array_sort(F.collect_list("note")), ",").alias("notes"))
    five = lambda c: F.round(c, 5) + F.lit(0.0)
    return s.join(notes, "date", "left").select("signal", "date", five(F.col("before")).alias("previous"), five(F.col("ic")).alias("current"), five(F.col("ic") - F.col("before")).alias("delta"), flip.alias("sign_flip"), "notes")


@query("v22_ic_around_changes", f"""WITH {HIST}, {_LEADS30} SELECT c.date, c.signal, {r('avg(h.ic) FILTER (h.date < c.date AND h.date >= c.date - 7)')} AS ic_before, {r('avg(h.ic) FILTER (h.date >= c.date AND h.date < c.date + 7)')} AS ic_after
  FROM chg c LEFT JOIN hist h ON h.signal = c.signal AND h.date >= c.date - 7 AND h.date < c.date + 7 GROUP BY c.date, c.signal""")  # fmt: skip
def v22_ic_around_changes(spark, sf_dir):
    """Mean IC of the signal in the week before and after each change: every change lays out its fourteen days, which meet the history by equality."""
    h = ic_history(spark, sf_dir)
    days = leader_changes(h).select(F.col("date").alias("at"), "signal", F.explode(F.sequence(F.date_sub("date", 7), F.date_add("date", 6))).alias("date"))
    j = days.join(h.select("signal", "date", "ic"), ["signal", "date"], "left")
    side = lambda c: rounded(F.avg(F.when(c, F.col("ic"))))
    return j.groupBy(F.col("at"), "signal").agg(side(F.col("date") < F.col("at")).alias("ic_before"), side(F.col("date") >= F.col("at")).alias("ic_after")).withColumnRenamed("at", "date")


@query("v23_weakest_signal", f"WITH {HIST} SELECT signal, {r('ic')} AS ic, date FROM hist WHERE window_days = 30 ORDER BY date DESC, hist.ic, signal LIMIT 1")
def v23_weakest_signal(spark, sf_dir):
    h = ic_history(spark, sf_dir).where("window_days = 30").orderBy(F.desc("date"), "ic", "signal").limit(1)
    return h.select("signal", rounded(F.col("ic")).alias("ic"), "date")


@query("v24_signal_health", f"""WITH {HIST}, rk AS (SELECT *, row_number() OVER (PARTITION BY signal, window_days ORDER BY date DESC) AS age FROM hist WHERE ic IS NOT NULL),
  m AS (SELECT signal, {", ".join(f"max(ic) FILTER (age = 1 AND window_days = {wd}) AS ic_{wd}" for wd in TRAILING)}, CASE WHEN count(*) FILTER (age <= 90 AND window_days = 30) >= 2 AND stddev_samp(ic) FILTER (age <= 90 AND window_days = 30) > 1e-9 THEN avg(ic) FILTER (age <= 90 AND window_days = 30) / stddev_samp(ic) FILTER (age <= 90 AND window_days = 30) END AS icir FROM rk GROUP BY signal),
  ok AS (SELECT signal, max(date) FILTER (z IS NOT NULL) AS last_success, count(*) FILTER (z IS NULL AND date = (SELECT max(date) FROM sig)) AS errors FROM sig GROUP BY signal)
  SELECT signal, {", ".join(f"{r(f'ic_{wd}')} AS ic_{wd}" for wd in TRAILING)}, {r('icir')} AS icir, {r('icir * sqrt(252.0 / 30)')} AS ir, last_success, errors, CASE WHEN least(ic_30, ic_60, ic_90) > 0.02 THEN 'green' WHEN least(ic_30, ic_60, ic_90) > 0.01 THEN 'yellow' WHEN ic_30 IS NULL AND ic_60 IS NULL AND ic_90 IS NULL THEN 'insufficient_data' ELSE 'unknown' END AS health FROM ok LEFT JOIN m USING (signal)""")  # fmt: skip
def v24_signal_health(spark, sf_dir):
    """Each signal's latest IC by window, its ratio over the last 90 readings, the last date it worked, errors of the last day, and a colour."""
    h = ic_history(spark, sf_dir).where("ic is not null").withColumn("age", F.row_number().over(Window.partitionBy("signal", "window_days").orderBy(F.desc("date"))))
    recent = F.when((F.col("age") <= 90) & (F.col("window_days") == 30), F.col("ic"))
    sd = F.stddev_samp(recent)
    m = h.groupBy("signal").agg(*[F.max(F.when((F.col("age") == 1) & (F.col("window_days") == wd), F.col("ic"))).alias(f"ic_{wd}") for wd in TRAILING], F.when((F.count(recent) >= 2) & (sd > 1e-9), F.avg(recent) / sd).alias("icir"))
    s = staged(signals(spark, sf_dir))
    last = s.agg(F.max("date").alias("last"))
    ok = s.join(F.broadcast(last)).groupBy("signal").agg(F.max(F.when(F.col("z").isNotNull(), F.col("date"))).alias("last_success"), F.count_if(F.col("z").isNull() & (F.col("date") == F.col("last"))).alias("errors"))  # one row
    worst = F.least(*[f"ic_{wd}" for wd in TRAILING])
    health = F.when(worst > 0.02, "green").when(worst > 0.01, "yellow").when(worst.isNull(), "insufficient_data").otherwise("unknown")
    return ok.join(m, "signal", "left").select("signal", *[rounded(F.col(f"ic_{wd}")).alias(f"ic_{wd}") for wd in TRAILING], rounded(F.col("icir")).alias("icir"), rounded(F.col("icir") * F.sqrt(F.lit(252.0 / 30))).alias("ir"), "last_success", "errors", health.alias("health"))
