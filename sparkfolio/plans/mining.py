"""Queries of a library of mined expressions: seeds, structure, families, evidence, selection, journal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.functions import expressions as x
from sparkfolio.functions.staging import staged
from sparkfolio.operators import acceptance
from sparkfolio.operators import gram
from sparkfolio.operators.expression import evaluate_apart, evaluate_many, evaluate_wide
from sparkfolio.operators.panel import OPERATORS
from sparkfolio.plans.common import query, rounded
from sparkfolio.plans.common import sql_rounded as r
from sparkfolio.plans.factors import full, w
from sparkfolio.plans.portfolio import many_days
from sparkfolio.sources.market import table
from sparkfolio.sources.tables import WPANEL_SQL, panel_weekly

# -- the seeds ------------------------------------------------------------------------------------------------------


def _roc(n: int) -> str:
    return f"close / nullif(lag(close, {n}) OVER (PARTITION BY ticker ORDER BY date), 0) - 1"


def _t(agg: str, n: int) -> str:
    return full(n, f"{agg} {w(n)}")


def _r(e: str) -> str:
    return f"CASE WHEN ({e}) IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY ({e}) NULLS LAST, ticker) / CAST(count({e}) OVER (PARTITION BY date) AS DOUBLE) END"


def _z(c: str, n: int) -> str:
    return full(n, f"CASE WHEN stddev_pop({c}) {w(n)} > 1e-12 THEN ({c} - avg({c}) {w(n)}) / stddev_pop({c}) {w(n)} END")


def _decay(c: str, n: int) -> str:
    return full(n, f"(sum(rn * {c}) {w(n)} + ({n} - rn) * sum({c}) {w(n)}) / nullif(sum(CASE WHEN {c} IS NOT NULL THEN rn END) {w(n)} + ({n} - rn) * count({c}) {w(n)}, 0)")


_CORR20 = full(20, f"CASE WHEN stddev_pop(volume) {w(20)} > 1e-12 AND stddev_pop(returns) {w(20)} > 1e-12 THEN (avg(volume * returns) {w(20)} - avg(volume) {w(20)} * avg(returns) {w(20)}) / (stddev_pop(volume) {w(20)} * stddev_pop(returns) {w(20)}) END")
#: The short-horizon seeds: name, expression, lookback, category; and inner columns and final SQL of each.
SEEDS = [
    ("ROC5", "subtract(divide(close, ts_delay(close, 5)), 1.0)", 5, "momentum", {}, _roc(5)),
    ("ROC10", "subtract(divide(close, ts_delay(close, 10)), 1.0)", 10, "momentum", {}, _roc(10)),
    ("ROC20", "subtract(divide(close, ts_delay(close, 20)), 1.0)", 20, "momentum", {}, _roc(20)),
    ("ROC5_RANK", "rank(subtract(divide(close, ts_delay(close, 5)), 1.0))", 5, "momentum", {"roc5": _roc(5)}, _r("roc5")),
    ("ROC20_RANK", "rank(subtract(divide(close, ts_delay(close, 20)), 1.0))", 20, "momentum", {"roc20": _roc(20)}, _r("roc20")),
    ("RANK_MEAN_RET_5", "rank(ts_mean(returns, 5))", 5, "momentum", {"mr5": _t("avg(returns)", 5)}, _r("mr5")),
    ("RANK_MEAN_RET_20", "rank(ts_mean(returns, 20))", 20, "momentum", {"mr20": _t("avg(returns)", 20)}, _r("mr20")),
    ("MA5_DIST", "subtract(divide(close, ts_mean(close, 5)), 1.0)", 5, "trend", {}, f"close / nullif({_t('avg(close)', 5)}, 0) - 1"),
    ("MA10_DIST", "subtract(divide(close, ts_mean(close, 10)), 1.0)", 10, "trend", {}, f"close / nullif({_t('avg(close)', 10)}, 0) - 1"),
    ("MA20_DIST", "subtract(divide(close, ts_mean(close, 20)), 1.0)", 20, "trend", {}, f"close / nullif({_t('avg(close)', 20)}, 0) - 1"),
    ("MAX20_DIST", "subtract(divide(close, ts_max(close, 20)), 1.0)", 20, "trend", {}, f"close / nullif({_t('max(close)', 20)}, 0) - 1"),
    ("MIN20_DIST", "subtract(divide(close, ts_min(close, 20)), 1.0)", 20, "trend", {}, f"close / nullif({_t('min(close)', 20)}, 0) - 1"),
    ("STD5", "ts_std(returns, 5)", 5, "volatility", {}, _t("stddev_pop(returns)", 5)),
    ("STD10", "ts_std(returns, 10)", 10, "volatility", {}, _t("stddev_pop(returns)", 10)),
    ("STD20", "ts_std(returns, 20)", 20, "volatility", {}, _t("stddev_pop(returns)", 20)),
    ("HL_RANGE_20", "divide(subtract(ts_max(high, 20), ts_min(low, 20)), close)", 20, "volatility", {}, f"({_t('max(high)', 20)} - {_t('min(low)', 20)}) / nullif(close, 0)"),
    ("LOW_STD_20", "subtract(0.0, ts_std(returns, 20))", 20, "low_vol", {}, f"0 - {_t('stddev_pop(returns)', 20)}"),
    ("VOL_RATIO_5", "divide(volume, ts_mean(volume, 5))", 5, "liquidity", {}, f"volume / nullif({_t('avg(volume)', 5)}, 0)"),
    ("VOL_RATIO_20", "divide(volume, ts_mean(volume, 20))", 20, "liquidity", {}, f"volume / nullif({_t('avg(volume)', 20)}, 0)"),
    ("DOLLAR_VOL_RANK", "rank(multiply(close, volume))", 1, "liquidity", {"cv": "close * volume"}, _r("cv")),
    ("VOL_ZSCORE_20", "ts_zscore(volume, 20)", 20, "liquidity", {}, _z("volume", 20)),
    ("STOCH_20", "divide(subtract(close, ts_min(close, 20)), subtract(ts_max(close, 20), ts_min(close, 20)))", 20, "oscillator", {}, f"(close - {_t('min(close)', 20)}) / nullif({_t('max(close)', 20)} - {_t('min(close)', 20)}, 0)"),
    ("STOCH_5", "divide(subtract(close, ts_min(close, 5)), subtract(ts_max(close, 5), ts_min(close, 5)))", 5, "oscillator", {}, f"(close - {_t('min(close)', 5)}) / nullif({_t('max(close)', 5)} - {_t('min(close)', 5)}, 0)"),
    ("RET_ZSCORE_20", "ts_zscore(returns, 20)", 20, "oscillator", {}, _z("returns", 20)),
    ("REVERSAL_5", "subtract(0.0, subtract(divide(close, ts_delay(close, 5)), 1.0))", 5, "reversal", {}, f"0 - ({_roc(5)})"),
    ("REVERSAL_1", "subtract(0.0, returns)", 1, "reversal", {}, "0 - returns"),
    ("VOL_RET_CORR_20", "ts_corr(volume, returns, 20)", 20, "confirmation", {}, _CORR20),
    ("DECAY_RET_20", "ts_decay_linear(returns, 20)", 20, "momentum", {}, _decay("returns", 20)),
    ("DECAY_VOL_20", "ts_decay_linear(volume, 20)", 20, "liquidity", {}, _decay("volume", 20)),
    ("MOMVOL_10", "subtract(rank(ts_mean(returns, 10)), rank(ts_std(returns, 10)))", 10, "composite", {"mr10": _t("avg(returns)", 10), "sr10": _t("stddev_pop(returns)", 10)}, f"{_r('mr10')} - {_r('sr10')}"),
    ("MOMVOL_20", "subtract(rank(ts_mean(returns, 20)), rank(ts_std(returns, 20)))", 20, "composite", {"mr20": _t("avg(returns)", 20), "sr20": _t("stddev_pop(returns)", 20)}, f"{_r('mr20')} - {_r('sr20')}"),
]
_INNER = {k: v for s in SEEDS for k, v in s[4].items()}


def seeds(longest: int | None = None, category: str | None = None) -> dict[str, str]:
    """Names and expressions of the seeds, by their lookback and category if asked."""
    return {n: e for n, e, look, cat, *_ in SEEDS if (longest is None or look <= longest) and (category is None or cat == category)}


_SEED_SQL = f"WITH {WPANEL_SQL}, inn AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _INNER.items())} FROM wpanel) "


@query("e2_all_seeds", _SEED_SQL + " UNION ALL ".join(f"SELECT '{n}' AS factor_name, date, ticker, round(CAST({s} AS DOUBLE), 9) + 0.0 AS value FROM inn" for n, _, _, _, _, s in SEEDS))
def e2_all_seeds(spark, sf_dir):
    """All 31 seeds on the weekly panel, long: those by ticker from the exchange of its lines, and what is ranked goes on to the dates."""
    long = evaluate_apart(panel_weekly(spark, sf_dir, places=False), seeds())
    return long.withColumn("value", F.round("value", 9) + F.lit(0.0))


@query("e2_short_momentum_seeds", _SEED_SQL + " UNION ALL ".join(f"SELECT '{n}' AS factor_name, date, ticker, round(CAST({s} AS DOUBLE), 9) + 0.0 AS value FROM inn" for n, _, look, cat, _, s in SEEDS if look <= 10 and cat == "momentum"))
def e2_short_momentum_seeds(spark, sf_dir):
    """Only the seeds of one category with a short lookback."""
    return evaluate_many(panel_weekly(spark, sf_dir), seeds(10, "momentum")).withColumn("value", F.round("value", 9) + F.lit(0.0))


# -- mined alphas: one row per order, its expression and outcome from the order's keys ------------------------------

_EXPRESSIONS = [
    "rank(divide(operating_income, cap))", "ts_rank(divide(volume, adv20), 10)", "ts_corr(close, volume, 20)", "divide(gross_profit, assets)", "ts_delta(close, 5)", "ts_sum(returns, 252)",
    "rank(ts_std_dev(returns, 20))", "subtract(implied_volatility_call_60, implied_volatility_call_180)", "subtract(implied_volatility_call_30, implied_volatility_call_90)", "rank(implied_volatility_mean_30)", "ts_delta(pcr_oi_20, 5)", "divide(anl4_eps_high, anl4_eps_low)", "divide(open, ts_delay(close, 1))", "rank( divide(debt, equity))",
    "snt1_d1_netearnings", "rank(add(volume, 1))",
]
_E = "CASE o_custkey % 16 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EXPRESSIONS)) + " END"
_ALPHA = {
    "id": "o_orderkey",
    "expression": _E,
    "outcome": "CASE WHEN o_orderkey % 10 < 3 THEN 'passed' WHEN o_orderkey % 10 < 5 THEN 'flagged' WHEN o_orderkey % 10 < 9 THEN 'rejected' ELSE 'error' END",
    "sharpe": "CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 200000 - 1 END",
    "self_correlation": "CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 100 AS DOUBLE) / 100 END",
    "grade": "CASE o_orderpriority WHEN '1-URGENT' THEN 'EXCELLENT' WHEN '2-HIGH' THEN 'GOOD' ELSE 'AVERAGE' END",
    "fail_checks": "CASE WHEN o_orderkey % 5 = 0 THEN 'HIGH_TURNOVER, CONCENTRATED_WEIGHT' WHEN o_orderkey % 5 = 1 THEN 'LOW_SUB_UNIVERSE_SHARPE' ELSE '' END",
    "reject_reason": "CASE o_orderkey % 7 WHEN 0 THEN 'Redundant with saved' WHEN 1 THEN 'degenerate x-x' WHEN 2 THEN 'canned test' WHEN 3 THEN 'only one fold' WHEN 4 THEN 'all NaN' WHEN 5 THEN '' ELSE 'too slow for ' || o_orderpriority END",
    "created": "CAST(o_orderdate AS DATE)",
}
ALPHAS = f"alphas AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _ALPHA.items())} FROM orders)"


def alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, expression, outcome, sharpe, self_correlation, grade, fail_checks, reject_reason, created of mined expressions."""
    return table(spark, sf_dir, "orders").select(*[F.expr(e).alias(n) for n, e in _ALPHA.items()])


@query("e5_structural_dedup", f"""WITH {ALPHAS}, k AS (SELECT id, expression, regexp_replace(expression, ' ', '', 'g') AS s FROM alphas), v AS (SELECT min(id) AS id, arg_min(expression, id) AS expression, count(*) AS copies FROM k GROUP BY s) SELECT id, expression, copies FROM v""")
def e5_structural_dedup(spark, sf_dir):
    """One of the expressions with the same structure: each side's order under a sum or product, and blanks, do not matter. Distinct texts are hashed once."""
    a = alphas(spark, sf_dir).select("id", "expression")
    # every other copy is written with its sum turned round, which is the same expression
    a = a.withColumn("written", F.when(F.col("id") % 2 == 0, F.concat("expression", F.lit(" + close"))).otherwise(F.concat(F.lit("close + "), "expression")))
    texts = a.select("written").distinct().withColumn("hash", x.structure_hash(F.col("written")))
    h = a.join(texts, "written")
    return h.groupBy("hash").agg(F.min("id").alias("id"), F.min_by("expression", "id").alias("expression"), F.count("*").alias("copies")).drop("hash")


@query("m4_incremental_contribution")
def m4_incremental_contribution(spark, sf_dir):
    """What a candidate adds to its nearest neighbours: 1 - R² of its returns on theirs, from 60 dates on.

    The nearest come from blocked Gram matrices; then a candidate's dates meet those of at most twelve neighbours, which is
    a group's size.
    """
    lr = staged(many_days(spark, sf_dir).where("net is not null").select(F.col("strategy").alias("name"), "date", F.col("net").alias("value")))
    p = gram.pair_sums(lr).select("a", "b", F.abs(gram.correlation()).alias("c")).where("c is not null")
    c = p.toDF("candidate", "saved", "c").union(p.select("b", "a", "c"))
    near = c.withColumn("k", F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc("c"), "saved"))).where("k <= 12").drop("c")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date", columns="k", values="v").sort_index()
        y = pdf.drop_duplicates("date").set_index("date")["y"].sort_index().to_numpy(dtype=float)
        k = max(1, min(wide.shape[1], len(y) // 4))
        design = np.column_stack([np.ones(len(y)), wide.to_numpy(dtype=float)[:, :k]])
        whole = ~np.isnan(design).any(axis=1)
        partner = pdf.loc[pdf["k"] == pdf["k"].min(), "saved"].iloc[0]
        share = 1.0
        if len(y) >= 60 and whole.sum() >= max(60, k + 2):
            y, design = y[whole], design[whole]
            total = float(((y - y.mean()) ** 2).sum())
            beta, *_ = np.linalg.lstsq(design, y, rcond=None)
            share = 0.0 if total < 1e-18 else min(1.0, max(0.0, float(((y - design @ beta) ** 2).sum()) / total))
        return pd.DataFrame({"candidate": [key[0]], "nearest": [partner], "new_share": [share]})

    rows = near.join(lr.toDF("saved", "date", "v"), "saved").join(lr.toDF("candidate", "date", "y"), ["candidate", "date"])
    return rows.select("candidate", "saved", "k", "date", "y", "v").groupBy("candidate").applyInPandas(run, "candidate string, nearest string, new_share double").withColumn("new_share", rounded(F.col("new_share")))


_RATIO_SQL = "regexp_extract_all(expression, 'divide\\(\\s*([a-z0-9_]+)\\s*,\\s*([a-z0-9_]+)\\s*\\)', {k})"


@query("m6_ratio_usage", f"""WITH {ALPHAS}, p AS (SELECT unnest({_RATIO_SQL.format(k=1)}) AS a, unnest({_RATIO_SQL.format(k=2)}) AS z FROM alphas), c AS (SELECT a || '/' || z AS ratio, count(*) AS uses FROM p GROUP BY ALL),
  f AS (SELECT count(*) FILTER (outcome = 'flagged') / CAST(count(*) FILTER (outcome IN ('flagged', 'passed', 'rejected')) AS DOUBLE) AS rate, count(DISTINCT regexp_replace(regexp_replace(expression, '[0-9]+', 'N', 'g'), ' ', '', 'g')) AS signatures FROM alphas)
  SELECT ratio, uses, {r('rate')} AS flagged_rate, rate >= 0.4 AS prefer_industry, signatures FROM c, f""")  # fmt: skip
def m6_ratio_usage(spark, sf_dir):
    """How often each ratio of two fields is used, the share of flagged alphas, and how many structures there are."""
    a = alphas(spark, sf_dir)
    c = a.select(F.explode(x.ratios(F.col("expression"))).alias("ratio")).groupBy("ratio").agg(F.count("*").alias("uses"))
    rate = F.try_divide(F.count_if(F.col("outcome") == "flagged"), F.count_if(F.col("outcome").isin("flagged", "passed", "rejected")))
    f = a.agg(rate.alias("rate"), F.countDistinct(x.signature(F.col("expression"))).alias("signatures"))
    return c.join(F.broadcast(f)).select("ratio", "uses", rounded(F.col("rate")).alias("flagged_rate"), (F.col("rate") >= 0.4).alias("prefer_industry"), "signatures")  # one row


@query("m7_economic_families", f"WITH {ALPHAS} SELECT {x.sql_family('expression')} AS family, count(*) AS n, {r('avg(sharpe)')} AS mean_sharpe FROM alphas GROUP BY ALL")
def m7_economic_families(spark, sf_dir):
    return alphas(spark, sf_dir).groupBy(x.family(F.col("expression")).alias("family")).agg(F.count("*").alias("n"), rounded(F.avg("sharpe")).alias("mean_sharpe"))


#: How many passers of a family the book takes.
CAPS = {
    "value": 1, "options": 2, "revision": 2, "momentum": 2, "lowvol": 2, "sentiment": 2, "score": 3, "microstructure": 3, "seasonality": 2, "overnight": 2, "iv_term": 2, "iv_skew_dynamics": 2, "iv_momentum": 2,
    "pcr_dynamics": 2, "option_breakeven": 2, "vrp": 2, "quality": 2, "dispersion": 2,
}
_CAP = "CASE family " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CAPS.items()) + " ELSE 2 END"


@query("m8_book_saturation", f"""WITH {ALPHAS}, p AS (SELECT id, {x.sql_family('expression')} AS family, sharpe FROM alphas WHERE outcome = 'passed'), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY sharpe DESC NULLS LAST, id) AS place FROM p)
  SELECT id, family, CASE WHEN place <= {_CAP} THEN 'kept' ELSE 'family_saturated' END AS status FROM k""")  # fmt: skip
def m8_book_saturation(spark, sf_dir):
    """Passers beyond their family's cap are flagged: the cap is small, so each family's first few are found by an aggregate, and no family is sorted in one task."""
    p = alphas(spark, sf_dir).where("outcome = 'passed'").select("id", "sharpe", x.family(F.col("expression")).alias("family"))
    most = max(CAPS.values())
    order = F.struct(F.coalesce(-F.col("sharpe"), F.lit(float("inf"))).alias("s"), "id")
    part = p.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = part.withColumn("k", F.row_number().over(Window.partitionBy("family", "salt").orderBy(F.col("sharpe").desc_nulls_last(), "id"))).where(F.col("k") <= most)
    best = first.groupBy("family").agg(F.slice(F.array_sort(F.collect_list(order)), 1, most).alias("best"))
    kept = best.select("family", F.posexplode("best").alias("k", "o")).where(F.expr(f"k < {_CAP}")).select(F.col("o.id").alias("id"), F.lit("kept").alias("kept"))
    return p.join(F.broadcast(kept), "id", "left").select("id", "family", F.coalesce("kept", F.lit("family_saturated")).alias("status"))  # three rows a family at most


_HAS = lambda check: f"list_contains(list_transform(string_split(coalesce(fail_checks, ''), ','), lambda c: trim(c)), '{check}')"
CHECKS = {"CONCENTRATED_WEIGHT": "concentrated", "LOW_SUB_UNIVERSE_SHARPE": "low_sub_universe", "HIGH_TURNOVER": "high_turnover"}


@query("m9_mechanism_evidence", f"""WITH {ALPHAS} SELECT {x.sql_family('expression')} AS mechanism, count(*) AS attempts, count(*) FILTER (grade IN ('GOOD', 'EXCELLENT', 'SPECTACULAR')) AS good, count(*) FILTER (outcome IN ('passed', 'flagged')) AS gates_passed, count(*) FILTER (outcome = 'passed') AS passed,
  {", ".join(f"count(*) FILTER ({_HAS(c)}) AS {n}" for c, n in CHECKS.items())}, count(self_correlation) AS self_corr_checked, count(*) FILTER (self_correlation < 0.70) AS self_corr_passed, {r('avg(sharpe)')} AS mean_sharpe FROM alphas GROUP BY ALL""")  # fmt: skip
def m9_mechanism_evidence(spark, sf_dir):
    """Attempts, grades, failures by kind and correlations per mechanism."""
    failed = F.transform(F.split(F.coalesce("fail_checks", F.lit("")), ","), lambda c: F.btrim(c))
    return alphas(spark, sf_dir).groupBy(x.family(F.col("expression")).alias("mechanism")).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("grade").isin("GOOD", "EXCELLENT", "SPECTACULAR")).alias("good"), F.count_if(F.col("outcome").isin("passed", "flagged")).alias("gates_passed"), F.count_if(F.col("outcome") == "passed").alias("passed"),
        *[F.count_if(F.array_contains(failed, c)).alias(n) for c, n in CHECKS.items()], F.count("self_correlation").alias("self_corr_checked"), F.count_if(F.col("self_correlation") < 0.70).alias("self_corr_passed"), rounded(F.avg("sharpe")).alias("mean_sharpe"),
    )


#: Settings of an alpha as its row has them, and the data set of a field, by order and name; some are missing.
_SETTINGS = """CASE WHEN id % 9 = 0 THEN NULL ELSE '{{"universe": ' || CASE WHEN id % 4 = 0 THEN '""' ELSE '"TOP' || CAST(1000 * (id % 3 + 1) AS {text}) || '"' END || ', "delay": ' || CAST(id % 2 AS {text}) || ', "decay": ' || CAST(id % 23 AS {text})
  || ', "truncation": ' || CASE id % 5 WHEN 0 THEN '0' WHEN 1 THEN '0.04' WHEN 2 THEN '0.06' WHEN 3 THEN '0.1' ELSE 'null' END || '}}' END"""
_DATASET = "CASE WHEN field LIKE 'implied%' THEN 'option8' WHEN field LIKE 'pcr%' THEN 'option9' WHEN field LIKE 'anl4%' THEN 'analyst4' WHEN field IN ('close', 'open', 'volume', 'returns') THEN 'pv1' WHEN field IN ('assets', 'debt', 'equity', 'cap') THEN 'fundamental6' END"
_GOOD = ("GOOD", "EXCELLENT", "SPECTACULAR")


def settings_context(settings: Column) -> Column:
    """Universe, neutralization, delay and buckets of decay and truncation of settings in JSON, joined by bars; what is missing or empty is unknown, or the default."""
    j = F.from_json(settings, "universe string, neutralization string, delay string, decay int, truncation double")
    known = lambda c: F.coalesce(F.nullif(j[c], F.lit("")), F.lit("unknown"))
    decay, truncation = F.coalesce(j["decay"], F.lit(0)), F.coalesce(F.nullif(j["truncation"], F.lit(0.0)), F.lit(0.08))
    of_decay = F.when(decay == 0, "0").when(decay <= 8, "1-8").when(decay <= 16, "9-16").otherwise("17+")
    of_truncation = F.when(truncation <= 0.04, "<=.04").when(truncation < 0.08, ".04-.08").otherwise(">=.08")
    delay = F.concat(F.lit("d"), F.coalesce(j["delay"], F.lit("unknown")))
    return F.concat_ws("|", known("universe"), known("neutralization"), delay, F.concat(F.lit("decay:"), of_decay), F.concat(F.lit("trunc:"), of_truncation))


_CONTEXT_SQL = """concat_ws('|', coalesce(nullif(settings ->> '$.universe', ''), 'unknown'), coalesce(nullif(settings ->> '$.neutralization', ''), 'unknown'), 'd' || coalesce(settings ->> '$.delay', 'unknown'),
  'decay:' || CASE WHEN decay = 0 THEN '0' WHEN decay <= 8 THEN '1-8' WHEN decay <= 16 THEN '9-16' ELSE '17+' END, 'trunc:' || CASE WHEN truncation <= 0.04::DOUBLE THEN '<=.04' WHEN truncation < 0.08::DOUBLE THEN '.04-.08' ELSE '>=.08' END)"""


@query("m9_context_evidence", f"""WITH {ALPHAS}, s AS (SELECT *, CAST({_SETTINGS.format(text="VARCHAR")} AS JSON) AS settings FROM alphas),
  c AS (SELECT *, coalesce(CAST(settings ->> '$.decay' AS INTEGER), 0) AS decay, coalesce(nullif(CAST(settings ->> '$.truncation' AS DOUBLE), 0), 0.08::DOUBLE) AS truncation FROM s),
  m AS (SELECT DISTINCT field, {_DATASET} AS dataset FROM (SELECT unnest(regexp_extract_all(expression, '[A-Za-z_][A-Za-z0-9_]*')) AS field FROM alphas)),
  d AS (SELECT expression, string_agg(dataset, '+' ORDER BY dataset) AS datasets FROM (SELECT DISTINCT expression, dataset FROM (SELECT expression, unnest(regexp_extract_all(expression, '[A-Za-z_][A-Za-z0-9_]*')) AS field FROM (SELECT DISTINCT expression FROM alphas)) JOIN m USING (field) WHERE dataset IS NOT NULL) GROUP BY expression)
  SELECT {x.sql_family('expression')} || '|' || coalesce(datasets, 'unmapped') || '|' || {_CONTEXT_SQL} AS context, count(*) AS attempts, count(*) FILTER (grade IN {_GOOD}) AS good, count(*) FILTER (outcome IN ('passed', 'flagged')) AS gates_passed, count(*) FILTER (outcome = 'passed') AS passed,
  count(self_correlation) AS self_corr_checked, count(*) FILTER (self_correlation < 0.70) AS self_corr_passed, {r('avg(sharpe)')} AS mean_sharpe FROM c LEFT JOIN d USING (expression) GROUP BY ALL""")  # fmt: skip
def m9_context_evidence(spark, sf_dir):
    """Evidence by research context: mechanism, the data sets of the fields used, and settings. Fields are looked up once for each distinct expression."""
    a = alphas(spark, sf_dir)
    names = lambda e: F.regexp_extract_all(e, F.lit(f"({x.NAME})"), F.lit(1))
    fields = a.select("expression").distinct().select("expression", F.explode(F.array_distinct(names(F.col("expression")))).alias("field"))
    metadata = fields.select("field").distinct().withColumn("dataset", F.expr(_DATASET)).where("dataset is not null")
    of = fields.join(metadata, "field").groupBy("expression").agg(F.array_join(F.array_sort(F.collect_set("dataset")), "+").alias("datasets"))  # data sets of one expression
    c = a.withColumn("settings", F.expr(_SETTINGS.format(text="STRING"))).join(of, "expression", "left")
    context = F.concat_ws("|", x.family(F.col("expression")), F.coalesce("datasets", F.lit("unmapped")), settings_context(F.col("settings")))
    return c.groupBy(context.alias("context")).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("grade").isin(*_GOOD)).alias("good"), F.count_if(F.col("outcome").isin("passed", "flagged")).alias("gates_passed"), F.count_if(F.col("outcome") == "passed").alias("passed"),
        F.count("self_correlation").alias("self_corr_checked"), F.count_if(F.col("self_correlation") < 0.70).alias("self_corr_passed"), rounded(F.avg("sharpe")).alias("mean_sharpe"),
    )


TARGET = 30


@query("m10_diverse_selection", f"""WITH {ALPHAS}, d AS (SELECT expression, max(sharpe) AS score FROM alphas WHERE sharpe IS NOT NULL GROUP BY expression), g AS (SELECT *, {x.sql_family('expression')} AS family FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, expression) AS depth, max(score) OVER (PARTITION BY family) AS best FROM g)
  SELECT expression, family, depth, row_number() OVER (ORDER BY depth, best DESC, family) AS place FROM k ORDER BY place LIMIT {TARGET}""")  # fmt: skip
def m10_diverse_selection(spark, sf_dir):
    """Distinct expressions taken one of each family before any second one: by depth in the family, families in the order of their best."""
    d = alphas(spark, sf_dir).where("sharpe is not null").groupBy("expression").agg(F.max("sharpe").alias("score")).withColumn("family", x.family(F.col("expression")))
    own = Window.partitionBy("family")
    k = d.withColumn("depth", F.row_number().over(own.orderBy(F.desc("score"), "expression"))).withColumn("best", F.max("score").over(own))
    top = k.orderBy("depth", F.desc("best"), "family").limit(TARGET)
    return top.select("expression", "family", "depth", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("depth", F.desc("best"), "family")).alias("place"))


@query("m11_alpha_listing", f"WITH {ALPHAS} SELECT id, outcome, {r('sharpe')} AS sharpe, (SELECT count(*) FROM alphas WHERE outcome IN ('passed', 'flagged')) AS total FROM alphas WHERE outcome IN ('passed', 'flagged') ORDER BY alphas.sharpe DESC NULLS LAST, id LIMIT 25 OFFSET 50")
def m11_alpha_listing(spark, sf_dir):
    """One page of a filtered and sorted listing, with the number of all its rows."""
    a = alphas(spark, sf_dir).where("outcome in ('passed', 'flagged')")
    page = a.orderBy(F.col("sharpe").desc_nulls_last(), "id").offset(50).limit(25)
    return page.join(F.broadcast(a.agg(F.count("*").alias("total")))).select("id", "outcome", rounded(F.col("sharpe")).alias("sharpe"), "total")  # one row


@query("m12_reject_reasons", f"WITH {ALPHAS}, c AS (SELECT {x.sql_reason_class('reject_reason')} AS pattern, count(*) AS n FROM alphas WHERE outcome = 'rejected' AND reject_reason IS NOT NULL GROUP BY ALL) SELECT pattern, n FROM c ORDER BY n DESC, pattern LIMIT 6")
def m12_reject_reasons(spark, sf_dir):
    """The six commonest kinds of rejections."""
    c = alphas(spark, sf_dir).where("outcome = 'rejected' and reject_reason is not null").groupBy(x.reason_class(F.col("reject_reason")).alias("pattern")).agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "pattern").limit(6)


@query("m12_tried_expressions", f"""WITH {ALPHAS}, t AS (SELECT expression, max(created) AS latest, count(*) FILTER (outcome = 'passed' AND coalesce(self_correlation, 0) >= 0.5) AS flagged, count(*) FILTER (outcome = 'passed' AND NOT coalesce(self_correlation, 0) >= 0.5) AS validated FROM alphas GROUP BY expression)
  SELECT expression, latest, flagged, validated, array_to_string(list_distinct_in_order, ',') AS operators FROM (SELECT *, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(regexp_extract_all(expression, '([a-z_][a-z0-9_]*)\\s*\\(', 1), lambda o: [o])), lambda acc, o: CASE WHEN list_contains(acc, o[1]) THEN acc ELSE list_concat(acc, o) END) AS list_distinct_in_order FROM t)""")  # fmt: skip
def m12_tried_expressions(spark, sf_dir):
    """Distinct expressions by their latest attempt, their operators, and how many of their passers are flagged by correlation or validated."""
    risky = F.coalesce("self_correlation", F.lit(0.0)) >= 0.5
    passed = F.col("outcome") == "passed"
    t = alphas(spark, sf_dir).groupBy("expression").agg(F.max("created").alias("latest"), F.count_if(passed & risky).alias("flagged"), F.count_if(passed & ~risky).alias("validated"))
    return t.select("expression", "latest", "flagged", "validated", F.array_join(x.operators(F.col("expression")), ",").alias("operators"))


#: Evidence of a proposal as its row has it; some have none, and some no skeptic.
_EVIDENCE = """CASE WHEN id % 13 = 0 THEN NULL ELSE '{{"source": "miner", "self_correlation": ' || CASE WHEN id % 6 = 0 THEN 'null' ELSE CAST(id % 100 AS {text}) || 'e-2' END
  || CASE WHEN id % 7 = 0 THEN '' ELSE ', "skeptic": {{"risk_level": "' || CASE id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END || '", "concerns": ["c' || CAST(id % 3 AS {text}) || '"]}}' END || '}}' END"""
#: A pending proposal needs scrutiny from this correlation with a saved factor on; how many the briefing holds.
RISKY_CORRELATION, PENDING = 0.5, 50


@query("m12_pending_briefing", f"""WITH {ALPHAS}, p AS (SELECT id, expression, CAST({_EVIDENCE.format(text="VARCHAR")} AS JSON) AS ev FROM alphas WHERE outcome = 'flagged' ORDER BY id DESC LIMIT {PENDING}),
  q AS (SELECT id, expression, ev ->> '$.source' AS source, coalesce(CAST(ev ->> '$.self_correlation' AS DOUBLE), 0) AS self_correlation, ev ->> '$.skeptic.risk_level' AS risk_level, CAST(coalesce(json_array_length(ev, '$.skeptic.concerns'), 0) AS BIGINT) AS n_concerns FROM p)
  SELECT *, CASE WHEN coalesce(risk_level IN ('medium', 'high'), false) OR self_correlation >= {RISKY_CORRELATION}::DOUBLE THEN 'flagged' ELSE 'validated' END AS bucket FROM q""")  # fmt: skip
def m12_pending_briefing(spark, sf_dir):
    """The newest pending proposals: flagged by the skeptic's risk or by correlation with a saved factor, else validated."""
    p = alphas(spark, sf_dir).where("outcome = 'flagged'").select("id", "expression").orderBy(F.desc("id")).limit(PENDING)
    ev = F.from_json(F.expr(_EVIDENCE.format(text="STRING")), "source string, self_correlation double, skeptic struct<risk_level:string,concerns:array<string>>")
    q = p.withColumn("ev", ev).select(
        "id", "expression", F.col("ev.source").alias("source"), F.coalesce("ev.self_correlation", F.lit(0.0)).alias("self_correlation"), F.col("ev.skeptic.risk_level").alias("risk_level"),
        F.coalesce(F.size("ev.skeptic.concerns"), F.lit(0)).cast("long").alias("n_concerns"),
    )
    risky = F.coalesce(F.col("risk_level").isin("medium", "high"), F.lit(False)) | (F.col("self_correlation") >= RISKY_CORRELATION)
    return q.withColumn("n_concerns", F.greatest("n_concerns", F.lit(0))).withColumn("bucket", F.when(risky, "flagged").otherwise("validated"))


# -- caller's operators ---------------------------------------------------------------------------------------------


@query("u1_own_operators", f"WITH {WPANEL_SQL} SELECT date, ticker, {r('2 * close')} AS twice, {r('abs(close)')} AS built_in, {r(full(4, f'max(close) {w(4)} - min(close) {w(4)}'))} AS ranged FROM wpanel")
def u1_own_operators(spark, sf_dir):
    """Operators of the caller in expressions; a built-in name always wins."""
    own = {
        "twice": lambda p, c: c * 2,
        "abs": lambda p, c: c * 0,
        "ranged": lambda p, c, n: p.when_full(n, F.max(c).over(p.last(n)) - F.min(c).over(p.last(n))),
    }
    df = evaluate_wide(panel_weekly(spark, sf_dir), {"twice": "twice(close)", "built_in": "abs(close)", "ranged": "ranged(close, 4)"}, operators=own)
    return df.select("date", "ticker", *[rounded(F.col(c)).alias(c) for c in ("twice", "built_in", "ranged")])


@query("u2_operator_acceptance", f"""WITH {WPANEL_SQL}, e AS (SELECT min(date) + CAST(date_diff('day', min(date), max(date)) // 2 AS INTEGER) AS middle FROM wpanel), f AS (SELECT min(date) AS first FROM wpanel, e WHERE date > middle),
  n AS (SELECT count(*) AS n, count(*) FILTER (ticker % 5 = 0) AS gone, count(*) FILTER (date = first AND ticker % 5 <> 0 AND close IS NOT NULL) AS seen FROM wpanel, f)
  SELECT v.* FROM n, LATERAL (VALUES ('twice', n.n, n.n, 0::BIGINT, 0::BIGINT, true), ('mean', n.n, n.n, 0::BIGINT, 0::BIGINT, true), ('fills', n.n, n.n, n.gone, 0::BIGINT, false), ('doubles', n.n, 2 * n.n, 0::BIGINT, 0::BIGINT, false), ('next', n.n, n.n, 0::BIGINT, n.seen, false)) v(operator, n_rows, n_out, leaks, peeks, ok)""")  # fmt: skip
def u2_operator_acceptance(spark, sf_dir):
    """What new operators do to the weekly panel, whose fifth tickers have lost their closes: rows must stay, what is missing must stay missing, and nothing may hang on what comes later."""

    def doubles(p, c):
        p.df = p.df.unionAll(p.df)
        return c

    tried = {"twice": lambda p, c: c * 2, "mean": OPERATORS["ts_mean"], "fills": lambda p, c: F.coalesce(c, F.lit(0.0)), "doubles": doubles, "next": lambda p, c: F.lead(c).over(p.history)}
    df = staged(panel_weekly(spark, sf_dir).select("ticker", "date", F.when(F.col("ticker") % 5 != 0, F.col("close")).alias("v")))
    return acceptance.report(df, tried, {"mean": (4,)})
