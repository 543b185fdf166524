"""Queries of the expression operators: elementwise, rolling, cross-section, group and series dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.functions.series import SERIES
from sparkfolio.operators.expression import evaluate, evaluate_many, evaluate_wide
from sparkfolio.plans.common import query, rounded, sql_rounded
from sparkfolio.sources.market import PANEL_SQL, PRICES_SQL, panel, prices_daily

WT = "PARTITION BY ticker ORDER BY date"


def w(n: int) -> str:
    """An aggregate's window over the last n sessions."""
    return f"OVER ({WT} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(n: int, expression: str) -> str:
    return f"CASE WHEN rn >= {n} THEN {expression} END"


def _register(name: str, columns: dict[str, tuple[str, str]], ctes: str = "", source: str = "panel") -> None:
    """A query of one column per expression, and its SQL per column."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = evaluate_wide(panel(spark, sf_dir), {out: expression for out, (expression, _) in columns.items()})
        return df.select("date", "ticker", *[rounded(F.col(c)).alias(c) for c in columns])

    sql = f"WITH {PANEL_SQL}{ctes} SELECT date, ticker, " + ", ".join(f"{sql_rounded(f'CAST({s} AS DOUBLE)')} AS {c}" for c, (_, s) in columns.items()) + f" FROM {source}"
    query(name, sql)(run)


_register("a1_arithmetic", {
    "abs_v": ("abs(subtract(close, open))", "abs(close - open)"),
    "add_v": ("add(close, volume)", "close + volume"),
    "mul_v": ("multiply(close, returns)", "close * returns"),
    "rev_v": ("reverse(vwap)", "-vwap"),
    "sign_v": ("sign(returns)", "sign(returns)"),
})
_register("a2_divide", {"div_v": ("divide(close, subtract(high, low))", "close / nullif(high - low, 0)"), "inv_v": ("inverse(returns)", "1 / nullif(returns, 0)")})
_register("a3_log_sqrt", {"log_v": ("log(returns)", "CASE WHEN returns > 0 THEN ln(returns) END"), "sqrt_v": ("sqrt(returns)", "CASE WHEN returns >= 0 THEN sqrt(returns) END")})
_register("a4_power", {
    "pow_v": ("power(returns, 2)", "pow(returns, 2)"),
    "root_v": ("power(returns, 0.5)", "CASE WHEN returns >= 0 THEN pow(returns, 0.5) END"),
    "signed_v": ("signed_power(returns, 0.5)", "sign(returns) * pow(abs(returns), 0.5)"),
})
_register("a5_max_min", {
    "max_v": ("max(open, close)", "CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN greatest(open, close) END"),
    "min_v": ("min(returns, 0)", "CASE WHEN returns IS NOT NULL THEN least(returns, 0) END"),
})
_register("a6_missing", {"filled": ("densify(close)", "coalesce(close, 0)"), "missing": ("is_nan(close)", "CASE WHEN close IS NULL THEN 1 ELSE 0 END")})
_register("a7_if_else", {"v": ("if_else(returns, high, low)", "CASE WHEN returns > 0 THEN high WHEN returns IS NOT NULL THEN low END")})
_register("a8_logic", {
    "and_v": ("and_(returns, subtract(close, open))", "CASE WHEN coalesce(returns > 0, false) AND coalesce(close - open > 0, false) THEN 1 ELSE 0 END"),
    "or_v": ("or_(returns, subtract(close, open))", "CASE WHEN coalesce(returns > 0, false) OR coalesce(close - open > 0, false) THEN 1 ELSE 0 END"),
    "not_v": ("not_(returns)", "CASE WHEN coalesce(returns > 0, false) THEN 0 ELSE 1 END"),
})
_register("a9_comparison", {
    "eq": ("equal(high, low)", "CAST(coalesce(high = low, false) AS INT)"),
    "ne": ("not_equal(high, low)", "CAST(coalesce(high <> low, true) AS INT)"),
    "lt": ("less(open, close)", "CAST(coalesce(open < close, false) AS INT)"),
    "gt": ("greater(open, close)", "CAST(coalesce(open > close, false) AS INT)"),
    "le": ("less_equal(high, low)", "CAST(coalesce(high <= low, false) AS INT)"),
    "ge": ("greater_equal(returns, 0)", "CAST(coalesce(returns >= 0, false) AS INT)"),
})

_register("t1_ts_delay", {"v": ("ts_delay(close, 3)", f"lag(close, 3) OVER ({WT})"), "same": ("ts_delay(close, 0)", "close")})
_register("t2_ts_delta", {"v": ("ts_delta(close, 2)", f"close - lag(close, 2) OVER ({WT})")})
_register("t3_ts_mean", {"v": ("ts_mean(close, 5)", full(5, f"avg(close) {w(5)}"))})
_register("t4_ts_sum", {"v": ("ts_sum(returns, 5)", full(5, f"sum(returns) {w(5)}"))})
_register("t5_ts_std", {"v": ("ts_std(close, 6)", full(6, f"stddev_pop(close) {w(6)}"))})
_register("t6_ts_zscore", {"v": ("ts_zscore(close, 6)", full(6, f"CASE WHEN stddev_pop(close) {w(6)} > 1e-12 THEN (close - avg(close) {w(6)}) / stddev_pop(close) {w(6)} END"))})
_register("t7_ts_product", {"v": ("ts_product(add(returns, 1), 3)", full(3, f"CASE WHEN count(returns) {w(3)} = 3 THEN product(returns + 1) {w(3)} END"))})
_register("t8_ts_min_max", {"lo": ("ts_min(close, 7)", full(7, f"min(close) {w(7)}")), "hi": ("ts_max(close, 7)", full(7, f"max(close) {w(7)}"))})
_register("t9_ts_arg_min_max", {
    "lo": ("ts_arg_min(volume, 6)", full(6, "rn - (SELECT min(q.rn) FROM panel q WHERE q.ticker = panel.ticker AND q.rn BETWEEN panel.rn - 5 AND panel.rn AND q.volume = (SELECT min(r.volume) FROM panel r WHERE r.ticker = panel.ticker AND r.rn BETWEEN panel.rn - 5 AND panel.rn))")),
    "hi": ("ts_arg_max(volume, 6)", full(6, "rn - (SELECT min(q.rn) FROM panel q WHERE q.ticker = panel.ticker AND q.rn BETWEEN panel.rn - 5 AND panel.rn AND q.volume = (SELECT max(r.volume) FROM panel r WHERE r.ticker = panel.ticker AND r.rn BETWEEN panel.rn - 5 AND panel.rn))")),
})
_register("t10_ts_rank", {"v": ("ts_rank(volume, 8)", full(8, f"CASE WHEN count(volume) {w(8)} > 0 THEN CASE WHEN volume IS NULL THEN 0 ELSE (len(list_filter(list(volume) {w(8)}, lambda x: x < volume)) + 0.5 * len(list_filter(list(volume) {w(8)}, lambda x: x = volume))) / count(volume) {w(8)} END END"))})
_register("t11_ts_corr", {"v": ("ts_corr(close, volume, 10)", full(10, f"CASE WHEN stddev_pop(close) {w(10)} > 1e-12 AND stddev_pop(volume) {w(10)} > 1e-12 THEN (avg(close * volume) {w(10)} - avg(close) {w(10)} * avg(volume) {w(10)}) / (stddev_pop(close) {w(10)} * stddev_pop(volume) {w(10)}) END"))})
_register("t12_ts_covariance", {"v": ("ts_covariance(close, open, 10)", full(10, f"avg(close * open) {w(10)} - avg(close) {w(10)} * avg(open) {w(10)}"))})
_register("t13_ts_regression", {"v": ("ts_regression(close, open, 10)", full(10, f"CASE WHEN var_pop(open) {w(10)} > 1e-12 THEN (avg(close * open) {w(10)} - avg(close) {w(10)} * avg(open) {w(10)}) / var_pop(open) {w(10)} END"))})
_register("t14_ts_quantile", {"v": ("ts_quantile(close, 9, 0.3)", full(9, f"quantile_cont(close, 0.3) {w(9)}"))})
_register("t15_ts_decay_linear", {"v": ("ts_decay_linear(close, 6)", full(6, f"(sum(rn * close) {w(6)} + (6 - rn) * sum(close) {w(6)}) / nullif(sum(CASE WHEN close IS NOT NULL THEN rn END) {w(6)} + (6 - rn) * count(close) {w(6)}, 0)"))})
_register("t16_ts_decay_exp", {"v": ("ts_decay_exp(close, 5)", full(5, "(SELECT sum(q.close * pow(0.8, panel.rn - q.rn)) / sum(CASE WHEN q.close IS NOT NULL THEN pow(0.8, panel.rn - q.rn) END) FROM panel q WHERE q.ticker = panel.ticker AND q.rn BETWEEN panel.rn - 4 AND panel.rn)"))})
_register("t17_ts_count_nans", {"v": ("ts_count_nans(close, 5)", full(5, f"sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) {w(5)}"))})
_register("t18_ts_backfill", {
    "v": ("ts_backfill(close, 3)", f"last_value(close IGNORE NULLS) OVER ({WT} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    "strict": ("ts_backfill(close, 3, 1)", f"last_value(close IGNORE NULLS) OVER ({WT} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"),
})
_register(
    "t19_last_diff_value",
    {"v": ("last_diff_value(volume)", f"last_value(turned IGNORE NULLS) OVER ({WT} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")},
    f""", known AS (SELECT *, last_value(volume IGNORE NULLS) OVER ({WT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM panel),
    turned AS (SELECT *, CASE WHEN volume <> known THEN known END AS turned FROM known)""",
    "turned",
)
_register(
    "t20_trade_when",
    {"v": ("trade_when(returns, close, subtract(open, vwap))", "CASE WHEN leave > 0 THEN NULL ELSE alpha END")},
    f""", moves AS (SELECT *, CASE WHEN open - vwap > 0 OR returns > 0 THEN rn END AS moved FROM panel),
    held AS (SELECT *, last_value(moved IGNORE NULLS) OVER ({WT} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM moves),
    traded AS (SELECT h.date, h.ticker, p.close AS alpha, p.open - p.vwap AS leave FROM held h LEFT JOIN panel p ON p.ticker = h.ticker AND p.rn = h.k)""",
    "traded",
)
_register(
    "t21_hump",
    {"v": ("hump(close, 0.2)", "held")},
    """, walk AS (
      WITH RECURSIVE r AS (
        SELECT ticker, date, rn, close AS held FROM panel WHERE rn = 1
        UNION ALL
        SELECT p.ticker, p.date, p.rn, CASE WHEN p.close IS NOT NULL AND (r.held IS NULL OR abs(p.close - r.held) > 0.2 * (1 + abs(r.held))) THEN p.close ELSE r.held END
        FROM r JOIN panel p ON p.ticker = r.ticker AND p.rn = r.rn + 1)
      SELECT * FROM r)""",
    "walk",
)

WD = "PARTITION BY date"


def _ordinal(x: str, by: str = "date") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN row_number() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST, ticker) END"


_register("x1_rank", {"v": ("rank(volume)", f"({_ordinal('volume')}) / CAST(count(volume) OVER ({WD}) AS DOUBLE)")})
_register("x2_zscore", {"v": ("zscore(close)", f"CASE WHEN stddev_pop(close) OVER ({WD}) > 1e-12 THEN (close - avg(close) OVER ({WD})) / stddev_pop(close) OVER ({WD}) END")})
_CENTRED = ", centred AS (SELECT *, close - avg(close) OVER (PARTITION BY {by}) AS c FROM panel)"
_register("x3_scale", {"v": ("scale(close)", f"CASE WHEN sum(abs(c)) OVER ({WD}) > 1e-12 THEN c / sum(abs(c)) OVER ({WD}) END")}, _CENTRED.format(by="date"), "centred")
_register("x4_normalize", {"v": ("normalize(close)", f"close - avg(close) OVER ({WD})")})
_register("x5_winsorize", {"v": ("winsorize(close, 0.05)", f"CASE WHEN close IS NOT NULL THEN least(greatest(close, quantile_cont(close, 0.05) OVER ({WD})), quantile_cont(close, 0.95) OVER ({WD})) END")})
_register("x6_quantile", {"v": ("quantile(close, 5)", f"least(floor((({_ordinal('close')}) - 1) * 5 / CAST(count(close) OVER ({WD}) AS DOUBLE)), 4)")})
WG = "PARTITION BY date, sector"
_register("g1_group_rank", {"v": ("group_rank(close, sector)", f"({_ordinal('close', 'date, sector')}) / CAST(count(close) OVER ({WG}) AS DOUBLE)")})
_register("g2_group_zscore", {"v": ("group_zscore(close, sector)", f"CASE WHEN stddev_pop(close) OVER ({WG}) > 1e-12 THEN (close - avg(close) OVER ({WG})) / stddev_pop(close) OVER ({WG}) END")})
_register("g3_group_mean", {"v": ("group_mean(close, sector)", f"avg(close) OVER ({WG})")})
_register("g4_group_scale", {"v": ("group_scale(close, sector)", f"CASE WHEN sum(abs(c)) OVER ({WG}) > 1e-12 THEN c / sum(abs(c)) OVER ({WG}) END")}, _CENTRED.format(by="date, sector"), "centred")
_register("g5_group_neutralize", {"v": ("group_neutralize(close, sector)", f"close - avg(close) OVER ({WG})")})
_register("g6_group_backfill", {"v": ("group_backfill(close, sector)", f"coalesce(close, avg(close) OVER ({WG}))")})
_register("g7_sector_neutralize", {"v": ("sector_neutralize(close, industry)", "CASE WHEN count(close) OVER (PARTITION BY date, industry) >= 2 THEN close - avg(close) OVER (PARTITION BY date, industry) ELSE close END")})

_register("p2_derived_operands", {"ret": ("returns", "returns"), "vw": ("vwap", "vwap"), "dv": ("dollar_volume", "dollar_volume"), "adv": ("adv5", "adv5")})
_register(
    "e1_expression",
    {"v": ("subtract(rank(ts_mean(returns, 12)), rank(ts_std(returns, 20)))", f"({_ordinal('m')}) / CAST(count(m) OVER ({WD}) AS DOUBLE) - ({_ordinal('s')}) / CAST(count(s) OVER ({WD}) AS DOUBLE)")},
    f", legs AS (SELECT *, {full(12, f'avg(returns) {w(12)}')} AS m, {full(20, f'stddev_pop(returns) {w(20)}')} AS s FROM panel)",
    "legs",
)

#: Short-horizon library: name, expression, SQL on the panel.
LIBRARY = {
    "momentum_5": ("ts_sum(returns, 5)", full(5, f"sum(returns) {w(5)}")),
    "reversal_1": ("reverse(returns)", "-returns"),
    "volatility_5": ("ts_std(returns, 5)", full(5, f"stddev_pop(returns) {w(5)}")),
    "range_share": ("divide(subtract(high, low), vwap)", "(high - low) / nullif(vwap, 0)"),
    "volume_surprise": ("divide(volume, adv5)", "volume / nullif(adv5, 0)"),
    "close_to_vwap": ("subtract(divide(close, vwap), 1)", "close / nullif(vwap, 0) - 1"),
}


@query(
    "e2_factor_library",
    f"WITH {PANEL_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS factor_name, date, ticker, {sql_rounded(s)} AS value FROM (SELECT *, {s} AS v FROM panel)" for n, (_, s) in LIBRARY.items()),
)
def e2_factor_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = evaluate_many(panel(spark, sf_dir), {n: e for n, (e, _) in LIBRARY.items()})
    return long.withColumn("value", rounded(F.col("value")))


@query("e3_cross_section_at_date", f"WITH {PANEL_SQL}, f AS (SELECT date, ticker, {full(5, f'avg(close) {w(5)}')} AS v FROM panel) SELECT ticker, {sql_rounded('v')} AS value FROM f WHERE date = (SELECT max(date) FROM panel) AND v IS NOT NULL")
def e3_cross_section_at_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluate(panel(spark, sf_dir), "ts_mean(close, 5)")
    last = df.agg(F.max("date").alias("date"))
    return df.join(last, "date", "left_semi").where("value is not null").select("ticker", rounded(F.col("value")).alias("value"))


@query(
    "e4_default_factor_z",
    f"""WITH {PANEL_SQL}, f AS (SELECT date, ticker, {full(12, f'avg(returns) {w(12)}')} AS v FROM panel),
    d AS (SELECT * FROM f WHERE date = (SELECT max(date) FROM panel) AND v IS NOT NULL),
    z AS (SELECT ticker, CASE WHEN stddev_pop(v) OVER () > 1e-12 THEN (v - avg(v) OVER ()) / stddev_pop(v) OVER () ELSE 0 END AS z FROM d)
    SELECT ticker, {sql_rounded('greatest(-3.0, least(3.0, z))')} AS z FROM z""",
)
def e4_default_factor_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluate(panel(spark, sf_dir), "ts_mean(returns, 12)")
    at = df.join(df.agg(F.max("date").alias("date")), "date", "left_semi").where("value is not null")
    day = Window.partitionBy("date")
    spread = F.stddev_pop("value").over(day)
    z = F.when(spread > 1e-12, (F.col("value") - F.avg("value").over(day)) / spread).otherwise(0.0)
    return at.select("ticker", rounded(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z))).alias("z"))


# -- series dialect: own rows of each ticker, full windows of values, sample moments -------------------------------

RW = "PARTITION BY ticker ORDER BY date"


def _series(name: str, columns: dict[str, tuple]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = prices_daily(spark, sf_dir)
        for out, (f, args, _) in columns.items():
            df = SERIES[f](df, out, *args)
        return df.select("date", "ticker", *[rounded(F.col(c)).alias(c) for c in columns])

    query(name, f"WITH {PRICES_SQL} SELECT date, ticker, " + ", ".join(f"{sql_rounded(s)} AS {c}" for c, (_, _, s) in columns.items()) + " FROM prices")(run)


def _whole(n: int, expression: str, x: str = "close") -> str:
    return f"CASE WHEN count({x}) {w(n)} = {n} THEN {expression} END"


_series("r1_ref_delta", {"ref": ("Ref", ("close", 2), f"lag(close, 2) OVER ({RW})"), "delta": ("Delta", ("close", 2), f"close - lag(close, 2) OVER ({RW})")})
_series("r2_mean_sum_extremes", {
    "mean_v": ("Mean", ("close", 4), _whole(4, f"avg(close) {w(4)}")), "sum_v": ("Sum", ("close", 4), _whole(4, f"sum(close) {w(4)}")),
    "max_v": ("Max", ("close", 4), _whole(4, f"max(close) {w(4)}")), "min_v": ("Min", ("close", 4), _whole(4, f"min(close) {w(4)}")), "med_v": ("Med", ("close", 4), _whole(4, f"quantile_cont(close, 0.5) {w(4)}")),
})
_series("r3_std_var", {"std_v": ("Std", ("close", 5), _whole(5, f"stddev_samp(close) {w(5)}")), "var_v": ("Var", ("close", 5), _whole(5, f"var_samp(close) {w(5)}"))})
_series("r4_skew_kurt", {"skew_v": ("Skew", ("close", 6), _whole(6, f"skewness(close) {w(6)}")), "kurt_v": ("Kurt", ("close", 6), _whole(6, f"kurtosis(close) {w(6)}"))})
_series("r5_count", {"v": ("Count", ("close", 5), f"CASE WHEN row_number() OVER ({RW}) >= 5 THEN CAST(count(close) {w(5)} AS DOUBLE) END")})
_series("r7_wma", {"v": ("WMA", ("close", 4), f"CASE WHEN row_number() OVER ({RW}) >= 4 THEN (close * 4 + lag(close, 1) OVER ({RW}) * 3 + lag(close, 2) OVER ({RW}) * 2 + lag(close, 3) OVER ({RW})) / 10 END")})
_series("r8_slope", {"v": ("Slope", ("close", 5), f"CASE WHEN row_number() OVER ({RW}) >= 5 THEN (2 * close + lag(close, 1) OVER ({RW}) - lag(close, 3) OVER ({RW}) - 2 * lag(close, 4) OVER ({RW})) / 10 END")})
_series("r9_corr_cov", {"cov_v": ("Cov", ("close", "open", 6), _whole(6, f"covar_samp(close, open) {w(6)}")), "corr_v": ("Corr", ("close", "open", 6), _whole(6, f"CASE WHEN stddev_samp(close) {w(6)} * stddev_samp(open) {w(6)} > 1e-12 THEN corr(close, open) {w(6)} END"))})
_series("r10_rank", {"v": ("Rank", ("volume",), "(rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0) / count(volume) OVER (PARTITION BY date)")})
_series("r11_zscore", {"v": ("Zscore", ("close",), "CASE WHEN stddev_samp(close) OVER (PARTITION BY date) > 1e-12 THEN (close - avg(close) OVER (PARTITION BY date)) / stddev_samp(close) OVER (PARTITION BY date) END")})


_KEEP = f"{1 - 2 / 6!r}"


@query("r6_ema", f"""WITH {PRICES_SQL}, k AS (SELECT *, row_number() OVER ({WT}) AS k FROM prices)
  SELECT date, ticker, {sql_rounded(f"sum(close * power({_KEEP}, -k)) OVER ({WT} ROWS UNBOUNDED PRECEDING) / sum(power({_KEEP}, -k)) OVER ({WT} ROWS UNBOUNDED PRECEDING)")} AS v FROM k""")  # fmt: skip
def r6_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential means with adjusted weights (recursive, one ticker at a time)."""
    return SERIES["EMA"](prices_daily(spark, sf_dir), "v", "close", 5).select("date", "ticker", rounded(F.col("v")).alias("v"))
