"""Tests that an operator must pass before expressions may use it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.operators.panel import Panel

#: What an operator may fail: to take its arguments and give a column, to be computed, to keep the rows as they are, to leave
#: missing what has no value at all, and to give the same whatever comes later.
SIGNATURE, EVALUATION, SHAPE, MISSING, LATER = "signature", "evaluation", "shape", "missing", "later"


def applied(panel: DataFrame, operator: Callable, numbers: tuple = ()) -> DataFrame:
    """``panel`` (ticker, date, v) with the operator's value of v as ``out``; TypeError where it gives no column."""
    p = Panel(panel)
    value = operator(p, F.col("v"), *numbers)
    if not isinstance(value, Column):
        raise TypeError(f"an operator gives a column, not {type(value).__name__}")
    value = p.let(value)
    return p.df.select("ticker", "date", "v", value.cast("double").alias("out"))


def generated(spark: SparkSession, later: float = 0.0) -> DataFrame:
    """A small panel: tickers of eight and sixteen rows, one of which is missing, and one without any value; ``later`` is added from the twelfth date on."""
    sizes = F.array(F.struct(F.lit("eight").alias("ticker"), F.lit(8).alias("n")), F.struct(F.lit("sixteen").alias("ticker"), F.lit(16).alias("n")), F.struct(F.lit("null").alias("ticker"), F.lit(16).alias("n")))
    rows = spark.range(16).select(F.col("id").cast("int").alias("i"), F.explode(sizes).alias("t")).where("i < t.n")
    value = F.when((F.col("t.ticker") != "null") & (F.col("i") != 3), F.when(F.col("t.ticker") == "eight", F.col("i")).otherwise((F.col("i") * 7) % 16 / 15) + F.when(F.col("i") >= 11, later).otherwise(0.0))
    return rows.select("t.ticker", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")).alias("date"), value.cast("double").alias("v"))


def failing(spark: SparkSession, operator: Callable, numbers: tuple = ()) -> str | None:
    """The first property that an operator fails on the generated panel, or none."""
    before = {(r["ticker"], r["date"]) for r in generated(spark).collect()}
    try:
        frames = [applied(generated(spark, later), operator, numbers) for later in (0.0, 5.0)]
    except TypeError:
        return SIGNATURE
    except Exception:  # noqa: BLE001  whatever a caller's function raises
        return EVALUATION
    try:
        rows, changed = ([tuple(r) for r in f.collect()] for f in frames)
    except PySparkException:
        return EVALUATION
    if len(rows) != len(before) or {r[:2] for r in rows} != before:
        return SHAPE
    if any(r[0] == "null" and r[3] is not None and r[3] == r[3] for r in rows):
        return MISSING
    cut = sorted({d for _, d in before})[11]
    early = lambda found: {r[:2]: repr(r[3]) for r in found if r[1] < cut}
    return None if early(rows) == early(changed) else LATER


def report(panel: DataFrame, operators: Mapping[str, Callable], numbers: Mapping[str, tuple] | None = None) -> DataFrame:
    """operator, n_rows, n_out, leaks, peeks, ok of operators on a whole panel.

    ``leaks`` are values given to tickers that have none at all; ``peeks`` are rows of the first half of the panel's time whose value is
    another one when those of the second half are.  An operator is right if rows stay as they are and there are neither.
    """
    before = panel.agg(F.count("*").alias("n_rows"))
    ends = panel.agg(F.min("date").alias("a"), F.max("date").alias("z")).select(F.expr("date_add(a, int(datediff(z, a) div 2))").alias("middle"))
    dated = panel.join(F.broadcast(ends))  # one row
    moved = dated.withColumn("v", F.when(F.col("date") > F.col("middle"), F.col("v") + 1).otherwise(F.col("v"))).drop("middle")

    def one(name: str) -> DataFrame:
        mine = (operators[name], (numbers or {}).get(name, ()))
        out = applied(panel, *mine)
        per_ticker = out.groupBy("ticker").agg(F.count("*").alias("n"), F.count("v").alias("known"), F.count("out").alias("given"))
        got = per_ticker.agg(F.sum("n").alias("n_out"), F.sum(F.when(F.col("known") == 0, F.col("given")).otherwise(0)).alias("leaks"))
        # equal rows cancel out; what is left of the early ones saw what came later
        early = lambda f, sign: f.join(F.broadcast(ends)).where("date <= middle").select("ticker", "date", F.round("out", 9).alias("out"), F.lit(sign).alias("sign"))
        odd = early(out, 1).unionAll(early(applied(moved, *mine), -1)).groupBy("ticker", "date", "out").agg(F.sum("sign").alias("left"))
        peeks = odd.agg(F.coalesce(F.sum(F.when(F.col("left") > 0, F.col("left"))), F.lit(0)).alias("peeks"))
        return got.join(before).join(peeks).select(F.lit(name).alias("operator"), "n_rows", "n_out", "leaks", "peeks")  # one row each

    all_of = reduce(DataFrame.unionAll, [one(n) for n in operators])
    return all_of.withColumn("ok", (F.col("n_rows") == F.col("n_out")) & (F.col("leaks") == 0) & (F.col("peeks") == 0))


def accepted(panel: DataFrame, operators: Mapping[str, Callable], numbers: Mapping[str, tuple] | None = None) -> dict[str, Callable]:
    """The operators, if all pass on the generated panel and on a whole one; else an error that names those that do not, and why."""
    spark = panel.sparkSession
    why = {n: failing(spark, f, (numbers or {}).get(n, ())) for n, f in operators.items()}
    bad = [f"{n} ({p})" for n, p in why.items() if p]
    if not bad:
        bad = [f"{r['operator']} (on the panel)" for r in report(panel, operators, numbers).where("not ok").collect()]
    if bad:
        raise ValueError(f"operators refused: {', '.join(bad)}")
    return dict(operators)
