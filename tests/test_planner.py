"""The expression planner: exchanges, shared calls, values against one call at a time."""

import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import expression
from sparkfolio.operators.expression import ExpressionError, evaluate, evaluate_many, evaluate_wide
from sparkfolio.operators.panel import OPERATORS, Panel
from sparkfolio.plans.mining import seeds

DAYS = [date(2024, 1, 1) + timedelta(days=i) for i in range(30)]


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    rows = [(t, d, 100.0 + (7 * t + 3 * i + t * i) % 23, None if (t + i) % 9 == 0 else float((t * 5 + i * i) % 17), f"S{t % 2}") for t in range(8) for i, d in enumerate(DAYS)]
    df = spark.createDataFrame(rows, "ticker long, date date, close double, volume double, sector string")
    df = df.withColumn("returns", F.col("close") / 100 - 1).withColumn("high", F.col("close") + 1).withColumn("low", F.col("close") - 1)
    path = str(tmp_path_factory.mktemp("panel") / "p")
    df.write.parquet(path)
    return spark.read.parquet(path)


def exchanges(df, of="Exchange hashpartitioning"):
    return re.findall(rf"{of}\((\w+)", df._jdf.queryExecution().executedPlan().toString())


def test_all_seeds_take_one_exchange_by_ticker_and_one_by_date(panel):
    assert sorted(exchanges(evaluate_many(panel, seeds()))) == ["date", "ticker"]


def test_exchanges_follow_the_depth_of_changes(panel):
    assert exchanges(evaluate(panel, "ts_mean(rank(ts_mean(close, 3)), 4)")) == ["ticker", "date", "ticker"]
    assert exchanges(evaluate(panel, "add(close, 1)")) == []
    wide = evaluate_wide(panel, {"a": "rank(close)", "b": "group_rank(close, sector)", "c": "rank(group_mean(close, sector))"})
    assert exchanges(wide) == ["date"]


def test_equal_calls_are_one_node(panel, monkeypatch):
    called = []
    real = OPERATORS["ts_mean"]
    monkeypatch.setitem(OPERATORS, "ts_mean", lambda p, *a: called.append(a[1:]) or real(p, *a))
    evaluate_wide(panel, {"a": "subtract(ts_mean(close, 5), ts_mean(close, 3))", "b": "rank(ts_mean(close, 5))", "c": "ts_mean(close, 5.0)"})
    assert called == [(5,), (3,), (5.0,)]


EXPRESSIONS = {
    "a": "subtract(rank(ts_mean(returns, 4)), rank(ts_std(returns, 6)))",
    "b": "ts_mean(zscore(ts_zscore(volume, 5)), 3)",
    "c": "group_neutralize(ts_rank(volume, 6), sector)",
    "d": "hump(ts_mean(close, 3), 0.05)",
    "e": "ts_delta(hump(rank(close), 0.01), 2)",
    "f": "if_else(subtract(close, ts_mean(close, 5)), scale(volume), reverse(ts_decay_exp(volume, 4)))",
    "g": "ts_corr(rank(volume), rank(close), 8)",
    "h": "trade_when(subtract(volume, 5), rank(close), subtract(volume, 14))",
}


def test_together_as_one_at_a_time(panel):
    together = {(r["ticker"], r["date"]): r for r in evaluate_wide(panel, EXPRESSIONS).collect()}
    assert len(together) == 8 * len(DAYS)
    for name, e in EXPRESSIONS.items():
        for r in evaluate(panel, e).collect():
            got = together[r["ticker"], r["date"]][name]
            assert (got is None) == (r["value"] is None) and (got is None or got == pytest.approx(r["value"], abs=1e-12)), (name, r)


def test_plain_python_of_a_nested_expression(panel):
    rows = {(r["ticker"], r["date"]): r["close"] for r in panel.collect()}
    means = {(t, i): sum(rows[t, DAYS[k]] for k in range(i - 2, i + 1)) / 3 for t in range(8) for i in range(2, len(DAYS))}
    for r in evaluate(panel, "rank(ts_mean(close, 3))").collect():
        i = DAYS.index(r["date"])
        if i < 2:
            assert r["value"] is None
            continue
        order = sorted(range(8), key=lambda t: (round(means[t, i], 9), t))
        assert r["value"] == (order.index(r["ticker"]) + 1) / 8


def test_operators_may_take_the_frame_themselves(panel):
    def twice(p, x):
        name = p.let(x * 2)
        p.df = p.df.withColumn("_mine", name)
        return F.col("_mine") + 0

    got = evaluate(panel, "rank(twice(ts_mean(close, 2)))", operators={"twice": twice}).collect()
    assert {(r["ticker"], r["date"], r["value"]) for r in got} == {(r["ticker"], r["date"], r["value"]) for r in evaluate(panel, "rank(ts_mean(close, 2))").collect()}


def test_a_panel_without_rows_and_an_expression_that_is_a_name(panel):
    assert evaluate(panel.limit(0), "rank(ts_mean(close, 3))").count() == 0
    assert evaluate(panel, "close", out="close").columns.count("close") == 1
    assert Panel(panel).df is panel
    with pytest.raises(ExpressionError):
        expression.evaluate_wide(panel, {"x": "nothing(close)"})
