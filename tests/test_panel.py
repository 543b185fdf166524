"""Panel operators: no look-ahead, null rules, errors; joins and ranks against plain Python."""

import datetime as dt
import random

import pytest

from sparkfolio.operators.backtest import book, book_returns, ordinal_ic
from sparkfolio.operators.expression import ExpressionError, evaluate
from sparkfolio.operators.joins import asof_join, global_ordinal

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(15)]
PROBES = [
    "ts_delay(close, 2)", "ts_mean(close, 4)", "ts_std(close, 4)", "ts_rank(close, 5)", "ts_arg_max(close, 5)", "ts_corr(close, volume, 5)", "ts_quantile(close, 5, 0.4)",
    "ts_decay_linear(close, 4)", "ts_decay_exp(close, 4)", "ts_backfill(close, 3)", "last_diff_value(close)", "trade_when(volume, close, subtract(close, 12))", "rank(close)", "zscore(close)",
    "scale(close)", "winsorize(close, 0.1)", "quantile(close, 3)", "group_rank(close, sector)", "group_neutralize(close, sector)", "rank(ts_mean(ts_delta(close, 1), 3))",
]


def rows(seed=42):
    rnd = random.Random(seed)
    return [
        (t, d, None if rnd.random() < 0.1 else round(rnd.uniform(5, 15), 3), round(rnd.uniform(1, 9), 2), f"S{t % 2}")
        for d in DAYS
        for t in range(4)
    ]


SCHEMA = "ticker long, date date, close double, volume double, sector string"


def values(spark, data, expression):
    df = evaluate(spark.createDataFrame(data, SCHEMA), expression)
    return {(r.ticker, r.date): r.value for r in df.collect()}


@pytest.mark.parametrize("expression", PROBES)
def test_later_rows_do_not_matter(spark, expression):
    data = rows()
    changed = [r if r[1] <= DAYS[9] else (r[0], r[1], 99.0, 1.0, r[4]) for r in data]
    a, b = values(spark, data, expression), values(spark, changed, expression)
    assert all(a[k] == b[k] for k in a if k[1] <= DAYS[9])


def test_hump_holds_until_left_far_enough(spark):
    data = [(1, d, v, 1.0, "S") for d, v in zip(DAYS, [1.0, 1.1, None, 2.0, 2.1, 1.0], strict=False)]
    got = values(spark, data, "hump(close, 0.2)")
    assert [got[1, d] for d in DAYS[:6]] == [1.0, 1.0, 1.0, 2.0, 2.0, 1.0]


def test_null_rules(spark):
    data = [(1, DAYS[0], None, 2.0, "S"), (2, DAYS[0], 0.0, 2.0, "S")]
    assert values(spark, data, "max(close, volume)")[1, DAYS[0]] is None
    assert values(spark, data, "divide(volume, close)")[2, DAYS[0]] is None
    assert values(spark, data, "not_equal(close, volume)")[1, DAYS[0]] == 1.0
    assert values(spark, data, "and_(close, volume)")[1, DAYS[0]] == 0.0


@pytest.mark.parametrize("bad", ["nothing(close)", "ts_mean(nothing, 3)", "close + 1", "ts_mean(close, n=3)", "__import__('os')", "True"])
def test_unknown_names_and_syntax_are_errors(spark, bad):
    with pytest.raises((ExpressionError, SyntaxError)):
        evaluate(spark.createDataFrame(rows(), SCHEMA), bad)


def test_own_operators_never_hide_built_in_ones(spark):
    own = {"twice": lambda p, x: x * 2, "abs": lambda p, x: x * 0}
    df = evaluate(spark.createDataFrame([(1, DAYS[0], -3.0, 1.0, "S")], SCHEMA), "twice(abs(close))", operators=own)
    assert df.first().value == 6.0


def test_asof_join(spark):
    left = spark.createDataFrame([(1, DAYS[k]) for k in (0, 3, 5)] + [(2, DAYS[4])], "k long, t date")
    right = spark.createDataFrame([(1, DAYS[3], 1, 10.0), (1, DAYS[3], 2, 20.0), (1, DAYS[4], 3, 30.0)], "k long, at date, id long, v double")
    got = {(r.k, r.t): r.v for r in asof_join(left, right, "k", "t", "at", "id", ["v"]).collect()}
    assert got == {(1, DAYS[0]): None, (1, DAYS[3]): 20.0, (1, DAYS[5]): 30.0, (2, DAYS[4]): None}


def test_global_ordinal_is_exact(spark):
    rnd = random.Random(3)
    data = [(k % 2, float(rnd.randrange(50)), k) for k in range(1000)]
    got = {(r.key, r.id): r.n for r in global_ordinal(spark.createDataFrame(data, "key long, v double, id long"), "key", ["v", "id"], "n").collect()}
    for key in (0, 1):
        order = sorted((v, i) for k, v, i in data if k == key)
        assert all(got[key, i] == n for n, (_, i) in enumerate(order, 1))


def test_perfect_foresight_has_an_ic_of_one_and_pays(spark):
    rnd = random.Random(1)
    data = [(t, d, x := rnd.gauss(0, 0.02), x) for d in DAYS for t in range(20)]
    df = spark.createDataFrame(data, "ticker long, date date, factor double, fwd double")
    assert all(abs(r.ic - 1) < 1e-9 for r in ordinal_ic(df).collect())
    net = [r.net for r in book_returns(book(df)).collect() if r.net is not None]
    assert len(net) == len(DAYS) - 1 and min(net) > 0
