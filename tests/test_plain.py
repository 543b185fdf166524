"""Operators that SQL does not express, and rules with fixed boundaries, against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkfolio.functions import expressions, normal
from sparkfolio.functions.series import SERIES
from sparkfolio.operators import acceptance, books
from sparkfolio.operators import resample
from sparkfolio.operators.joins import next_after
from sparkfolio.operators.panel import OPERATORS
from sparkfolio.plans import mining, more, portfolio, registry, research, validation
from sparkfolio.sources import store

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("score", "tier"), [(1.6, "BUY"), (1.5, "OW"), (0.6, "OW"), (0.5, "HOLD"), (0.0, "HOLD"), (-0.5, "HOLD"), (-0.51, "UW"), (-1.5, "UW"), (-1.51, "SELL"), (None, "HOLD"), (float("nan"), "HOLD")])
def test_tier_boundaries(spark, score, tier):
    from pyspark.sql import functions as F

    assert more.tier_of(score) == tier
    assert spark.createDataFrame([(score,)], "x double").select(research.tier(F.col("x")).alias("t")).first().t == tier


@pytest.mark.parametrize(
    ("scores", "tiers"),
    [
        ([0.0, 1.55, -1.55], ["HOLD", "BUY", "SELL"]),
        ([0.49, 0.51, 0.64, 0.66, 0.4, 0.34], ["HOLD", "HOLD", "HOLD", "OW", "OW", "HOLD"]),
        ([1.6, 1.4, 1.34], ["BUY", "BUY", "OW"]),
        ([-1.6, -1.4, -1.3], ["SELL", "SELL", "UW"]),
        ([0.6, None, 0.6], ["OW", "HOLD", "HOLD"]),
    ],
)
def test_hysteresis(scores, tiers):
    assert more.held_tiers(scores) == tiers


def test_exponential_mean_with_adjusted_weights(spark):
    rnd = random.Random(2)
    x = [rnd.uniform(1, 9) for _ in range(12)]
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(x)], "ticker long, date date, close double")
    got = [r.v for r in SERIES["EMA"](df, "v", "close", 5).orderBy("date").collect()]
    keep = 1 - 2 / 6
    for t, v in enumerate(got):
        w = [keep ** (t - i) for i in range(t + 1)]
        assert abs(v - sum(a * b for a, b in zip(w, x, strict=False)) / sum(w)) < 1e-9


def test_error_function(spark):
    from pyspark.sql import functions as F

    xs = [-7.0, -3.3, -1.0, 0.0, 0.2, 1.7, 4.9, 6.5]
    for r in spark.createDataFrame([(v,) for v in xs], "x double").select("x", normal.erf(F.col("x")).alias("e"), normal.two_sided(F.col("x")).alias("p")).collect():
        assert abs(r.e - math.erf(r.x)) < 1e-14 and abs(r.p - math.erfc(abs(r.x) / math.sqrt(2))) < 1e-14
    assert normal.luckiest(1) == 0.0 and 1.5 < normal.luckiest(10) < 1.7


def test_bootstrap_against_a_plain_loop():
    x = np.array([0.01, -0.02, 0.03, np.nan, 0.005, -0.01, 0.02, 0.0])
    v, n = x[~np.isnan(x)], 7
    rng = np.random.default_rng(42)
    starts, fresh = rng.integers(0, n, size=(1000, n)), rng.random(size=(1000, n)) < 1 / 20
    means = []
    for r in range(1000):
        at, path = 0, []
        for j in range(n):
            if j == 0 or fresh[r, j]:
                at = int(starts[r, j])
            path.append(v[at % n])
            at += 1
        means.append(np.mean(path))
    low, high = portfolio.bootstrap(x, lambda m: m.mean(axis=1))
    assert abs(low - np.percentile(means, 2.5)) < 1e-12 and abs(high - np.percentile(means, 97.5)) < 1e-12
    assert portfolio.bootstrap(v[:4], lambda m: m.mean(axis=1)) == (None, None)


def plain_pava(steps):
    """Repeatedly merges the first falling neighbours."""
    blocks = [[h, n, x, x] for x, h, n in steps]
    while True:
        for k in range(len(blocks) - 1):
            if blocks[k][0] / blocks[k][1] >= blocks[k + 1][0] / blocks[k + 1][1]:
                a, z = blocks[k], blocks.pop(k + 1)
                blocks[k] = [a[0] + z[0], a[1] + z[1], a[2], z[3]]
                break
        else:
            return [(low, high, h / n) for h, n, low, high in blocks]


def test_isotonic_map_against_plain_pooling():
    rnd = random.Random(3)
    for _ in range(50):
        steps = [(i / 10, float(rnd.randrange(0, 5)), 5.0) for i in range(rnd.randrange(1, 12))]
        got, want = validation.pooled_steps(steps), plain_pava(steps)
        assert len(got) == len(want) and all(abs(a - b) < 1e-12 for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_calibrated_confidence_never_exceeds_the_raw_one(spark):
    rows = registry.QUERIES["v10_calibrated_confidence"](spark, SF).collect()
    assert rows and all(r.calibrated <= r.confidence + 1e-9 for r in rows)
    by_confidence = [r.calibrated for r in sorted(rows, key=lambda r: r.confidence)]
    assert all(a <= b + 1e-6 for a, b in zip(by_confidence, by_confidence[1:], strict=False))


def test_share_book():
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 8)
    rows = pd.DataFrame([(d1, 1, 0.5, 10.0), (d1, 2, 0.5, 20.0), (d1, 3, 0.2, None), (d2, 1, None, 12.0), (d2, 2, 0.5, 20.0)], columns=["fill_date", "ticker", "weight", "price"])
    a, b = books.share_book(rows, start=1000.0, bps=0.0).to_dict("records")
    assert (a["cash"], a["nav"], a["unfilled"], a["n_positions"]) == (0.0, 1000.0, 1, 2)  # 50 at 10, 25 at 20
    assert b["nav"] == 1100.0 and b["n_positions"] == 1 and b["cash"] == 1100.0 - 27 * 20  # all of 1 sold; 550 / 20 = 27 of 2
    assert abs(b["ret"] - 0.1) < 1e-12 and abs(b["turnover"] - (600 + 40) / 1000) < 1e-12
    with_cost = books.share_book(rows.iloc[:1], start=1000.0, bps=100.0).to_dict("records")[0]
    assert with_cost["fees"] == 5.0 and with_cost["nav"] == 995.0


def test_applied_fills():
    rows = pd.DataFrame([(3, 7, "sell", 4, 15.0), (1, 7, "buy", 10, 10.0), (2, 7, "buy", 10, 12.0), (4, 7, "sell", 40, 15.0), (5, 8, "buy", 1000, 10.0), (6, 8, "buy", 1, None)], columns=["order_id", "ticker", "side", "qty", "price"])
    got = books.apply_fills(rows, start=300.0, fee=1.0).to_dict("records")
    assert [g["status"] for g in got] == ["filled", "filled", "filled", "oversell", "no_cash", "unfilled"]
    assert [round(g["cash"], 6) for g in got] == [199.0, 78.0, 137.0, 137.0, 137.0, 137.0]
    assert got[2]["realized"] == (15 - 11) * 4 and got[2]["position"] == 16 and got[2]["mean_cost"] == 11.0


def test_accounts_add_up(spark):
    for r in registry.QUERIES["l12_account_days"](spark, SF).collect():
        assert r.cash >= 0 and r.equity >= r.cash


def test_new_share_is_one_less_r_squared(spark):
    got = {r.candidate: r for r in registry.QUERIES["m4_incremental_contribution"](spark, SF).collect()}
    days = mining.many_days(spark, SF).where("net is not null").select("strategy", "date", "net").toPandas().pivot(index="date", columns="strategy", values="net").dropna()
    for name, r in got.items():
        corr = days.corr()[name].drop(name).abs()
        others = corr.sort_values(ascending=False).index
        design = np.column_stack([np.ones(len(days)), days[others]])
        beta, *_ = np.linalg.lstsq(design, days[name], rcond=None)
        rest = ((days[name] - design @ beta) ** 2).sum() / ((days[name] - days[name].mean()) ** 2).sum()
        assert r.nearest == corr.idxmax() and abs(r.new_share - rest) < 1e-5


def test_first_row_after_a_time(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    left = spark.createDataFrame([(1, day(k), k) for k in (0, 3, 4, 9)] + [(2, day(1), 7)], "k long, t date, id long")
    right = spark.createDataFrame([(1, day(3), 30.0), (1, day(5), 50.0)], "k long, at date, v double")
    got = {(r.k, r.id): r.v for r in next_after(left, right, "k", "t", "at", ["v"]).collect()}
    assert got == {(1, 0): 30.0, (1, 3): 50.0, (1, 4): 50.0, (1, 9): None, (2, 7): None}


def test_first_row_after_a_time_is_carried_by_a_growing_frame(spark):
    """A frame to the history's end is read anew for each row: 40 000 of one key took as many passes.  Nulls are after nothing."""
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    left = spark.createDataFrame([(1, None, 0), (None, day(0), 1), (1, day(0), 2)], "k long, t date, id long")
    right = spark.createDataFrame([(1, day(3), 30.0), (1, None, 10.0), (None, day(5), 50.0)], "k long, at date, v double")
    df = next_after(left, right, "k", "t", "at", ["v"])
    assert {r.id: r.v for r in df.collect()} == {0: None, 1: None, 2: 30.0}
    assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()


def test_small_weights_are_written_as_sql_does(spark):
    """From a thousand names a side on a weight is under 0.001, which Spark's cast writes as 9.0E-4."""
    duckdb = pytest.importorskip("duckdb")
    w = [s / n for s in (1, -1) for n in [*range(1, 3000), 4000, 12000, 12001, 19999, 20000, 20001, 72000, 400_000]]
    got = [r.t for r in spark.createDataFrame([(x,) for x in w], "w double").coalesce(1).select(portfolio.weight_text(F.col("w")).alias("t")).collect()]
    want = [r[0] for r in duckdb.connect().execute("SELECT '' || round(w, 4) FROM (SELECT unnest($1::DOUBLE[]) AS w)", [w]).fetchall()]
    assert got == want


def test_quantiles_by_ranges_are_exact(spark):
    rnd = random.Random(6)
    x = [rnd.choice([rnd.gauss(0, 1), 0.0, 5.0]) for _ in range(5000)]
    q = [0.0, 0.005, 0.3, 0.995, 1.0]
    r = store.exact_quantiles(spark.createDataFrame([(v,) for v in [*x, None]], "x double"), "x", q, parts=16).first()
    assert all(abs(r[f"q{k}"] - np.quantile(x, p)) < 1e-12 for k, p in enumerate(q))


def test_structure_of_expressions():
    same = expressions.canonical
    assert same("a + b * c") == same("c * b + a") and same("f(a, b)") != same("f(b, a)") and same("a - b") != same("b - a")
    assert same("not an (expression").startswith("text:")


def test_operators_are_refused(spark):
    panel = spark.createDataFrame([(t, dt.date(2024, 1, d), None if t == 0 else float(d)) for t in range(3) for d in range(1, 6)], "ticker long, date date, v double")
    assert list(acceptance.accepted(panel, {"twice": lambda p, c: c * 2})) == ["twice"]
    with pytest.raises(ValueError, match="fills"):
        acceptance.accepted(panel, {"fills": lambda p, c: F.coalesce(c, F.lit(1.0))})
    assert list(acceptance.accepted(panel, {"mean": OPERATORS["ts_mean"], "zscore": OPERATORS["zscore"]}, {"mean": (3,)})) == ["mean", "zscore"]


def doubled(p, c):
    p.df = p.df.unionAll(p.df)
    return c


def fewer(p, c):
    p.df = p.df.where("v is not null")
    return c


@pytest.mark.parametrize(
    ("operator", "numbers", "property_"),
    [
        (lambda p, c: 3, (), "signature"),
        (lambda p, c, n: c * n, (), "signature"),
        (lambda p: F.lit(1.0), (), "signature"),
        (lambda p, c: F.col("nothing"), (), "evaluation"),
        (lambda p, c: 1 // 0, (), "evaluation"),
        (lambda p, c: F.raise_error(F.lit("never")), (), "evaluation"),
        (doubled, (), "shape"),
        (fewer, (), "shape"),
        (lambda p, c: F.coalesce(c, F.lit(1.0)), (), "missing"),
        (lambda p, c: F.coalesce(c, F.avg(c).over(p.section)), (), "missing"),
        (lambda p, c: F.lead(c).over(p.history), (), "later"),
        (lambda p, c: c - F.avg(c).over(Window.partitionBy(p.entity)), (), "later"),
        (lambda p, c, n: c * n, (2,), None),
        (OPERATORS["ts_rank"], (4,), None),
        (OPERATORS["rank"], (), None),
        (OPERATORS["hump"], (0.1,), None),
    ],
)
def test_the_property_that_an_operator_fails_is_named(spark, operator, numbers, property_):
    assert acceptance.failing(spark, operator, numbers) == property_


def test_membership_and_vendor_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text("date,tickers\n2024-01-01,\"BRK.B, AAPL,,BRK.B\"\n2024-02-01,MSFT\n")
    got = {(str(r.date), r.ticker) for r in store.read_membership(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {("2024-01-01", "BRK-B"), ("2024-01-01", "AAPL"), ("2024-02-01", "MSFT")}
    row = store.normalize(spark.createDataFrame([("2024-01-05", "X", "1.5", "bad")], "Date string, sym string, Open string, `Adj.Close` string"), {"Date": "date", "sym": "ticker", "Adj.Close": "close"}).first()
    assert (str(row.date), row.ticker, row.open, row.close, row.volume) == ("2024-01-05", "X", 1.5, None, None)


def test_families_by_tenors(spark):
    """Two tenors in fields of implied volatility are a term structure, whatever the numbers; one is an option's field."""
    from sparkfolio.functions.expressions import family

    want = {
        "subtract(implied_volatility_call_30, implied_volatility_call_90)": "iv_term",
        "rank(implied_volatility_mean_30)": "options",
        "subtract(implied_volatility_call_30, implied_volatility_put_30)": "options",
        "divide(atm_iv_20, atm_iv_60)": "iv_term",
        "divide(native_20, native_60)": "other",
        "ts_delta(implied_volatility_call_30, 5)": "iv_momentum",
    }
    rows = spark.createDataFrame([(e,) for e in want], "e string").select("e", family(F.col("e")).alias("f")).collect()
    assert {r["e"]: r["f"] for r in rows} == want


def test_dictionary_of_the_caller(spark, tmp_path):
    """Words of a file: cases, blanks and other sides; counts with the dictionary sent and joined."""
    from sparkfolio.functions import lexicon
    from sparkfolio.sources.dictionary import read_dictionary

    (tmp_path / "d.csv").write_text("word,side,note\nUp,Positive,x\nup,positive,again\n rise ,positive,\ndown,negative,\ntwo words,negative,\nflat,neutral,\nflat2,negative,\nboth,positive,\nboth,negative,\n")
    d = read_dictionary(spark, str(tmp_path / "d.csv"))
    assert {tuple(r) for r in d.collect()} == {("up", "positive"), ("rise", "positive"), ("down", "negative"), ("both", "positive"), ("both", "negative")}
    texts = [(1, "Up, up and RISE! uprise up2 down_ down"), (2, None), (3, ""), (4, "both flat"), (5, "up " * 5000)]
    items = spark.createDataFrame(texts, "k long, t string")
    want = {1: (3, 1), 2: (0, 0), 3: (0, 0), 4: (1, 1), 5: (5000, 0)}
    for most in (lexicon.SENT, 0):
        before, lexicon.SENT = lexicon.SENT, most
        try:
            assert {r["k"]: (r["good"], r["bad"]) for r in lexicon.counted(items, "k", F.col("t"), d).collect()} == want
        finally:
            lexicon.SENT = before


def test_dealt_resamples_do_not_hang_on_the_tasks(spark):
    """The same interval with one resample a row, seven, and all in one; and a plain loop over the same draws."""
    rng = random.Random(2)
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), None if i % 13 == 0 else rng.gauss(k, 1)) for k in (1, 2) for i in range(80)] + [(3, dt.date(2024, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "k long, date date, x double")
    metrics = {"m": ("x", np.mean), "s": ("x", np.std)}
    got = [sorted(tuple(r) for r in resample.intervals(df.repartition(n), "k", "date", metrics, draws=60, together=t).collect()) for n, t in ((1, 60), (5, 7), (3, 1))]
    assert got[0] == got[1] == got[2] and got[0][2] == (3, None, None, None, None)
    x = np.array([v for k, _, v in rows if k == 1 and v is not None])
    means = [np.mean(resample.resampled(x, number, 42, 20)) for number in range(60)]
    assert got[0][0][1:3] == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    blocks = np.array([np.mean(np.diff(resample.resampled(np.arange(500.0), number, 1, 20)) == 1) for number in range(50)])
    assert 0.93 < blocks.mean() < 0.97  # one step in twenty begins a block


def test_option_chains_of_a_vendor(spark, tmp_path):
    """Columns in any order and case, other kinds and missing columns; only the nearest expiry counts."""
    from sparkfolio.operators import options
    from sparkfolio.sources.chains import nearest_expiry, read_chain

    now = dt.date(2024, 5, 1)
    rows = [
        (1, " CALL", 100.0, 0.2, 10, 50, dt.date(2024, 5, 17), now, "x"), (1, "put", 95.0, 0.25, 30, 20, dt.date(2024, 5, 17), now, "x"),
        (1, "call", 100.0, 0.2, 999, 999, dt.date(2024, 6, 21), now, "x"), (1, "put", 100.0, 0.2, 999, 999, dt.date(2024, 4, 19), now, "x"),
        (2, "call", 50.0, 0.0, None, 5, dt.date(2024, 5, 1), now, "x"), (2, "straddle", 50.0, 0.3, 7, 5, dt.date(2024, 5, 1), now, "x"),
        (3, "put", 20.0, 0.4, 4, 5, dt.date(2024, 5, 1), now, "x"),
    ]
    df = spark.createDataFrame(rows, "Ticker int, KIND string, strike double, iv double, volume int, open_interest int, expiry date, as_of date, vendor string")
    df.write.parquet(str(tmp_path / "c"))
    chain = nearest_expiry(read_chain(spark, str(tmp_path / "c")))
    assert {(r["ticker"], r["kind"], r["volume"], round(r["tau"] * 365, 6)) for r in chain.collect()} == {(1, "call", 10.0, 16.0), (1, "put", 30.0, 16.0), (2, "call", None, 0.5), (3, "put", 4.0, 0.5)}
    z = {r["ticker"]: r["z"] for r in options.put_call(chain).collect()}
    bent = lambda puts, calls, rank: (-math.tanh((puts / max(calls, 1) - 1) * 1.5) - math.tanh((rank - 50) / 30)) / 2 * 2
    assert z[1] == pytest.approx(bent(30, 10, 50)) and z[2] == 0.0 and z[3] == pytest.approx(bent(4, 0, 100))

    def gamma(spot, strike, iv, tau):
        d = (math.log(spot / strike) + (0.045 + 0.5 * iv * iv) * tau) / (iv * math.sqrt(tau))
        return math.exp(-0.5 * d * d) / math.sqrt(2 * math.pi) / (spot * iv * math.sqrt(tau))

    spot = spark.createDataFrame([(1, 98.0), (2, 50.0), (3, 0.0)], "ticker long, spot double")
    got = {r["ticker"]: r for r in options.gamma_exposure(chain, spot).collect()}
    signed = (gamma(98.0, 100.0, 0.2, 16 / 365) * 50 - gamma(98.0, 95.0, 0.25, 16 / 365) * 20) * 100 * 98.0 * 98.0
    assert set(got) == {1} and got[1]["signed"] == pytest.approx(signed) and (got[1]["regime"], got[1]["n_strikes"]) == ("mixed", 2)
