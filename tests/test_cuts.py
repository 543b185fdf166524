"""Books by cuts against plain Python; how often the weekly panel is dealt."""

import datetime as dt
import math
import random
import re

import numpy as np
import pytest

from sparkfolio.operators import cuts
from sparkfolio.sources.tables import panel_weekly

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\((\w+)", df._jdf.queryExecution().executedPlan().toString())


def test_the_weekly_panel_is_dealt_once_by_ticker(spark):
    """Bars, gaps and windows by ticker take one exchange of the lines; all others are of weeks."""
    assert [e for e in exchanges(panel_weekly(spark, SF, places=False)) if e != "date"] == ["ticker"]


def plain(rows, name, top):
    """date -> (moved, net, ic) of a book, one row at a time."""
    dates = sorted({r["date"] for r in rows})
    weights, out, booked = {}, {}, None
    for d in dates:
        here = [r for r in rows if r["date"] == d]
        known = sorted((r for r in here if r[name] is not None), key=lambda r: (math.isnan(r[name]), 0.0 if math.isnan(r[name]) else r[name], r["ticker"]))
        n, now = len(known), {}
        share = {r["ticker"]: (k + 1) / n for k, r in enumerate(known)} if n >= 10 else {}
        for sign, side in ((1, [t for t, s in share.items() if s >= 1 - top]), (-1, [t for t, s in share.items() if s <= top])):
            now |= {t: sign / len(side) for t in side}
        delta = {r["ticker"]: abs(now.get(r["ticker"], 0.0) - weights.get(r["ticker"], 0.0)) for r in here}
        money = {r["ticker"]: (r["close"] or 0.0) * (r["volume"] or 0.0) for r in here}
        paid = [now.get(r["ticker"], 0.0) * r["fwd"] for r in here if r["fwd"] is not None]
        slipped = sum(x * 2 * math.sqrt(100 * x * 100_000 / money[t]) / 10_000 for t, x in delta.items() if money[t] > 0)
        pairs = [r for r in known if r["fwd"] is not None]
        by_fwd = {r["ticker"]: k for k, r in enumerate(sorted(pairs, key=lambda r: (r["fwd"], r["ticker"])))}
        ic = float(np.corrcoef(range(len(pairs)), [by_fwd[r["ticker"]] for r in pairs])[0, 1]) if len(pairs) >= 3 else 0.0
        moved = sum(delta.values())
        out[d] = (moved, booked, ic)
        lent = -sum(min(w, 0) for w in now.values()) * 50 / (10_000 * 252)
        booked = sum(paid) - moved * 5 / 10_000 - slipped - lent if paid else None
        weights = now
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_books_by_cuts_against_plain_python(spark, seed):
    """Ties, nulls and NaN among the factors, dates of too few names and without returns, two groups of dates."""
    rnd = random.Random(seed)
    value = lambda: rnd.choice([None, rnd.gauss(0, 1), rnd.gauss(0, 1), 0.0, 1.0, float("nan")])
    rows = []
    for g in (0, 1):
        for d in range(12):
            for t in range(40):
                few = d == 5 and t > 8
                rows.append({"g": g, "date": DAY + dt.timedelta(days=d), "ticker": t, "a": None if few else value(), "b": None if few else value(), "fwd": None if d in (3, 11) else rnd.choice([None, rnd.gauss(0, 0.1), 0.0]), "close": rnd.choice([None, 5.0, 20.0]), "volume": rnd.choice([0.0, 30.0])})
    rnd.shuffle(rows)
    f = spark.createDataFrame(rows, "g long, date date, ticker long, a double, b double, fwd double, close double, volume double")
    books = {"a2": ("a", 0.2), "a4": ("a", 0.4), "b1": ("b", 0.1)}
    got = {(r.g, r.strategy, r.date): r for r in cuts.book_days(f, books, ["g", "date"]).collect()}
    want = {(g, name, d): x for g in (0, 1) for name, (c, top) in books.items() for d, x in plain([r for r in rows if r["g"] == g], c, top).items()}
    assert got.keys() == want.keys()
    for k, (moved, net, ic) in want.items():
        r = got[k]
        assert r.moved == pytest.approx(moved, abs=1e-12) and r.ic == pytest.approx(ic, abs=1e-12), k
        assert (r.net is None) == (net is None) and (net is None or r.net == pytest.approx(net, abs=1e-12)), k
        assert (r.k, r.size) == ((k[2] - DAY).days, 12)


def test_no_dates_give_no_days(spark):
    f = spark.createDataFrame([], "date date, ticker long, a double, fwd double, close double, volume double")
    assert cuts.book_days(f, {"a": ("a", 0.2)}, ["date"]).count() == 0


BOOKS = ["b26_purged_folds", "b30_selection_funnel", "b21_deflated_sharpe", "b22_bootstrap_interval", "b22_dealt_bootstrap", "b27_candidate_fitness", "m4_incremental_contribution"]


@pytest.mark.parametrize("name", BOOKS)
def test_books_of_the_weekly_panel_lie_by_ticker(spark, monkeypatch, name):
    """All factors and returns of a query's books come from one exchange of the lines, and no row stands for a strategy."""
    from sparkfolio.plans import registry

    given = []
    real = cuts.book_days
    monkeypatch.setattr(cuts, "book_days", lambda f, *a, **k: given.append(f) or real(f, *a, **k))
    registry.QUERIES[name](spark, SF)
    (f,) = given
    assert [e for e in exchanges(f) if e != "date"] == ["ticker"]
    assert "strategy" not in f.columns


def test_only_ranked_values_of_the_seeds_go_to_the_dates(spark):
    """The finished values of all other seeds went through that exchange, too: over thirty columns."""
    from sparkfolio.plans import registry

    df = registry.QUERIES["e2_all_seeds"](spark, SF)
    text = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    by_date = [int(n) for n, args in re.findall(r"Exchange\nInput \[(\d+)\]:[^\n]*\nArguments: ([^\n]*)", text) if "hashpartitioning(date" in args]
    assert sorted(n for n in by_date if n > 1) == [10]  # eight values, date and ticker
