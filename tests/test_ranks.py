"""Ranks by ranges and sums over pairs of series, against plain Python."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import backtest as b
from sparkfolio.operators import gram
from sparkfolio.operators.joins import global_ordinal, running_before, shared_rank


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    # a third of all rows are one value of one key, and one key is null
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([0.0, 0.0, 0.0, rng.random(), -1.5, None]), i) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, v double, i long").repartition(7)


def first_null(v):
    return (v is not None, v if v is not None else 0)


def test_ordinals_with_many_ties_equal_brute_force_every_time(values):
    rows = values.collect()
    want = {}
    for key in {r["k"] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r["k"] == key), key=lambda r: (first_null(r["v"]), r["i"])), 1):
            want[r["i"]] = n
    for _ in range(3):
        assert {r["i"]: r["n"] for r in global_ordinal(values, "k", ["v", "i"], "n").collect()} == want


def test_ordinals_do_not_change_when_they_are_read_again(values):
    n = global_ordinal(values, "k", ["v"], "n")  # ties without an order of their own
    first = {r["i"]: r["n"] for r in n.collect()}
    assert {r["i"]: r["n"] for r in n.repartition(3).collect()} == first
    mine = {r["i"] for r in values.where("k = 'a'").collect()}
    assert sorted(x for i, x in first.items() if i in mine) == list(range(1, len(mine) + 1))


def test_ordinals_of_all_rows_in_falling_order(values):
    got = {r["i"]: r["n"] for r in global_ordinal(values, None, [F.desc_nulls_last("v"), "i"], "n").collect()}
    rows = sorted(values.collect(), key=lambda r: (r["v"] is None, -(r["v"] or 0), r["i"]))
    assert got == {r["i"]: n for n, r in enumerate(rows, 1)}


def test_sums_before_and_shared_ranks(values):
    got = {r["i"]: r["s"] for r in running_before(values, "k", ["v", "i"], "i", "s").collect()}
    rows = values.collect()
    for key in {r["k"] for r in rows}:
        total = 0
        for r in sorted((r for r in rows if r["k"] == key), key=lambda r: (first_null(r["v"]), r["i"])):
            assert got[r["i"]] == total
            total += r["i"]
    ordered = [first_null(r["v"]) for r in rows]
    for r in shared_rank(values, "v", "p").collect():
        assert r["p"] == 1 + sum(x < first_null(r["v"]) for x in ordered)


def test_no_rows(values):
    none = values.limit(0)
    assert global_ordinal(none, "k", ["v"], "n").count() == running_before(none, None, ["v"], "i", "s").count() == shared_rank(none, "v", "p").count() == 0


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(8)
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(60)]
    rows = [(f"f{k:02d}", d, None if rng.random() < 0.1 else 1000 + (1.0 if k == 5 else rng.gauss(0, 1) + k * i / 60)) for k in range(14) for i, d in enumerate(days) if k != 7 or i < 1]
    return spark.createDataFrame(rows, "name string, date date, value double")


@pytest.mark.parametrize(("size", "days"), [(256, 1024), (3, 7)])
def test_gram_matrices_equal_the_self_join(series, size, days):
    known = series.where("value is not null")
    join = known.toDF("a", "date", "x").join(known.toDF("b", "date", "y"), "date").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("cov"), b.correlation(F.col("x"), F.col("y")).alias("c"))
    want = {(r["a"], r["b"]): r for r in join.collect()}
    got = {(r["a"], r["b"]): r for r in gram.pair_sums(series, size=size, days=days).select("a", "b", "n", gram.covariance().alias("cov"), gram.correlation().alias("c")).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert got[k]["n"] == r["n"] and got[k]["cov"] == pytest.approx(r["cov"], abs=1e-9)
        assert (got[k]["c"] is None) == (r["c"] is None) and (r["c"] is None or got[k]["c"] == pytest.approx(r["c"], abs=1e-9))


def test_gram_matrices_of_two_libraries(series):
    new, old = series.where("name < 'f04'"), series.where("name >= 'f04'")
    got = gram.pair_sums(new, old, size=2, days=9)
    assert got.select("a").distinct().count() == 4 and got.where("a >= 'f04' or b < 'f04'").count() == 0
    assert got.count() == 4 * 10 or got.where("b = 'f07'").count() <= 4  # one series has one date at most
    assert gram.pair_sums(series.limit(0)).count() == 0


def test_a_value_goes_to_as_many_tasks_as_there_are_blocks(series):
    """Cells of blocks meet, not rows of series: 14 series in 5 blocks, 60 days in ten chunks at most."""
    members = gram._members(series.where("value is not null"), 3)
    assert members.select("block").distinct().count() <= 5
    assert gram._cells(series.where("value is not null"), members, 7).count() <= 5 * 10
