"""Every registered query runs on the smallest tables and agrees with its SQL where it has one."""

import math
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = list(entry.registry.QUERIES)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def answers(spark):
    """Columns and rows of the queries, several at a time."""

    def run(name):
        df = entry.queries()[name](spark, SF)
        columns = sorted(df.columns)
        return columns, [tuple(plain(r[c]) for c in columns) for r in df.collect()]

    with ThreadPoolExecutor(4) as pool:
        yield {name: pool.submit(run, name) for name in OWN}
        pool.shutdown(cancel_futures=True)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return v


@pytest.mark.parametrize("name", OWN)
def test_query_agrees_with_sql(answers, db, name):
    columns, rows = answers[name].result()
    if name in entry.oracle_sql():
        result = db.execute(entry.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
        assert sorted(rows, key=repr) == want


def test_flagship(spark):
    assert entry.entry(spark).columns == ["date", "ic", "n"]
