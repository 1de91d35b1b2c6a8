"""Every query of the engine that has SQL gives the same rows as DuckDB on sf0.001."""

import os

import duckdb
import pytest

from tellumen.plans.registry import QUERIES, SQL

DIR = os.environ.get("TELLUMEN_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    ours = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    theirs = sorted(duck.sql(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall(), key=key)
    assert ours == theirs


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_accounting_balances(spark):
    r = QUERIES["ag16_label_stats"](spark, DIR).first()
    assert r.n_in == r.n_post_failure + r.n_unobservable + r.n_short_history + r.n_out


def test_quantile_is_infinite_on_few_rows(spark):
    from tellumen.operators.conformal import thresholds

    cal = spark.createDataFrame([(1, 0.5), (0, 0.2), (1, float("nan"))], "y int, p double")
    assert thresholds(cal, 0.1, []).first().qhat == float("inf")


def test_missing_cell_falls_back(spark):
    from tellumen.operators.conformal import predict

    cal = spark.createDataFrame([(k % 2, k / 100, 0) for k in range(100)], "y int, p double, stage int")
    test = spark.createDataFrame([(1, 0.9, 0), (1, 0.9, 5)], "y int, p double, stage int")
    got = {r.stage: r.fallback for r in predict(test, cal, 0.1, "group").collect()}
    assert got == {0: False, 5: True}
