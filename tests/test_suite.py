"""Every registered query of the fact engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from eavspark import stored_suite, suite

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for name in suite.KEYS:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", suite.CASES)
def test_against_sql(spark, sql, name):
    df = suite.queries()[name](spark, SF)
    expected = sql.sql(suite.oracle_sql()[name])
    assert df.columns == expected.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected.fetchall(), key=repr)


@pytest.mark.parametrize("name", stored_suite.CASES)
def test_stored_against_sql(spark, sql, name):
    df = stored_suite.queries()[name](spark, SF)
    expected = sql.sql(stored_suite.oracle_sql()[name])
    assert df.columns == expected.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["not", "or", "pattern", "bag", "join", "not_value", "or_predicates"])
def test_plans_of_deltas_hold_no_rows(spark, name):
    """Rows in a plan are in the driver's memory, once a scan."""
    df = stored_suite.queries()[f"delta_{name}"](spark, SF)
    assert "LocalRelation" not in df._jdf.queryExecution().analyzed().toString()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_star_is_one_scan(spark):
    assert plan(suite.queries()["scan_star"](spark, SF)).count("FileScan") == 1


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(suite.queries()["scan_constant_value"](spark, SF))
    assert "EqualTo(c_mktsegment,BUILDING)" in text and "c_acctbal" not in text


def test_top_k(spark):
    assert "TakeOrderedAndProject" in plan(suite.queries()["order_limit"](spark, SF))
