"""Registered queries against their SQL."""

import duckdb
import pytest

from eavspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLES)
def test_against_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLES[name])
    got = df.select(*want.columns).collect()
    assert sorted(df.columns) == sorted(want.columns) and sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
