"""Every query against its SQL in DuckDB over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from flotsam.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    want, got = duck.execute(SQL[name]).df(), QUERIES[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (want, got))
    assert len(a) == len(b)
    for c in columns:
        try:
            pd.testing.assert_series_equal(a[c].astype(float), b[c].astype(float), check_names=False, atol=2e-6)
        except (ValueError, TypeError):
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
