"""Every registered query of the benchmark jobs against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from verdict_lake import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert len(a) == len(b)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, duck, name):
    out = catalog.queries()[name](spark, DATA).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(out) > 0
    else:
        same(out, duck.sql(sql).df())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
