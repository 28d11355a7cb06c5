"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from gridloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(row):
    return tuple("" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df, sql = catalog.queries()[name](spark, SF), duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    got = sorted(plain(r) for r in df.select(*columns).collect())
    want = sorted(plain(r) for r in sql.select(*[f'"{c}"' for c in columns]).fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
