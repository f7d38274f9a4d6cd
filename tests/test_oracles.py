"""Every registered query with SQL, against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from helixlake.plans import catalogue

DATA = os.environ.get("HELIXLAKE_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    cursor = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    show = lambda rows: sorted("|".join("null" if v is None or v != v else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)
    got = [[v.item() if hasattr(v, "item") else v for v in r] for r in got[order].itertuples(index=False)]
    place = [columns.index(c) for c in order]
    want = [[r[i] for i in place] for r in cursor.fetchall()]
    number = lambda rows: [[float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r] for r in rows]
    assert show(number(got)) == show(number(want))


def test_queries_without_sql_run(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    for name in sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)):
        assert catalogue.QUERIES[name](spark, DATA).count() >= 0
