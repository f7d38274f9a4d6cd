import re

import __spark_entry__ as entry


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    found = sorted(int(m[1]) for n in queries if (m := re.match(r"op([0-9]+)_", n)))
    assert found == list(range(1, 11)) and "pipeline" in queries
    assert set(sql) <= set(queries)
    assert all(isinstance(v, str) for v in sql.values()) and all(callable(v) for v in queries.values())


def test_chat_and_mixing_equal_their_sql(spark):
    import os

    import duckdb
    import pytest

    data = os.environ.get("HELIXLAKE_TESTDATA", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    for name in ("op5_mixing", "op7_chat"):
        got = entry.queries()[name](spark, data)
        cursor = con.execute(entry.oracle_sql()[name])
        place = [[c[0] for c in cursor.description].index(c) for c in got.columns]
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in place) for r in cursor.fetchall())
