"""Every registered query against its oracle SQL on the smallest tables."""

import duckdb
import pytest

import oracle_set
import query_set
from check_oracles import TABLES, _rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_oracles_belong_to_queries():
    assert set(oracle_set.ORACLES) <= set(query_set.QUERIES)


@pytest.mark.parametrize("key", [k for k in query_set.QUERIES if k in oracle_set.ORACLES])
def test_query_equals_oracle(spark, duck, key, monkeypatch):
    import os
    import time

    monkeypatch.setitem(os.environ, "TZ", "UTC")
    time.tzset()
    df = query_set.QUERIES[key](spark, SF)
    result = duck.execute(oracle_set.ORACLES[key])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, result.fetchall())
