"""Every query against its SQL twin in DuckDB."""

import duckdb
import pytest

from vigilark.plans.oracles import ORACLES
from vigilark.plans.queries import QUERIES

TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "conversations"]
NAMES = sorted(ORACLES)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def in_order(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, folder, duck, name):
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = in_order(columns, cursor.fetchall())
    frame = QUERIES[name](spark, folder)
    assert sorted(columns) == sorted(frame.columns)
    got = in_order(frame.columns, [tuple(r) for r in frame.collect()])
    assert want and got == want


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)
