"""The queries that SQL can express, against DuckDB over the same tables."""

import duckdb
import pytest

from vigilark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    frame = QUERIES[name](spark, folder)
    assert sorted(frame.columns) == sorted(columns)
    assert want and sorted(map(tuple, frame.select(columns).collect())) == want


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
