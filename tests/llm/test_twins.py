"""The queries that SQL can express, against their DuckDB twins on the smallest tables."""

import duckdb
import pytest

from quillspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    got = queries.queries()[name](spark, SF)
    assert set(got.columns) == set(names)
    assert sorted(str(tuple(r[n] for n in names)) for r in got.collect()) == want
