"""Corpus queries against their SQL, value for value."""

import duckdb
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    theirs = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in theirs.description]
    ours = queries.QUERIES[name](spark, SF)
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, ours.select(*columns).collect()))) == sorted(map(str, theirs.fetchall()))
