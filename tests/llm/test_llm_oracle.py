"""Queries with SQL against DuckDB."""

import glob
import os

import duckdb
import pytest

from sidewind.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_oracle(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    rows = lambda cols, data: sorted(repr(tuple(r[cols.index(c)] for c in sorted(cols))) for r in data)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cur.fetchall())
