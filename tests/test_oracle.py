"""Every query with an oracle against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sidewind.plans import catalog


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_oracle(spark, sf, db, name):
    df = catalog.QUERIES[name](spark, sf)
    cur = db.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    want, got = rows(columns, cur.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == want


def test_a_wrong_query_is_caught(spark, sf, db):
    df = catalog.QUERIES["q_record"](spark, sf).selectExpr("participant_id", "wins + 1 AS wins", "losses", "draws", "bouts")
    cur = db.execute(catalog.ORACLE_SQL["q_record"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) != rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["q_glicko_class", "q_glicko_current", "q_fuzzy_pairs", "q_finish_score"])
def test_queries_without_oracle_have_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
