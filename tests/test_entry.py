"""The driver's contract on the smallest tables, where they are at hand."""

import os

import pytest

import __spark_entry__ as entry
from lexsift.plans import queries as plans

TABLES = "/root/testdata/sf0.001"
#: Queries that may find nothing in the smallest tables.
MAYBE_EMPTY = {"whitelist_suppressed", "fuzzy_findings", "article9_profile"}


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(plans.QUERIES) <= set(queries)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "conversations", "labels", "customer", "pages", "embeddings"):
        con.execute(f"CREATE TABLE {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    df = entry.queries()[name](spark, TABLES)
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda row: tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)
    rows = df.select(*columns).collect()
    assert sorted(map(key, rows)) == sorted(map(key, found.fetchall()))
    assert rows or name in MAYBE_EMPTY, "a twin of no rows proves nothing"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
