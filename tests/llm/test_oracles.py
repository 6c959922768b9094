"""The SQL of the operators against their queries, over whole tables."""

import os

import duckdb
import pytest

from tidereel.llm import queries

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    names = ", ".join(sorted(want.columns))
    rows = [tuple(r) for r in got.select(*sorted(got.columns)).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, con.sql(f"SELECT {names} FROM want").fetchall()))
