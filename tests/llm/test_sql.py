"""Queries that SQL can express, against DuckDB on whole small tables."""

import duckdb
import pytest

from windspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    ours = queries.QUERIES[name](spark, sf)
    theirs = con.sql(queries.ORACLES[name])
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    assert sorted(tuple(r[c] for c in cols) for r in ours.collect()) == sorted(con.sql(f"select {', '.join(cols)} from theirs").fetchall())
