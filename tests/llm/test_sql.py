"""The queries that have SQL against it."""

import os

import duckdb
import pytest

from scenequery.llm import queries

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    df = queries.queries()[name](spark, DIR)
    x = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in x.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert got == sorted(x.fetchall(), key=repr) and got
