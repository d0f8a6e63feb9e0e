"""Every query of the catalogue against its SQL, run by DuckDB."""

import datetime
import os

import duckdb
import pytest

from scenequery.plans import catalog, columns, scene_queries  # noqa: F401

DIR = os.environ.get("CATALOG_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    if name not in catalog.SQL:
        assert df.count()
        return
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    x = duck.execute(catalog.SQL[name])
    names = [c[0] for c in x.description]
    at = [names.index(c) for c in cols]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[i]) for i in at) for r in x.fetchall()), key=repr)
    assert got == want
    assert got
