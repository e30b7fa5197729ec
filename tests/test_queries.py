"""Every registered query of the imaging operators against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from corvox.plans import catalog

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    con.execute("set timezone = 'UTC'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(name, spark, db):
    got = catalog.QUERIES[name](spark, str(SF))
    columns = sorted(got.columns)
    want = db.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want
