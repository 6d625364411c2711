"""Every core query against its SQL in another engine, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from inkgraph.plans import core, registry  # noqa: F401  (registers all queries)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def shown(v):
    if v is None or isinstance(v, float) and v != v:
        return "NULL"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sf, con, name):
    df = core.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    if name not in core.SQL:
        assert got
        return
    res = con.execute(core.SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in res.fetchall())
