"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from planiscope.plans import catalog

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "quantize"):
        return round(float(v), 5)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(cols).collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-5, abs_tol=2e-5)), (a, b)
