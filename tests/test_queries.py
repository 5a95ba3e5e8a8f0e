"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import math
import os

import duckdb
import pytest

from synchra.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        path = f"{SF}/{t}/*.parquet" if os.path.isdir(f"{SF}/{t}") else f"{SF}/{t}"
        c.execute(f"create view {t.split('.')[0]} as select * from '{path}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [[plain(r[c]) for c in cols] for r in df.collect()]
    if name not in q.SQL:
        assert rows
        return
    r = duck.execute(q.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = [[plain(x[names.index(c)]) for c in cols] for x in r.fetchall()]
    key = lambda x: tuple(map(str, x))
    got, want = sorted(rows, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and x == pytest.approx(y, abs=2e-6))
