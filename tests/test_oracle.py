"""Every query with SQL, side by side with DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from lexforge.plans.queries import ORACLES, QUERIES


def norm(rows):
    def one(x):
        if isinstance(x, float):
            return repr(round(x, 6))
        return str(x.tolist() if hasattr(x, "tolist") else x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    if name not in ORACLES:
        assert rows
        return
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert norm(rows) == norm([tuple(r[names.index(c)] for c in columns) for r in want.fetchall()])
