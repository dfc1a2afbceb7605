"""Every registered query of the library against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from caselake import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(round(float(r[k]), 6) if isinstance(r[k], float) or type(r[k]).__name__ == "Decimal" else r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(plans.registered()))
def test_query(spark, duck, name):
    df = plans.registered()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in plans.oracles():
        assert got
        return
    want = duck.execute(plans.oracles()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, want.fetchall())
