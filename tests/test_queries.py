"""Every analytics query against its SQL, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from strideline.plans.oracle import ORACLE
from strideline.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no generated tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, bool) or not isinstance(v, int):
        return str(v)
    return float(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(normal(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, str(DATA))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        assert got[1]
        return
    rel = db.sql(ORACLE[name])
    assert got == rows(rel.columns, rel.fetchall())
