"""The operators that SQL can express, against their SQL over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from strideline.llm.queries import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no generated tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = QUERIES[name](spark, str(DATA))
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=str)
    want = rel.fetchall()
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in want), key=str)
