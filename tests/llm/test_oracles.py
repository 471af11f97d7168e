"""The operators that SQL can express, against DuckDB on whole tables."""

from collections import Counter

import duckdb
import pytest

from skein.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    want = con.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == Counter(want.fetchall())
