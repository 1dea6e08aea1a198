"""Every query of the subpackage on the smallest tables; those with SQL against DuckDB."""

import os

import duckdb
import pytest

from framewright.llm import queries as Q


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    rows = df.collect()
    assert rows
    if name in Q.SQL:
        con = duckdb.connect()
        for f in os.listdir(data):
            con.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
        got = con.execute(Q.SQL[name])
        cols = [c[0] for c in got.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted(str([r[c] for c in cols]) for r in rows) == sorted(str(list(r)) for r in got.fetchall())
