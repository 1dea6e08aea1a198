"""Every query that has SQL, against DuckDB on the smallest tables; the others must run and give a stable schema."""

import math
import os

import duckdb
import pytest

from framewright.plans import core_queries, reference_queries, service_queries

ALL = {**core_queries.QUERIES, **reference_queries.QUERIES, **service_queries.QUERIES}
SQL = {**core_queries.SQL, **reference_queries.SQL, **service_queries.SQL}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.8g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else v if v is None else str(v)


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", list(ALL))
def test_query(spark, data, db, name):
    df = ALL[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    if name in SQL:
        want = db.execute(SQL[name])
        at = [c[0] for c in want.description]
        assert sorted(at) == cols
        assert got == sorted(str([plain(r[at.index(c)]) for c in cols]) for r in want.fetchall())


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(ALL) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
