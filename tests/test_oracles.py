"""Every query with a SQL counterpart is compared with it at the smallest scale."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, norm
from conftest import SF

NAMES = [n for n in entry.queries() if n in entry.oracle_sql()]
#: The raster queries read the same 500 vectors at both small scales and take minutes in all:
#: run them with RUN_SLOW=1 (check.py compares them too).
TABLES_ONLY = re.compile("[aegjosuw]|t[^1-9]")
SLOW = pytest.mark.skipif(not os.environ.get("RUN_SLOW"), reason="slow: set RUN_SLOW=1")


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n if TABLES_ONLY.match(n) else pytest.param(n, marks=SLOW) for n in NAMES])
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 500
