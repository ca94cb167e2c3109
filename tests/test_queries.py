"""Every query with a reference statement gives its rows, on the smallest data."""

import os
from functools import cache

import duckdb
import pytest

from maskwright.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DISTINCT = {id(f): name for name, f in reversed(QUERIES.items())}.values()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@cache
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(DISTINCT))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in ORACLE_SQL:
        assert len(got) > 0
        return
    want = duck().execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    assert sorted(repr(tuple(r[c] for c in order)) for r in got) == sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
