"""Every query of the catalog with SQL gives the rows that DuckDB gives, over a small table set."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from folioquill import catalog

DATA = "/root/testdata/sf0.001"


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data), sorted(columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name not in catalog.SQL:
        assert df.columns
        return
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    r = c.execute(catalog.SQL[name])
    assert got == rows([d[0] for d in r.description], r.fetchall())


def test_entry_registers_all():
    assert set(catalog.SQL) <= set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
