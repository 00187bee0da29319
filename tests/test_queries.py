"""Every registered query at sf0.001: it runs, and where it has a SQL twin, DuckDB agrees
(same column names and types, same multiset of rows with exact floats)."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as E

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from oracle_check import TABLES, duck_types, rows_of, spark_types  # noqa: E402

from conftest import SF  # noqa: E402

QUERIES, ORACLES = E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert df.columns
        return
    rel = duck.sql(ORACLES[name])
    assert spark_types(df) == duck_types(rel)
    sc, sr = rows_of(df.columns, rows)
    oc, orows = rows_of(rel.columns, rel.fetchall())
    assert sc == oc and len(sr) == len(orows) and sr == orows
