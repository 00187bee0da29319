"""Driver contract: entry runs, every oracle has a query, a sample of queries equals its SQL."""

import duckdb

import __spark_entry__ as E

from conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) >= {"threshold", "f1"}


def test_oracles_have_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_sample_queries_equal_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    q, o = E.queries(), E.oracle_sql()
    for name in ["threshold_sweep", "auprc", "hash_split", "parse_events", "balance_classes_exact"]:
        s = q[name](spark, SF).toPandas()
        d = con.execute(o[name]).fetchdf()
        assert sorted(s.columns) == sorted(d.columns), name
        assert len(s) == len(d), name
