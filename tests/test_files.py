"""File sources and sinks: CSV contract, casts, split writes, versioned CSV, fingerprint."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rareflow.session import work_path
from rareflow.sources import files as FS


def write_text(spark, path, lines):
    spark.createDataFrame([(l,) for l in lines], "value string").coalesce(1).write.text(path)


def test_inferred_csv_contract(spark):
    good = work_path(spark, "t-csv")
    write_text(spark, good, ["a,b,y", "1.5,2,0", "2.5,3,1"])
    df = FS.scan_csv_inferred(spark, good, ["a", "b", "y"])
    assert dict(df.dtypes) == {"a": "double", "b": "int", "y": "int"}
    bad = work_path(spark, "t-csv-bad")
    write_text(spark, bad, ["a,b,y", "inf,2,0", "2.5,3,1"])
    with pytest.raises(ValueError, match="numeric columns"):
        FS.scan_csv_inferred(spark, bad, ["a", "b", "y"])


def test_cast_csv_turns_bad_text_into_null(spark):
    path = work_path(spark, "t-csv-cast")
    write_text(spark, path, ["a,y", "1.5,0", "oops,1", "3,1"])
    rows = FS.scan_csv_cast(spark, path, ["a", "y"]).orderBy("y", "a").collect()
    assert [r["a"] for r in rows] == [1.5, None, 3.0]
    with pytest.raises(ValueError):
        FS.scan_csv_cast(spark, path, ["missing"])


def test_split_write_refuses_overwrite_and_versioned_name(spark):
    df = spark.range(5)
    path = work_path(spark, "t-split")
    FS.write_split(df, path)
    with pytest.raises(Exception):
        FS.write_split(df, path)
    FS.write_split(df.limit(2), path, overwrite=True)
    assert spark.read.parquet(path).count() == 2
    out = FS.write_csv_versioned(df, work_path(spark, "t-ver") + "/balanced", 3, dt.datetime(2024, 5, 6, 7, 8, 9))
    assert out.endswith("balanced_v3_20240506-070809.csv")
    assert spark.read.option("header", True).csv(out).count() == 5


def test_fingerprint_order_insensitive(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7 % 13).alias("v"))
    a = FS.table_fingerprint(df).first()
    b = FS.table_fingerprint(df.repartition(7).orderBy(F.rand(3))).first()
    c = FS.table_fingerprint(df.withColumn("v", F.when(F.col("id") == 5, 99).otherwise(F.col("v")))).first()
    assert a == b and a != c and a["rows"] == 1000


def test_fingerprint_sees_values_move_between_columns(spark):
    rows = [[("x", None), ("1:y", "z")], [(None, "x"), ("1:y", "z")], [("x", None), ("1", "y:z")], [("x", None), ("1:y", None)]]
    prints = {tuple(FS.table_fingerprint(spark.createDataFrame(r, "a string, b string")).first()) for r in rows}
    assert len(prints) == 4


def test_fingerprint_hashes_each_row_by_two_seeds(spark):
    import hashlib

    texts = ["1:1;2:xy;", "2:12;n;", "1:3;0:;"]
    rows = spark.createDataFrame([(1, "xy"), (12, None), (3, "")], "a int, b string")
    sums = [str(sum(int(hashlib.md5(f"{seed}:{t}".encode()).hexdigest()[:15], 16) for t in texts)) for seed in (0, 1)]
    assert tuple(FS.table_fingerprint(rows).first()) == (3, *sums)


def test_file_sha256_matches_hashlib(spark):
    import glob
    import hashlib

    path = work_path(spark, "t-sha")
    spark.range(500).write.csv(path)
    got = {r["path"].split("/")[-1]: r["sha256"] for r in FS.file_sha256(spark, path, "*.csv").collect()}
    local = path.replace("file:", "")
    want = {p.split("/")[-1]: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in glob.glob(f"{local}/*.csv")}
    assert got == want and got


def test_few_files_hold_the_rows_that_a_shuffle_would_deal_them(spark):
    from rareflow.plans.io_queries import _write_few_files

    rows = spark.range(400).select(F.when(F.col("id") % 9 > 0, F.col("id") % 50).alias("k"), "id")
    path = work_path(spark, "t-few")
    _write_few_files(spark, rows, "k", 4, path)
    name = F.input_file_name()
    got = spark.read.parquet(path).groupBy(name.alias("f")).agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    want = rows.repartition(4, "k").groupBy(F.spark_partition_id()).agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    assert sorted(r.ids for r in got) == sorted(r.ids for r in want) and len(got) == 4
    none = work_path(spark, "t-few-none")
    _write_few_files(spark, rows.limit(0), "k", 4, none)
    assert spark.read.parquet(none).count() == 0
