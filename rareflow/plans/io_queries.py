"""Queries for file sources and sinks: each writes to the shared work folder and reads back."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from rareflow.operators import metrics as M
from rareflow.operators import sampling as S
from rareflow.plans.data_queries import SPLIT_CTE, TX_COLS
from rareflow.plans.metric_queries import SWEEP_COLS, SWEEP_SQL
from rareflow.plans.registry import md5_hash_sql, register
from rareflow.plans.views import TX_FEATURES, TX_KEY, TX_SQL, orders_labelled, table, tx
from rareflow.session import work_path
from rareflow.sources import files as FS
from rareflow.streaming.stream import copy_file, move_file, path_exists

CSV_COLS = [*TX_FEATURES, "y"]


@register("scan_csv_inferred", "with " + TX_SQL + f" select {', '.join(CSV_COLS)} from tx")
def q_scan_csv_inferred(spark, d):
    path = work_path(spark, "csv")
    tx(spark, d).select(*CSV_COLS).write.option("header", True).csv(path)
    return FS.scan_csv_inferred(spark, path, CSV_COLS)


@register("scan_csv_cast", "with " + TX_SQL + f" select {', '.join(CSV_COLS)}, y::double as y_double from tx")
def q_scan_csv_cast(spark, d):
    path = work_path(spark, "csv")
    tx(spark, d).select(*CSV_COLS, F.col("y").alias("y_double")).write.option("header", True).csv(path)
    df = FS.scan_csv_cast(spark, path, [*TX_FEATURES, "y_double"])
    return df.select(*TX_FEATURES, F.col("y").cast("int").alias("y"), "y_double")


@register("write_split", f"with {SPLIT_CTE} select * from sp")
def q_write_split(spark, d):
    path = work_path(spark, "split")
    FS.write_split(S.hash_split(orders_labelled(spark, d), ["o_orderkey"]), path)
    try:
        FS.write_split(table(spark, d, "orders"), path)
        raise RuntimeError("an existing split was overwritten")
    except Exception as exc:  # noqa: BLE001
        if "already exists" not in str(exc) and "PATH_ALREADY_EXISTS" not in str(exc):
            raise
    return FS.scan_parquet(spark, path)


@register("write_csv_versioned", "with " + TX_SQL + f""",
m as (select least(count(*) filter (where y2 = 1), count(*) filter (where y2 = 0)) as m from tx),
r as (select *, row_number() over (partition by y2
          order by {md5_hash_sql(*TX_KEY, seed=42)}, {', '.join(TX_KEY)}) as rn from tx)
select {TX_COLS} from r where rn <= (select m from m)""")
def q_write_csv_versioned(spark, d):
    t = tx(spark, d)
    balanced = S.balance_classes_exact(t, "y2", TX_KEY, seed=42)
    path = FS.write_csv_versioned(balanced, work_path(spark, "balanced"), 1,
                                  dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc))
    return FS.read_csv(spark, path, t.schema)


@register("write_sweep", SWEEP_SQL + f" select {SWEEP_COLS} from m")
def q_write_sweep(spark, d):
    sweep = M.sweep_scores(tx(spark, d), "s", "y")
    path = work_path(spark, "sweep")
    FS.write_sweep(sweep, path)
    return FS.read_csv(spark, path, sweep.schema)


FINGERPRINT_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
ROW_TEXT_SQL = " || ".join(f"case when {c} is null then 'n;' else length({c}::varchar) || ':' || {c}::varchar || ';' end" for c in FINGERPRINT_COLS)


@register("table_fingerprint", f"""
with r as (select {ROW_TEXT_SQL} as r from orders)
select count(*) as rows, sum(({md5_hash_sql('r', seed=0, digits=15)})::hugeint)::varchar as hash_one,
       sum(({md5_hash_sql('r', seed=1, digits=15)})::hugeint)::varchar as hash_two from r""")
def q_table_fingerprint(spark, d):
    return FS.table_fingerprint(table(spark, d, "orders"), FINGERPRINT_COLS)


@register("write_split_overwrite", "with " + TX_SQL + f" select {', '.join(CSV_COLS)} from tx where y2 = 1")
def q_write_split_overwrite(spark, d):
    """A split written over another one holds the new rows only."""
    path = work_path(spark, "split")
    rows = tx(spark, d).select(*CSV_COLS, "y2")
    FS.write_split(rows.where("y2 = 0").select(*CSV_COLS), path)
    FS.write_split(rows.where("y2 = 1").select(*CSV_COLS), path, overwrite=True)
    return FS.scan_parquet(spark, path)


def _write_few_files(spark, rows, key, files, target):
    """``rows`` dealt by the hash of a key to the tasks that write ``files`` large files: as ``repartition(files, key)`` deals them, but each of these
    few tasks reads its share as compressed columns, written by the tasks that read the table, and not as shuffled rows of several times the size."""
    dealt = work_path(spark, "dealt")
    rows.withColumn("_rf_file", F.pmod(F.hash(key), F.lit(files))).write.option("compression", "zstd").partitionBy("_rf_file").parquet(dealt)
    there = [i for i in range(files) if path_exists(spark, f"{dealt}/_rf_file={i}")]
    if not there:
        rows.write.parquet(target)
        return
    folders = [target, *[f"{dealt}/file-{i}" for i in there[1:]]]

    def write(share):
        spark.read.schema(rows.schema).parquet(f"{dealt}/_rf_file={share[0]}").coalesce(1).write.parquet(share[1])

    with ThreadPoolExecutor(max_workers=files) as pool:
        list(pool.map(write, zip(there, folders, strict=True)))
    for i, folder in enumerate(folders[1:]):
        move_file(spark, folder, target, "part-*.parquet", f"part-share-{i}.parquet")


@register("file_tree_hash", "select count(*) as rows, 4::bigint as files, true as same_in_other_splits, true as copies_agree, true as others_differ from lineitem")
def q_file_tree_hash(spark, d):
    """Tree hashes of a table's Parquet files: read in small splits as in large ones, of each file as of its copy, all files different."""
    folder = work_path(spark, "hashed")
    rows = table(spark, d, "lineitem")
    _write_few_files(spark, rows, "l_orderkey", 4, f"{folder}/a")
    for i, name in enumerate(sorted(p.rsplit("/", 1)[1] for p in spark.read.parquet(f"{folder}/a").inputFiles())):
        copy_file(spark, f"{folder}/a/{name}", f"{folder}/b/copy-{i}.parquet")
    split, conf = "spark.sql.files.maxPartitionBytes", spark.conf
    before = conf.get(split)
    first = FS.file_tree_hash(spark, f"{folder}/a", "*.parquet")
    try:
        conf.set(split, "64k")
        second = FS.file_tree_hash(spark, f"{folder}/a", "*.parquet")
    finally:
        conf.set(split, before)
    copies = FS.file_tree_hash(spark, f"{folder}/b", "*.parquet").agg(F.sort_array(F.collect_list("tree_hash")).alias("of_copies"))  # four files
    listed = first.withColumnRenamed("tree_hash", "one").join(second.select("path", "tree_hash"), "path", "full_outer").agg(
        F.count(F.lit(1)).alias("files"), F.every(F.coalesce(F.col("one") == F.col("tree_hash"), F.lit(False))).alias("same_in_other_splits"),
        F.sort_array(F.collect_list("one")).alias("of_files"), F.count_distinct("one").alias("different"))
    counted = spark.read.parquet(f"{folder}/b").agg(F.count(F.lit(1)).alias("rows"))
    return counted.crossJoin(listed).crossJoin(copies).select(  # a row each
        "rows", "files", "same_in_other_splits", (F.col("of_files") == F.col("of_copies")).alias("copies_agree"), (F.col("different") == F.col("files")).alias("others_differ"))
