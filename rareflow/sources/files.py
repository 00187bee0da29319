"""File sources and sinks: CSV (inferred or cast), Parquet splits, versioned CSV,
the sweep table, and an order-insensitive table fingerprint."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rareflow.functions.columns import hash60, row_text
from rareflow.session import work_path
from rareflow.spec import check_schema


def scan_csv_inferred(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """CSV with header and inferred types (one extra pass to infer), then the numeric contract."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    if required:
        check_schema(df, list(required), "CSV")
    return df


def scan_csv_cast(spark: SparkSession, path: str, numeric: Sequence[str]) -> DataFrame:
    """CSV read as strings (no inference pass), numeric columns ``try_cast`` to double in one select."""
    df = spark.read.option("header", True).csv(path)
    cols = set(numeric)
    missing = [c for c in numeric if c not in df.columns]
    if missing:
        raise ValueError(f"CSV is missing required columns: {missing}")
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan (pruning and pushdown by Catalyst)."""
    return spark.read.parquet(path)


def write_split(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet write; refuses to replace an existing split unless asked."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_csv_versioned(df: DataFrame, prefix: str, version: int, now: dt.datetime | None = None) -> str:
    """CSV with header to ``<prefix>_v<version>_<yyyymmdd-HHMMSS>.csv``; returns the path."""
    stamp = (now or dt.datetime.now(dt.timezone.utc)).strftime("%Y%m%d-%H%M%S")
    path = f"{prefix}_v{int(version)}_{stamp}.csv"
    df.write.option("header", True).mode("overwrite").csv(path)
    return path


def write_sweep(sweep: DataFrame, path: str) -> None:
    """Sweep as CSV with header, ascending threshold over the files in the order of their names: a
    range-partitioned sort, of which AQE makes one file where the sweep is small."""
    sweep.orderBy("threshold").write.option("header", True).mode("errorifexists").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None, hasher: str = "md5") -> DataFrame:
    """Order-insensitive fingerprint: row count and the sums of two 60-bit hashes of each row, of seeds 0 and 1.

    A row is hashed with the length of every value and a mark for null, so values can't move between columns
    unnoticed; sums are decimals and exact at any size.
    """
    row = row_text(*list(columns or df.columns))
    totals = [F.sum(hash60(row, seed=i, hasher=hasher).cast("decimal(38,0)")).cast("string").alias(n) for i, n in enumerate(("hash_one", "hash_two"))]
    return df.agg(F.count(F.lit(1)).alias("rows"), *totals)


def file_sha256(spark: SparkSession, path: str, glob_filter: str | None = None) -> DataFrame:
    """SHA-256 of each input file (path, length, sha256), computed in the tasks that read them.

    ``binaryFile`` loads one whole file per row (a file must stay below 2 GB; ``file_tree_hash`` has no such limit); many files
    are hashed in parallel, and nothing but the digests reaches the driver.
    """
    reader = spark.read.format("binaryFile")
    if glob_filter:
        reader = reader.option("pathGlobFilter", glob_filter)
    return reader.load(path).select("path", "length", F.sha2(F.col("content"), 256).alias("sha256"))


#: Digests that one node of a file's tree hash is made of.
FAN = 4096


def file_tree_hash(spark: SparkSession, path: str, glob_filter: str | None = None) -> DataFrame:
    """(path, length, tree_hash) of each file below ``path``, of any size, its byte ranges read in parallel.

    A file is taken as pieces that end with a line feed byte; each piece's SHA-256 is a leaf, ``FAN`` consecutive digests make one by hashing them in a row,
    until one is left, and the tree hash is that of the file's length and this digest. Pieces depend on the bytes alone, so the result is
    the same however the file is split among tasks. No file is read whole: a piece ends with the next line feed, which compressed data
    has every few hundred bytes. Files that the name marks as compressed as a whole (``.gz``) are hashed as what they unpack to. Spark's readers pass over empty files, which therefore have no row.
    """
    reader = spark.read.option("lineSep", "\n")
    if glob_filter:
        reader = reader.option("pathGlobFilter", glob_filter)
    meta = lambda c: F.col(f"_metadata.file_{c}")
    pieces = reader.text(path).select(meta("path").alias("path"), meta("size").alias("length"), meta("block_start").alias("block"), F.unhex(F.sha2(F.col("value").cast("binary"), 256)).alias("digest"))
    folder = work_path(spark, "pieces")
    pieces.withColumn("at", F.monotonically_increasing_id()).write.parquet(folder)  # ascends within a block, which one task reads
    pieces = spark.read.parquet(folder)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    of_file = Window.partitionBy("path")
    blocks = pieces.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))  # a row per split
    blocks = blocks.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(of_file).alias("nodes"))
    level = pieces.join(blocks, ["path", "block"]).select("path", "length", "nodes", (F.col("before") + F.col("at") - F.col("first")).alias("rank"), "digest")
    found = None
    while True:
        runs = level.groupBy("path", "length", "nodes", F.expr(f"rank div {FAN}").alias("rank")).agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("run"))
        digest = F.unhex(F.sha2(F.unhex(F.array_join(F.transform("run", lambda r: F.hex(r["digest"])), "")), 256))
        folder = work_path(spark, "pieces")
        runs.select("path", "length", F.expr(f"(nodes + {FAN - 1}) div {FAN}").alias("nodes"), "rank", digest.alias("digest")).write.parquet(folder)
        level = spark.read.parquet(folder)
        top = level.where("nodes = 1").select("path", "length", F.sha2(F.concat(F.col("length").cast("string").cast("binary"), F.lit(":").cast("binary"), "digest"), 256).alias("tree_hash"))
        found, level = top if found is None else found.unionByName(top), level.where("nodes > 1")
        if not level.limit(1).count():
            break
    return found
