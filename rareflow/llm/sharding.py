"""Shards by fixed virtual slots: records hash into thousands of slots, and a versioned map sends slots to shards.

The hash and the number of slots never change, so a record keeps its slot for good. The map starts as slot modulo
shards and is only edited: bytes are summed per slot, every shard keeps its larger slots up to an even share, and the
slots beyond that go, largest first, to the shard that is lightest just then. An edit is stored as the next version
beside the earlier ones. Everything is DataFrame functions; the greedy choice is a fold over one row that holds the
slots in an array (as long as the fixed number of slots, whatever the input).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rareflow.llm.common import crc
from rareflow.session import work_path
from rareflow.streaming.stream import path_exists

SLOTS = 4096
#: Bytes that a record counts for besides its text.
RECORD_BYTES = 16
#: Rows that are numbered together, on average.
RANK_ROWS = 1 << 19


def virtual_slot(key: list[Column], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: (version, v_slot, shard), slots dealt out in turn."""
    if not 0 < shards <= slots:
        raise ValueError("there must be a slot at least for each shard")
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("v_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(old: DataFrame, slot_bytes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for ``shards`` shards, given (v_slot, bytes).

    A shard keeps its largest slots, as many as fit an even share of all bytes; the smaller ones beyond it, and what
    belongs to shards that no longer exist, move. Small slots fill the shares evenly, so loads end about a small
    slot apart. Slots without bytes stay unless their shard is gone; null bytes count as none.
    """
    sized = old.join(slot_bytes, "v_slot", "left").select(
        "version", "v_slot", F.when(F.col("shard") < shards, F.col("shard")).alias("shard"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy())  # a row per slot
    within = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "v_slot").rowsBetween(Window.unboundedPreceding, 0))
    marked = sized.withColumn("stays", F.col("shard").isNotNull() & ((within * shards <= total) | (F.col("bytes") == 0)))
    load = [F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == i), F.col("bytes"))), F.lit(0)) for i in range(shards)]
    mover = F.when(~F.col("stays"), F.struct("bytes", F.negate("v_slot").alias("order"), "v_slot"))
    state = marked.groupBy().agg(F.array(*load).alias("loads"), F.reverse(F.array_sort(F.collect_list(mover))).alias("movers"))
    start = F.struct(F.col("loads"), F.array().cast("array<struct<v_slot:int,shard:int>>").alias("sent"))

    def place(state: Column, mover: Column) -> Column:
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(F.transform(state["loads"], lambda x, i: x + F.when(i == lightest, mover["bytes"]).otherwise(F.lit(0))).alias("loads"),
                        F.concat(state["sent"], F.array(F.struct(mover["v_slot"].alias("v_slot"), lightest.alias("shard")))).alias("sent"))

    sent = state.select(F.explode(F.aggregate("movers", start, place, lambda s: s["sent"])).alias("m"))
    sent = sent.select(F.col("m.v_slot").alias("v_slot"), F.col("m.shard").alias("to"))
    return marked.join(sent, "v_slot", "left").select((F.col("version") + 1).alias("version"), "v_slot", F.coalesce("to", "shard").alias("shard"))


def store_map(new: DataFrame, folder: str) -> DataFrame:
    """Append a version to the map's folder, a subfolder for each version; returns it as read back. A version that is there is never replaced, unless
    its write broke off. A map has a row per virtual slot, so it is never empty."""
    spark = new.sparkSession
    version = new.select("version").first()[0]
    path = f"{folder.rstrip('/')}/version={version}"
    if path_exists(spark, path) and not path_exists(spark, f"{path}/_SUCCESS"):
        new.drop("version").write.mode("overwrite").parquet(path)
    else:
        new.drop("version").write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path).withColumn("version", F.lit(version))


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of the map, (v_slot, shard, version), the latest whole one unless named; one that isn't there has no rows."""
    table = spark.read.schema("v_slot int, shard int, version int").option("basePath", folder).parquet(folder)
    version = version if version is not None else table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def shard(docs: DataFrame, shards: int, slots: int = SLOTS, folder: str | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, v_slot, shard, slot, version): every row in a shard, shards near equal in bytes,
    ``slot`` a gapless number from 0 within the shard.

    With a ``folder`` that holds a map, its latest version is edited for these rows and this number of shards and stored as the next one, so that
    little moves; a folder without one begins with version 1, which is edited at once. The number of virtual slots is that of the stored map.

    A record's virtual slot comes from a hash of its id and text, so that neither a null id nor a much repeated
    text fills one slot; rows equal in both are indistinguishable and share one. A null text counts no bytes. Places
    are numbered in parallel by the hash order: a shard's rows are split over its virtual slots, and those again where
    the table is large. An empty table gives no rows; its map is stored all the same.
    """
    spark = docs.sparkSession
    folder = (folder or work_path(spark, "shard-map")).rstrip("/")
    if not path_exists(spark, f"{folder}/map"):
        store_map(first_map(spark, shards, slots), f"{folder}/map")
    stored = load_map(spark, f"{folder}/map")
    about = stored.agg(F.max("version").alias("version"), F.count("*").alias("slots")).first()
    slots = about["slots"]
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"),
                       (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"),
                       F.coalesce(crc(text), F.lit(0)).alias("text_crc32"))
    rows = rows.withColumn("v_slot", virtual_slot([F.col("doc_id"), F.col("text_crc32")], slots))
    sums = rows.groupBy("v_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    path = f"{folder}/sums/version={about['version'] + 1}"
    sums.write.mode("overwrite").parquet(path)  # at most a row per slot; again, if an edit broke off
    sums = spark.read.parquet(path)
    version = store_map(rebalanced(stored, sums, shards), f"{folder}/map")
    total = sums.agg(F.sum("n")).first()[0] or 0
    parts = int(total // (slots * RANK_ROWS) + 1)
    rows = rows.withColumn("part", F.pmod(F.hash("doc_id", "text_crc32"), F.lit(parts)))
    mapped = rows.join(F.broadcast(version), "v_slot")  # as many rows as slots
    if parts > 1:
        counts = mapped.groupBy("shard", "v_slot", "part").agg(F.count("*").alias("n"))
    else:
        counts = version.join(sums, "v_slot").select("shard", "v_slot", F.lit(0).alias("part"), "n")
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("v_slot", "part")) - F.col("n"))
    own = F.row_number().over(Window.partitionBy("v_slot", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return mapped.withColumn("own", own).join(base.drop("shard", "n"), ["v_slot", "part"]).select(
        "doc_id", "size", "text_crc32", "v_slot", "shard", (F.col("base") + F.col("own")).alias("slot"), "version")
