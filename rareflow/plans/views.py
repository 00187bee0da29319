"""Standard inputs derived from the driver tables, each with its SQL twin.

``tx``: ``lineitem`` as a labelled transaction table. Features
``l_quantity, l_extendedprice, l_discount, l_tax``; ``y`` = returned (noisy
label), ``y2`` = large discounted quantity (learnable, rare); ``s`` = a
deterministic score in [0.01, 1]. The row key is all four of order, line,
part and supplier (order and line alone repeat).

``ev``: ``events`` in the shape of Kafka records: ``value`` = JSON payload,
``topic`` = event type, ``partition`` = event id mod 2, ``offset`` = event id.
Bad values are injected by expression so the validity paths are exercised on
every row class: every row is still read and processed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rareflow.spec import FeatureSpec

TX_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
TX_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
TX_SPEC = FeatureSpec(TX_FEATURES, "y", TX_KEY)
TX_SPEC2 = FeatureSpec(TX_FEATURES, "y2", TX_KEY)
EV_FEATURES = ("value", "user_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from rareflow.sources.files import scan_parquet

    return scan_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def tx_score() -> F.Column:
    return (F.col("l_quantity") / F.lit(50) + F.col("l_discount") * F.lit(10)) / F.lit(2)


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        *TX_KEY, *TX_FEATURES,
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        F.when((F.col("l_quantity") > 40) & (F.col("l_discount") >= 0.08), 1).otherwise(0).alias("y2"),
        tx_score().alias("s"))


TX_SQL = """tx as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey,
         l_quantity, l_extendedprice, l_discount, l_tax,
         case when l_returnflag = 'R' then 1 else 0 end as y,
         case when l_quantity > 40 and l_discount >= 0.08 then 1 else 0 end as y2,
         (l_quantity / 50 + l_discount * 10) / 2 as s
  from lineitem)"""


def tx_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx with injected bad values: null, NaN, +inf, -inf features, and label 2."""
    t = tx(spark, sf_dir)
    k = F.col("l_orderkey") + F.col("l_linenumber")
    return t.select(
        *TX_KEY,
        F.when(k % 97 == 0, F.lit(None).cast("double")).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(k % 101 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(k % 103 == 0, F.lit(float("inf"))).when(k % 107 == 0, F.lit(float("-inf")))
        .otherwise(F.col("l_discount")).alias("l_discount"),
        "l_tax",
        F.when(k % 109 == 0, F.lit(2)).otherwise(F.col("y")).alias("y"),
        "y2", "s")


TX_DIRTY_SQL = TX_SQL + """,
txd as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey,
         case when (l_orderkey + l_linenumber) % 97 = 0 then null else l_quantity end as l_quantity,
         case when (l_orderkey + l_linenumber) % 101 = 0 then 'nan'::double else l_extendedprice end as l_extendedprice,
         case when (l_orderkey + l_linenumber) % 103 = 0 then 'inf'::double
              when (l_orderkey + l_linenumber) % 107 = 0 then '-inf'::double
              else l_discount end as l_discount,
         l_tax,
         case when (l_orderkey + l_linenumber) % 109 = 0 then 2 else y end as y,
         y2, s
  from tx)"""


def tx_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx with missing values only (null and NaN): what cleaning drops."""
    t = tx(spark, sf_dir)
    k = F.col("l_orderkey") + F.col("l_linenumber")
    return t.select(
        *TX_KEY,
        F.when(k % 97 == 0, F.lit(None).cast("double")).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(k % 101 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount", "l_tax", "y", "y2", "s")


TX_MISSING_SQL = TX_SQL + """,
txm as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey,
         case when (l_orderkey + l_linenumber) % 97 = 0 then null else l_quantity end as l_quantity,
         case when (l_orderkey + l_linenumber) % 101 = 0 then 'nan'::double else l_extendedprice end as l_extendedprice,
         l_discount, l_tax, y, y2, s
  from tx)"""

ORDERS_LABEL = "urgent"


def orders_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with a 0/1 label (urgent priority, about 20 %)."""
    o = table(spark, sf_dir, "orders")
    return o.withColumn(ORDERS_LABEL, F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0))


ORDERS_SQL = """ol as (select *, case when o_orderpriority = '1-URGENT' then 1 else 0 end as urgent from orders)"""


# --- ev: events as Kafka records --------------------------------------------------

EV_RUN_ID = "driver-events"
EV_RATE = 5.0
EV_SCORE = "value / (value + 100.0)"
MALFORMED = "{malformed json"


def ev_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with injected bad values, before encoding."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    value = (F.when(i % 97 == 0, F.lit(None).cast("double")).when(i % 101 == 0, F.lit(float("nan")))
             .when(i % 103 == 0, F.lit(float("inf"))).otherwise(F.col("value")))
    eid = F.when(i % 83 == 0, F.lit("  ")).otherwise(F.concat(F.lit(f"{EV_RUN_ID}:"), i.cast("string")))
    return e.select("event_id", "ts", "event_type", value.alias("value"), "user_id",
                    F.when(F.col("value") >= 150, 1.0).otherwise(0.0).alias("Class"), eid.alias("eid"))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kafka-shaped events: key, value (JSON), topic, partition, offset, timestamp."""
    from rareflow.streaming.events import build_events, epoch_seconds

    i = F.col("event_id")
    rec = build_events(ev_frame(spark, sf_dir), EV_FEATURES, "Class", "event_id", run_id=EV_RUN_ID,
                       ingestion_rate=EV_RATE, event_time=epoch_seconds("ts"), event_id=F.col("eid"),
                       topic=F.col("event_type"), partition=i % 2, offset=i, timestamp=F.col("ts"), check=False)
    return rec.withColumn("value", F.when(F.col("offset") % 89 == 0, F.lit(MALFORMED).cast("binary"))
                          .otherwise(F.col("value")))


EV_SQL = f"""e0 as (
  select event_id, ts, event_type, user_id,
         event_id % 89 = 0 as malformed,
         case when event_id % 97 = 0 then null when event_id % 101 = 0 then 'nan'::double
              when event_id % 103 = 0 then 'inf'::double else value end as v,
         case when event_id % 83 = 0 then '  ' else '{EV_RUN_ID}:' || event_id::varchar end as eid,
         case when value >= 150 then 1.0 else 0.0 end::double as cls
  from events),
pe as (
  select event_type as kafka_topic, (event_id % 2)::int as kafka_partition, event_id as kafka_offset,
         ts as kafka_timestamp, eid as key_text,
         case when not malformed then v end as value,
         case when not malformed then user_id::double end as user_id,
         case when not malformed then cls end as Class,
         case when not malformed then eid end as EventId,
         case when not malformed then '{EV_RUN_ID}' end as ProducerRunId,
         case when not malformed then epoch_us(ts)::double / 1000000.0::double end as EventTimestamp,
         case when not malformed then {EV_RATE}::double end as IngestionRate,
         case when malformed then '{MALFORMED}' end as _corrupt_record,
         coalesce(not malformed and length(trim(eid)) > 0 and v is not null and not isnan(v) and not isinf(v)
                  and epoch_us(ts) > 0, false) as valid_event
  from e0)"""
