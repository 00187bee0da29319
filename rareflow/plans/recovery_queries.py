"""Queries for streams that fail, come late, leave files behind, run side by side, and are accounted for (ev view)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rareflow.plans.event_queries import (SCORED_SQL, STAGED_PARTS, _stream_config, _stream_scored, add_part, ntz, scored_view, stage_ev, staged_input)
from rareflow.plans.model_queries import PUBLISH_RUN, TX_SPLIT_SQL, _splits
from rareflow.plans.registry import register
from rareflow.plans.views import TX_FEATURES, TX_KEY, TX_SQL, ev
from rareflow.session import work_path
from rareflow.streaming import events as E
from rareflow.streaming import recovery as R
from rareflow.streaming import stream as ST


@register("restart_after_crash", SCORED_SQL + " select *, 1 as left_unfinished, 0 as unfinished_at_end from sc")
def q_restart_after_crash(spark, d):
    """A run that fails inside its second batch, whose offsets are logged and whose commit isn't; started again from the checkpoint it
    runs that batch once more, and every event is there once."""
    base, inp = staged_input(spark, d, parts=range(STAGED_PARTS - 1))
    out = f"{base}/out"
    conf = _stream_config(out)
    ST.run_stream(ST.sink_predictions(_stream_scored(spark, inp), out, configuration=conf))
    add_part(spark, base, STAGED_PARTS - 1)
    starts = []

    def start():
        scored = _stream_scored(spark, inp)
        if not starts:  # the marked row fails the first time only
            fails = F.raise_error(F.lit("marked row")).cast("string")
            scored = scored.withColumn("EventId", F.when(F.col("kafka_offset") == STAGED_PARTS - 1, fails).otherwise(F.col("EventId")))
        starts.append(1)
        return ST.sink_predictions(scored, out, configuration=conf)

    crashed, resumed = R.run_recovering(start, spark, f"{out}/checkpoint", attempts=2)
    if "marked row" not in (crashed.error or "") or resumed.error is not None:
        raise RuntimeError("the first attempt should fail, and the second should not")
    rows = scored_view(ST.read_predictions(spark, out, ST.prediction_schema(["value"])))
    return rows.withColumns({"left_unfinished": F.lit(len(crashed.unfinished)), "unfinished_at_end": F.lit(len(R.unfinished(spark, f"{out}/checkpoint")))})


#: Input of the append-mode windows: the first half by time, the second half, and last every 50th event, whatever its time.
HALF, LATE_EVERY, DELAY, WINDOW = "2024-01-16 00:00:00", 50, "2 hours", "1 hour"


@register("throughput_windows_append", f"""
with e as (select ts, time_bucket(interval '1 hour', ts) as w, case when event_id % {LATE_EVERY} = 7 then 2 when ts < '{HALF}' then 0 else 1 end as stage from events),
m as (select max(ts) filter (where stage = 0) - interval '{DELAY}' as first, max(ts) filter (where stage < 2) - interval '{DELAY}' as second, max(ts) - interval '{DELAY}' as third from e),
k as (select e.*, w + interval '1 hour' as window_end,
        case when (stage = 1 and w + interval '1 hour' <= first) or (stage = 2 and w + interval '1 hour' <= second) then 'late'
             when w + interval '1 hour' <= third then 'closed' else 'open' end as state from e, m)
select w as window_start, window_end, state, count(*) as n from k group by 1, 2, 3""")
def q_throughput_windows_append(spark, d):
    """Hourly windows with a watermark of two hours over input fed in three stages, the last full of rows that come too late: what was
    written once closed, what is still open, and what was late."""
    base, late, time = work_path(spark, "ev-late"), F.pmod("offset", F.lit(LATE_EVERY)) == 7, F.col("timestamp").cast("timestamp_ntz")
    stage = F.when(late, 2).when(time < F.lit(HALF).cast("timestamp_ntz"), 0).otherwise(1)
    ev(spark, d).withColumn("_f", stage).write.partitionBy("_f").parquet(f"{base}/staged")
    for part in range(3):
        if ST.path_exists(spark, f"{base}/staged/_f={part}"):
            add_part(spark, base, part)
            windows = ST.throughput_windows(ST.file_source(spark, f"{base}/input"), "timestamp", WINDOW, watermark=DELAY)
            ST.run_stream(R.sink_windows(windows, f"{base}/out"))
    account = R.window_account(spark, f"{base}/out", f"{base}/input", "timestamp", WINDOW)
    return account.select(ntz("window_start"), ntz("window_end"), "state", "n")


@register("batch_metrics", SCORED_SQL + f"""
select kafka_offset % {STAGED_PARTS} as batch_id, count(*) as input_rows, count(*) as rows, count(*) filter (where status = 'scored') as scored,
       count(*) filter (where status = 'rejected') as rejected, count(*) filter (where final_prediction = 1) as alerts, count(*) as written_rows,
       count(*) filter (where status = 'scored') as written_scored, count(*) filter (where status = 'rejected') as written_rejected,
       count(*) filter (where final_prediction = 1) as written_alerts
from sc group by 1""")
def q_batch_metrics(spark, d):
    """A batch for each part of the input: what was observed as it streamed, beside what is committed for it."""
    base = stage_ev(spark, d)
    out = f"{base}/out"
    with ST.recording(spark, queries=STAGED_PARTS) as seen:
        for part in range(STAGED_PARTS):
            add_part(spark, base, part)
            ST.run_stream(ST.sink_predictions(R.observing(_stream_scored(spark, f"{base}/input")), out))
    written = R.written_metrics(ST.read_predictions(spark, out, ST.prediction_schema(["value"])), f"{out}/checkpoint")
    written = written.select("batch_id", *[F.col(c).alias(f"written_{c}") for c in ("rows", "scored", "rejected", "alerts")])
    return R.batch_metrics(spark, seen.events).join(written, "batch_id", "full_outer")


@register("read_predictions_committed", SCORED_SQL + f"""
select status, count(*) as n, count(*) + count(*) filter (where kafka_offset % {STAGED_PARTS} = 0) as n_by_pattern, 2::bigint as stray_files from sc group by status""")
def q_read_predictions_committed(spark, d):
    """Predictions in a folder that also holds two entries no batch committed, a copy of a quarter of the rows (part files of the tasks that
    wrote them, in a folder of that name: no task sees all copies) and a file that breaks off in its first line: the folder gives committed
    rows only, a file pattern gives the copies too."""
    base, inp = staged_input(spark, d)
    out, schema = f"{base}/out", ST.prediction_schema(["value"])
    ST.run_stream(ST.sink_predictions(_stream_scored(spark, inp), out))
    rows = ST.read_predictions(spark, out, schema)
    rows.where(F.pmod("kafka_offset", F.lit(STAGED_PARTS)) == 0).write.option("ignoreNullFields", "false").json(f"{base}/copy")
    spark.createDataFrame([('{"EventId":"driv',)], "value string").coalesce(1).write.option("lineSep", " ").text(f"{base}/broken")
    ST.move(spark, f"{base}/copy", f"{out}/predictions/stray-copy.json")
    ST.move_file(spark, f"{base}/broken", f"{out}/predictions", "part-*.txt", "stray-broken.json")
    every = spark.read.schema(schema).json(f"{out}/predictions/*.json")
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")).join(
        every.groupBy("status").agg(F.count(F.lit(1)).alias("n_by_pattern")), "status").withColumn("stray_files", F.lit(R.stray_entries(spark, out).count()).cast("long"))


@register("topic_streams", SCORED_SQL + " select * from sc")
def q_topic_streams(spark, d):
    """A stream for each topic, side by side, with a checkpoint and a scheduler pool each; their results together."""
    base = work_path(spark, "ev-topics")
    ev(spark, d).withColumn("_t", F.col("topic")).write.partitionBy("_t").parquet(f"{base}/input")
    topics = [r[0] for r in spark.read.parquet(f"{base}/input").select("_t").distinct().orderBy("_t").collect()]  # one per stream to start

    def start(topic):
        return lambda: ST.sink_predictions(_stream_scored(spark, f"{base}/input/_t={topic}"), f"{base}/out/{topic}")

    failed = {t: e for t, e in R.run_side_by_side(spark, {t: start(t) for t in topics}).items() if e}
    if failed:
        raise RuntimeError(f"streams failed: {failed}")
    schema, out = ST.prediction_schema(["value"]), None
    for topic in topics:
        rows = ST.read_predictions(spark, f"{base}/out/{topic}", schema)
        out = rows if out is None else out.unionByName(rows)
    return scored_view(out if out is not None else spark.createDataFrame([], schema))


@register("delivery_accounting", "with " + TX_SQL + f"""
select count(*) as records, count(*) filter (where (l_orderkey + l_linenumber) % 3 <> 0) as sent, count(*) as delivered, count(*) as distinct_keys, 0::bigint as missing, 2 as attempts,
       0::bigint as sent_again
from tx where {TX_SPLIT_SQL} = 'test'""")
def q_delivery_accounting(spark, d):
    """Events delivered to a folder by a sink whose first attempt breaks off after a third of the rows: the second sends the rest, a repeated
    delivery sends nothing, and each event is there once."""
    _, _, test = _splits(spark, d)
    key, target = F.concat_ws(":", *TX_KEY), work_path(spark, "delivered")
    records = E.build_events(test.withColumn("index", key), TX_FEATURES, "y2", "index", run_id=PUBLISH_RUN, ingestion_rate=20.0, event_time=F.lit(0.0),
                             offset=F.col("l_orderkey") + F.col("l_linenumber"))
    attempts = []

    def write(frame):
        attempts.append(1)
        (frame.where("offset % 3 = 0") if len(attempts) == 1 else frame).write.mode("append").parquet(target)
        if len(attempts) == 1:
            raise OSError("the connection broke off")

    def delivered():
        return spark.read.schema(records.schema).parquet(target) if ST.path_exists(spark, target) else spark.createDataFrame([], records.schema)

    first, again = R.deliver(records, write, delivered), R.deliver(records, write, delivered)
    return spark.createDataFrame([(first.records, first.sent, first.delivered, first.distinct, first.missing, first.attempts, again.sent)],
                                 "records long, sent long, delivered long, distinct_keys long, missing long, attempts int, sent_again long")
