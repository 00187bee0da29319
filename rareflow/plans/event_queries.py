"""Queries for the event envelope, parsing, validity, scoring and stream runs (ev view)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rareflow.operators.model import ExpressionScorer
from rareflow.plans.registry import register
from rareflow.plans.views import EV_FEATURES, EV_SCORE, EV_SQL, ev, table
from rareflow.session import work_path
from rareflow.streaming import events as E
from rareflow.streaming import stream as ST

THRESHOLD = 0.6
SCORER = ExpressionScorer(EV_SCORE, uid="value-ratio")
PARSED_COLS = ["kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp", "value", "user_id", "Class",
               "EventId", "ProducerRunId", "EventTimestamp", "IngestionRate", "_corrupt_record", "valid_event"]
# Fixed processing time used by the response-time queries.
PROCESSING_TIME = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
PROCESSING_EPOCH = int(PROCESSING_TIME.timestamp())


def ntz(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


def _parsed(spark, d):
    return E.parse_events(ev(spark, d), EV_FEATURES)


def _scored(spark, d):
    return E.score_events(_parsed(spark, d), SCORER, EV_FEATURES, THRESHOLD, keep=["value"])


SCORED_OUT = ["EventId", "ProducerRunId", "EventTimestamp", "IngestionRate", "Class", "value", "kafka_topic",
              "kafka_partition", "kafka_offset", "kafka_timestamp", "fraud_probability", "final_prediction",
              "status", "error", "has_raw_json", "ModelUID", "Threshold"]


def scored_view(df):
    """Prediction records without the batch start time (wall clock) and with raw text as a flag."""
    return df.select(*[ntz(c) if c == "kafka_timestamp" else
                       (F.col("raw_json").isNotNull().alias(c) if c == "has_raw_json" else F.col(c))
                       for c in SCORED_OUT])


SCORED_SQL = "with " + EV_SQL + f""",
sc as (
  select EventId, ProducerRunId, EventTimestamp, IngestionRate, Class, value, kafka_topic, kafka_partition,
         kafka_offset, kafka_timestamp,
         case when valid_event then value / (value + 100.0) end as fraud_probability,
         case when valid_event then (value / (value + 100.0) >= {THRESHOLD})::int end as final_prediction,
         case when valid_event then 'scored' else 'rejected' end as status,
         case when not valid_event then '{E.REJECT_REASON}' end as error,
         not valid_event as has_raw_json,
         'value-ratio' as ModelUID, {THRESHOLD}::double as Threshold
  from pe)"""


@register("build_events", "with " + EV_SQL + """
select key_text, kafka_topic as topic,
       kafka_partition as partition, kafka_offset as "offset", kafka_timestamp as timestamp,
       value, Class, EventId
from pe""")
def q_build_events(spark, d):
    rec = ev(spark, d)
    back = F.from_json(F.col("value").cast("string"), E.event_schema(EV_FEATURES))
    return rec.select(F.col("key").cast("string").alias("key_text"),
                      "topic", "partition", "offset", ntz("timestamp"),
                      back["value"].alias("value"), back["Class"].alias("Class"), back["EventId"].alias("EventId"))


@register("parse_events", "with " + EV_SQL + f" select {', '.join(PARSED_COLS)} from pe")
def q_parse_events(spark, d):
    return _parsed(spark, d).select(*[ntz(c) if c == "kafka_timestamp" else c for c in PARSED_COLS])


@register("event_validity", "with " + EV_SQL + " select kafka_offset, valid_event from pe")
def q_event_validity(spark, d):
    return _parsed(spark, d).select("kafka_offset", "valid_event")


@register("sanitize_invalid", "with " + EV_SQL + """
select kafka_offset, valid_event,
       case when valid_event then value else 0.0 end as value,
       case when valid_event then user_id else 0.0 end as user_id,
       value as original_value
from pe""")
def q_sanitize_invalid(spark, d):
    return E.sanitize_invalid(_parsed(spark, d), EV_FEATURES, keep=["value"]) \
        .select("kafka_offset", "valid_event", "value", "user_id", "original_value")


@register("score_events", SCORED_SQL + " select * from sc")
def q_score_events(spark, d):
    return scored_view(_scored(spark, d))


@register("fraud_alerts", SCORED_SQL + " select EventId, kafka_offset, fraud_probability from sc where final_prediction = 1")
def q_fraud_alerts(spark, d):
    return E.fraud_alerts(_scored(spark, d)).select("EventId", "kafka_offset", "fraud_probability")


@register("status_counts", SCORED_SQL + " select status, count(*) as n from sc group by status")
def q_status_counts(spark, d):
    return E.status_counts(_scored(spark, d))


@register("duplicate_offsets", SCORED_SQL + """
select count(*) as rows, count(distinct (kafka_topic, kafka_partition, kafka_offset)) as distinct_offsets,
       count(*) - count(distinct (kafka_topic, kafka_partition, kafka_offset)) as duplicate_rows
from sc""")
def q_duplicate_offsets(spark, d):
    return E.duplicate_offsets(_scored(spark, d))


@register("response_time", SCORED_SQL + f"""
select EventId, kafka_offset, {PROCESSING_EPOCH}::double - EventTimestamp as response_time
from sc where status = 'scored'""")
def q_response_time(spark, d):
    s = _scored(spark, d).filter(F.col("status") == "scored")
    return E.response_time(s, processing_time=F.lit(PROCESSING_TIME)) \
        .select("EventId", "kafka_offset", "response_time")


@register("response_time_stats", SCORED_SQL + f"""
select count(*) as rows, round(avg({PROCESSING_EPOCH}::double - EventTimestamp), 6) as avg_response_time
from sc where status = 'scored'""")
def q_response_time_stats(spark, d):
    """Running count and mean response time over the scored stream (complete mode)."""
    base, inp = staged_input(spark, d)
    scored = _stream_scored(spark, inp).filter(F.col("status") == "scored")
    stats = E.response_time_stats(E.response_time(scored, processing_time=F.lit(PROCESSING_TIME)))
    res = _complete(spark, stats, base)
    return res.select("rows", F.round("avg_response_time", 6).alias("avg_response_time"))


@register("json_event_functions", """
select event_id, json_extract(props, '$.k')::int as k, length(props)::int as props_len,
       trim('  ' || event_type || '  ') as trimmed_type, length(event_type)::int as type_len,
       to_json({'event_id': event_id, 'k': json_extract(props, '$.k')::int})::varchar as json_out,
       event_id::double as event_id_double
from events""")
def q_json_event_functions(spark, d):
    e = table(spark, d, "events")
    k = F.from_json("props", "k int")["k"]
    return e.select("event_id", k.alias("k"), F.length("props").alias("props_len"),
                    F.trim(F.concat(F.lit("  "), "event_type", F.lit("  "))).alias("trimmed_type"),
                    F.length("event_type").alias("type_len"),
                    F.to_json(F.struct(F.col("event_id"), k.alias("k"))).alias("json_out"),
                    F.col("event_id").cast("double").alias("event_id_double"))


# --- stream runs --------------------------------------------------------------------

STAGED_PARTS = 4


def stage_ev(spark, d) -> str:
    """Materialise the Kafka-shaped events once in the shared work folder, split into
    ``STAGED_PARTS`` parts by offset (every task writes its own files; no funnel).
    Returns the base folder; the stream input is ``<base>/input``, fed part by part."""
    base = work_path(spark, "ev-source")
    ev(spark, d).withColumn("_f", F.pmod(F.col("offset"), F.lit(STAGED_PARTS))) \
        .write.partitionBy("_f").parquet(f"{base}/staged")
    return base


def add_part(spark, base: str, part: int) -> None:
    """Move one staged part into the stream's input folder (new files for the next run, not written again)."""
    ST.move(spark, f"{base}/staged/_f={part}", f"{base}/input/_f={part}")


def staged_input(spark, d, parts=range(STAGED_PARTS)) -> tuple[str, str]:
    base = stage_ev(spark, d)
    for p in parts:
        add_part(spark, base, p)
    return base, f"{base}/input"


def _stream_scored(spark, src_dir, max_files=None):
    src = ST.file_source(spark, src_dir, max_files_per_trigger=max_files, fmt="parquet")
    return E.score_events(E.parse_events(src, EV_FEATURES), SCORER, EV_FEATURES, THRESHOLD, keep=["value"])


def _stream_config(out):
    return {"schema_version": 1, "source": "ev", "model_uid": SCORER.uid, "threshold": THRESHOLD,
            "feature_columns": list(EV_FEATURES), "output_dir": out}


@register("run_stream", SCORED_SQL + " select * from sc")
def q_run_stream(spark, d):
    base, inp = staged_input(spark, d)
    out = f"{base}/out"
    q = ST.sink_predictions(_stream_scored(spark, inp), out, available_now=False,
                            trigger_seconds=0.5)
    ST.run_stream(q, drain=True)  # processing-time trigger: drain what is there, then stop
    return scored_view(ST.read_predictions(spark, out, ST.prediction_schema(["value"])))


@register("sink_predictions", SCORED_SQL + " select * from sc")
def q_sink_predictions(spark, d):
    base, inp = staged_input(spark, d)
    out = f"{base}/out"
    ST.run_stream(ST.sink_predictions(_stream_scored(spark, inp), out, configuration=_stream_config(out)))
    return scored_view(ST.read_predictions(spark, out, ST.prediction_schema(["value"])))


@register("read_predictions", SCORED_SQL + " select status, count(*) as n from sc group by status")
def q_read_predictions(spark, d):
    base, inp = staged_input(spark, d)
    out = f"{base}/out"
    ST.run_stream(ST.sink_predictions(_stream_scored(spark, inp), out))
    return E.status_counts(ST.read_predictions(spark, out, ST.prediction_schema(["value"])))


@register("restart_idempotence", SCORED_SQL + " select * from sc")
def q_restart_idempotence(spark, d):
    """Run, restart with no new input (adds nothing), add input, restart (adds only it)."""
    base, inp = staged_input(spark, d, parts=range(STAGED_PARTS - 1))
    out = f"{base}/out"
    conf = _stream_config(out)
    ST.run_stream(ST.sink_predictions(_stream_scored(spark, inp), out, configuration=conf))
    first = ST.read_predictions(spark, out).count()
    ST.run_stream(ST.sink_predictions(_stream_scored(spark, inp), out, configuration=conf))
    if ST.read_predictions(spark, out).count() != first:
        raise RuntimeError("restart without new input changed the output")
    add_part(spark, base, STAGED_PARTS - 1)
    ST.run_stream(ST.sink_predictions(_stream_scored(spark, inp), out, configuration=conf))
    return scored_view(ST.read_predictions(spark, out, ST.prediction_schema(["value"])))


@register("batch_progress", "select count(*)::bigint as input_rows from events")
def q_batch_progress(spark, d):
    """Input rows summed over the reports of all micro-batches of a run with a small input cap."""
    base, inp = staged_input(spark, d)
    with ST.recording(spark) as seen:
        ST.run_stream(ST.sink_predictions(_stream_scored(spark, inp, max_files=2), f"{base}/out"))
    per_batch = ST.batch_progress(spark, seen.events)
    if len(seen.events) < 2:
        raise RuntimeError("expected several micro-batches with a cap on files")
    return per_batch.agg(F.sum("input_rows").cast("bigint").alias("input_rows"))


@register("batch_timestamp", "select count(*)::bigint as rows, 0::bigint as without_timestamp, true as one_per_batch from events")
def q_batch_timestamp(spark, d):
    """Every prediction has its micro-batch's start, the same for all rows of a batch."""
    base, inp = staged_input(spark, d)
    with ST.recording(spark) as seen:
        ST.run_stream(ST.sink_predictions(_stream_scored(spark, inp, max_files=2), f"{base}/out"))
    rows = ST.read_predictions(spark, f"{base}/out", ST.prediction_schema(["value"]))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("BatchTimestamp").isNull()).alias("without_timestamp"),
                    (F.count_distinct("BatchTimestamp") == len(seen.events)).alias("one_per_batch"))


@register("processing_time_windows", "select count(*)::bigint as rows, true as aligned, true as recent from events")
def q_processing_time_windows(spark, d):
    """Throughput by arrival: the windows count every event once, are an hour long, and lie in the last day."""
    base, inp = staged_input(spark, d)
    res = _complete(spark, ST.processing_time_windows(ST.file_source(spark, inp), "1 hour"), base)
    hour = F.col("window_end") - F.col("window_start") == F.expr("interval 1 hour")
    near = F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.col("window_start").cast("timestamp"))) < 86400
    return res.agg(F.sum("n").cast("bigint").alias("rows"), F.every(hour).alias("aligned"), F.every(near).alias("recent"))


def _complete(spark, agg, base):
    """Run a complete-mode aggregate to a Parquet table in the work folder and read it back."""
    ST.run_stream(ST.sink_complete(agg, f"{base}/result", f"{base}/result-checkpoint"))
    return ST.read_complete(spark, f"{base}/result")


@register("throughput_windows", """
select time_bucket(interval '1 hour', ts) as window_start, time_bucket(interval '1 hour', ts) + interval '1 hour' as window_end,
       count(*) as n
from events group by 1, 2""")
def q_throughput_windows(spark, d):
    base, inp = staged_input(spark, d)
    src = ST.file_source(spark, inp)
    res = _complete(spark, ST.throughput_windows(src, "timestamp", "1 hour"), base)
    return res.select(ntz("window_start"), ntz("window_end"), "n")


@register("multi_topic_throughput", """
select time_bucket(interval '1 hour', ts) as window_start, time_bucket(interval '1 hour', ts) + interval '1 hour' as window_end,
       event_type as topic, count(*) as n
from events group by 1, 2, 3""")
def q_multi_topic_throughput(spark, d):
    base, inp = staged_input(spark, d)
    src = ST.file_source(spark, inp)
    res = _complete(spark, ST.throughput_windows(src, "timestamp", "1 hour", by=["topic"]), base)
    return res.select(ntz("window_start"), ntz("window_end"), "topic", "n")


@register("score_parity", "with " + EV_SQL + """
select count(*) filter (where valid_event) as matched, 0::bigint as only_offline, 0::bigint as only_online,
       0::bigint as score_mismatches, 0::bigint as decision_mismatches
from pe""")
def q_score_parity(spark, d):
    """Streamed scores (sink, read back) against batch scores of the same events, by EventId."""
    base, inp = staged_input(spark, d)
    out = f"{base}/out"
    ST.run_stream(ST.sink_predictions(_stream_scored(spark, inp), out))
    online = ST.read_predictions(spark, out, ST.prediction_schema(["value"])).filter(F.col("status") == "scored")
    offline = _scored(spark, d).filter(F.col("status") == "scored")
    return E.score_parity(offline, online)


@register("sink_alerts", SCORED_SQL + """
select EventId as key_text, EventId, fraud_probability, final_prediction, kafka_offset
from sc where final_prediction = 1""")
def q_sink_alerts(spark, d):
    """Alert records (key = event id, value = whole prediction row as JSON) as the Kafka sink writes them."""
    rec = E.alert_records(E.fraud_alerts(_scored(spark, d)))
    back = F.from_json(F.col("value").cast("string"),
                       "EventId string, fraud_probability double, final_prediction int, kafka_offset bigint")
    return rec.select(F.col("key").cast("string").alias("key_text"), back["EventId"].alias("EventId"),
                      back["fraud_probability"].alias("fraud_probability"),
                      back["final_prediction"].alias("final_prediction"), back["kafka_offset"].alias("kafka_offset"))
