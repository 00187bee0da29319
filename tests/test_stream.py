"""Streaming runs from a file source in Kafka shape: sink, restart, binding, progress."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rareflow.operators.model import ExpressionScorer
from rareflow.session import work_path
from rareflow.streaming import events as E
from rareflow.streaming import stream as ST

FEATURES = ["Time", "V1", "Amount"]
SCORER = ExpressionScorer("V1 / 10", uid="u")


def write_batch(spark, folder, start, payloads):
    ts = dt.datetime(2026, 9, 17, 12, 0, 0)
    rows = [(f"k{start + i}".encode(), (p if isinstance(p, str) else json.dumps(p)).encode(), "t", (start + i) % 2,
             start + i, ts) for i, p in enumerate(payloads)]
    spark.createDataFrame(rows, ST.KAFKA_RECORD_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def ev(i):
    return {"Time": float(i), "V1": (i % 7) / 10, "Amount": 1.0, "Class": float(i % 2), "EventId": f"e-{i}",
            "ProducerRunId": "p", "EventTimestamp": 1700000000.0 + i, "IngestionRate": 5.0}


def scored_stream(spark, folder):
    return E.score_events(E.parse_events(ST.file_source(spark, folder), FEATURES), SCORER, FEATURES, 0.3,
                          keep=["Time", "Amount"])


def test_restart_adds_nothing_then_only_new(spark):
    base = work_path(spark, "t-stream")
    src, out = f"{base}/src", f"{base}/out"
    write_batch(spark, src, 0, [ev(i) for i in range(13)] + ["{malformed json"])
    conf = {"model": "u", "threshold": 0.3}
    ST.run_stream(ST.sink_predictions(scored_stream(spark, src), out, configuration=conf))
    schema = ST.prediction_schema(["Time", "Amount"])
    assert ST.read_predictions(spark, out, schema).count() == 14
    ST.run_stream(ST.sink_predictions(scored_stream(spark, src), out, configuration=conf))
    assert ST.read_predictions(spark, out, schema).count() == 14
    write_batch(spark, src, 14, [ev(1)])
    ST.run_stream(ST.sink_predictions(scored_stream(spark, src), out, configuration=conf))
    got = ST.read_predictions(spark, out, schema)
    assert got.count() == 15
    assert got.filter(F.col("status") == "rejected").count() == 1
    assert E.duplicate_offsets(got).first()["duplicate_rows"] == 0
    offline = E.score_events(E.parse_events(spark.read.parquet(src), FEATURES), SCORER, FEATURES, 0.3)
    par = E.score_parity(offline.filter("status = 'scored'"), got.filter("status = 'scored'")).first()
    assert par["score_mismatches"] == 0 and par["decision_mismatches"] == 0 and par["only_online"] == 0


def test_output_binding(spark):
    base = work_path(spark, "t-bind")
    src, out = f"{base}/src", f"{base}/out"
    write_batch(spark, src, 0, [ev(i) for i in range(3)])
    ST.run_stream(ST.sink_predictions(scored_stream(spark, src), out, configuration={"threshold": 0.3}))
    with pytest.raises(ValueError, match="other configuration"):
        ST.bind_output(spark, out, {"threshold": 0.4})
    ST.bind_output(spark, out, {"threshold": 0.3})
    ST.move(spark, f"{out}/checkpoint", f"{base}/taken")
    with pytest.raises(ValueError, match="no checkpoint, some predictions"):
        ST.bind_output(spark, out, {"threshold": 0.3})
    other = f"{base}/other"
    spark.range(1).write.parquet(f"{other}/junk")
    with pytest.raises(ValueError, match="other configuration"):
        ST.bind_output(spark, other, {"threshold": 0.3})


def test_progress_and_windows(spark):
    base = work_path(spark, "t-prog")
    src, out = f"{base}/src", f"{base}/out"
    for b in range(3):
        write_batch(spark, src, b * 10, [ev(b * 10 + i) for i in range(10)])
    stream = E.score_events(E.parse_events(ST.file_source(spark, src, max_files_per_trigger=1), FEATURES),
                            SCORER, FEATURES, 0.3)
    prog = ST.run_stream(ST.sink_predictions(stream, out))
    per = ST.batch_progress(spark, prog).collect()
    assert len(per) == 3 and sum(r["input_rows"] for r in per) == 30
    win = ST.throughput_windows(spark.read.parquet(src), "timestamp", "1 second", by=["topic"]).collect()
    assert [(r["topic"], r["n"]) for r in win] == [("t", 30)]


def test_processing_time_windows_and_stream_stats(spark):
    base = work_path(spark, "t-pt")
    src = f"{base}/src"
    write_batch(spark, src, 0, [ev(i) for i in range(12)])
    win = ST.processing_time_windows(spark.read.parquet(src), "1 hour").collect()
    assert sum(r["n"] for r in win) == 12
    scored = scored_stream(spark, src)
    stats = E.response_time_stats(E.response_time(scored, processing_time=F.lit(dt.datetime(2024, 1, 1))))
    q = stats.writeStream.outputMode("complete").format("memory").queryName("t_stats").trigger(
        availableNow=True).start()
    q.awaitTermination()
    r = spark.table("t_stats").first()
    assert r["rows"] == 12


def test_stream_scores_with_reloaded_forest_equal_batch(spark):
    from rareflow.operators import model as MD
    from rareflow.spec import FeatureSpec

    base = work_path(spark, "t-forest")
    src, out, mpath = f"{base}/src", f"{base}/out", f"{base}/model"
    train = spark.createDataFrame([(float(i), (i % 7) / 10, float(i % 3), float(i % 7 >= 4)) for i in range(200)],
                                  "Time double, V1 double, Amount double, Class double")
    spec = FeatureSpec(FEATURES, "Class")
    MD.save_model(MD.train_forest(train, spec, num_trees=4, max_depth=3), mpath)
    model = MD.load_model(mpath, FEATURES)
    scorer = MD.ModelScorer(model, FEATURES)
    write_batch(spark, src, 0, [ev(i) for i in range(20)] + ["{malformed json"])
    online_stream = E.score_events(E.parse_events(ST.file_source(spark, src), FEATURES), scorer, FEATURES, 0.5)
    ST.run_stream(ST.sink_predictions(online_stream, out))
    online = ST.read_predictions(spark, out)
    offline = E.score_events(E.parse_events(spark.read.parquet(src), FEATURES), scorer, FEATURES, 0.5)
    assert online.count() == 21 and online.filter("status = 'rejected'").count() == 1
    par = E.score_parity(offline.filter("status = 'scored'"), online.filter("status = 'scored'")).first()
    assert par["matched"] == 20 and par["score_mismatches"] == 0 and par["decision_mismatches"] == 0


def test_windows_append_mode_with_watermark(spark):
    base = work_path(spark, "t-wm")
    src, out = f"{base}/src", f"{base}/out"
    write_batch(spark, src, 0, [ev(i) for i in range(5)])
    stream = ST.file_source(spark, src).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 0 SECONDS"))
    win = ST.throughput_windows(stream, "timestamp", "1 minute", watermark="1 minute")
    q = (win.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    assert q.exception() is None


def test_parquet_predictions_restart(spark):
    base = work_path(spark, "t-pq")
    src, out = f"{base}/src", f"{base}/out"
    write_batch(spark, src, 0, [ev(i) for i in range(6)] + ["{bad"])
    for _ in range(2):
        ST.run_stream(ST.sink_predictions(scored_stream(spark, src), out, fmt="parquet"))
    got = ST.read_predictions(spark, out, fmt="parquet")
    assert got.count() == 7 and got.filter("status = 'rejected'").count() == 1


def test_every_batch_is_recorded_beyond_what_the_query_keeps(spark):
    base = work_path(spark, "t-listen")
    src, out = f"{base}/src", f"{base}/out"
    spark.range(1040).repartition(104).select(F.lit(b"k").alias("key"), F.lit(b"{}").alias("value"), F.lit("t").alias("topic"), F.lit(0).alias("partition"),
                                              F.col("id").alias("offset"), F.current_timestamp().alias("timestamp")).write.parquet(src)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        with ST.recording(spark) as seen:
            last = ST.run_stream(ST.sink_predictions(scored_stream_of(spark, src, 1), out))
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    per = ST.batch_progress(spark, seen.events).collect()
    assert len(last) <= 3 and len(per) == 104 and sum(r["input_rows"] for r in per) == 1040
    assert len(seen.take()) == 104 and seen.events == []


def scored_stream_of(spark, src, max_files):
    return E.score_events(E.parse_events(ST.file_source(spark, src, max_files_per_trigger=max_files), FEATURES), SCORER, FEATURES, 0.3)


def test_a_run_that_takes_too_long_is_an_error(spark):
    base = work_path(spark, "t-slow")
    write_batch(spark, f"{base}/src", 0, [ev(i) for i in range(3)])
    q = ST.sink_predictions(scored_stream(spark, f"{base}/src"), f"{base}/out", available_now=False, trigger_seconds=0.2)
    with pytest.raises(TimeoutError):
        ST.run_stream(q, timeout_seconds=1)
    assert not q.isActive


def test_complete_results_are_whole_at_any_time(spark):
    base = work_path(spark, "t-complete")
    src, out = f"{base}/src", f"{base}/result"
    with pytest.raises(ValueError, match="finished"):
        ST.read_complete(spark, out)
    for b in range(4):
        write_batch(spark, src, b * 5, [ev(b * 5 + i) for i in range(5)])
        agg = ST.throughput_windows(ST.file_source(spark, src), "timestamp", "1 hour")
        ST.run_stream(ST.sink_complete(agg, out, f"{base}/ckpt"))
        assert ST.read_complete(spark, out).first()["n"] == 5 * (b + 1)
    done = ST.finished_batches(spark, out)
    assert len(done) == 2
    spark.range(1).write.parquet(f"{out}/batch=99")
    fs, p = ST._fs(spark, f"{out}/batch=99/_SUCCESS")
    fs.delete(p, False)  # a batch that is still being written
    assert ST.finished_batches(spark, out) == done


def test_alert_stream_needs_the_connector(spark):
    base = work_path(spark, "t-alerts")
    src = f"{base}/src"
    write_batch(spark, src, 0, [ev(i) for i in range(3)])
    alerts = E.fraud_alerts(scored_stream(spark, src))
    with pytest.raises(Exception, match="(?i)kafka"):
        q = ST.stream_alerts(alerts, "localhost:9092", "fraud-alerts", f"{base}/ckpt")
        ST.run_stream(q)
