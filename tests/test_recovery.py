"""Streams that fail before and after the sink's files, late rows, leftovers, observed batches, streams side by side, delivery."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from rareflow.session import work_path
from rareflow.streaming import recovery as R
from rareflow.streaming import stream as ST
from test_stream import ev, scored_stream, write_batch

SCHEMA = ST.prediction_schema(["Time", "Amount"])


def failing(scored, offset):
    return scored.withColumn("EventId", F.when(F.col("kafka_offset") == offset, F.raise_error(F.lit("marked row")).cast("string")).otherwise(F.col("EventId")))


def offsets(spark, out):
    return sorted(r.kafka_offset for r in ST.read_predictions(spark, out, SCHEMA).select("kafka_offset").collect())


def test_a_batch_that_failed_before_its_files_is_run_again(spark):
    base = work_path(spark, "t-crash")
    src, out, check = f"{base}/src", f"{base}/out", f"{base}/out/checkpoint"
    write_batch(spark, src, 0, [ev(i) for i in range(5)])
    assert R.unfinished(spark, check) == []
    ST.run_stream(ST.sink_predictions(scored_stream(spark, src), out))
    write_batch(spark, src, 5, [ev(i) for i in range(5, 9)])
    with pytest.raises(StreamingQueryException):
        ST.run_stream(ST.sink_predictions(failing(scored_stream(spark, src), 7), out))
    assert offsets(spark, out) == list(range(5)) and R.unfinished(spark, check) == [1]
    tries = iter([failing(scored_stream(spark, src), 7), scored_stream(spark, src)])
    write_batch(spark, src, 9, [ev(9)])  # arrives while the stream is down: a batch of its own, after the one begun
    attempts = R.run_recovering(lambda: ST.sink_predictions(next(tries), out), spark, check)
    assert [a.unfinished for a in attempts] == [[1], []] and "marked row" in attempts[0].error and attempts[1].error is None
    assert offsets(spark, out) == list(range(10)) and R.unfinished(spark, check) == []
    assert [r.committed for r in R.batches(spark, check).orderBy("batch_id").collect()] == [True, True, True]


def test_a_batch_that_failed_after_its_files_is_not_written_twice(spark):
    base = work_path(spark, "t-crash-after")
    src, out, check = f"{base}/src", f"{base}/out", f"{base}/out/checkpoint"
    for start in (0, 4):
        write_batch(spark, src, start, [ev(i) for i in range(start, start + 4)])
        ST.run_stream(ST.sink_predictions(scored_stream(spark, src), out))
    ST.move(spark, f"{check}/commits/1", f"{base}/gone/1")  # as if the run had ended between the sink's log and the commit
    assert R.unfinished(spark, check) == [1]
    ST.run_stream(ST.sink_predictions(scored_stream(spark, src), out))
    assert offsets(spark, out) == list(range(8)) and R.unfinished(spark, check) == []


def test_a_stream_that_keeps_failing_raises(spark):
    base = work_path(spark, "t-crash-always")
    write_batch(spark, f"{base}/src", 0, [ev(i) for i in range(3)])
    starts = []

    def start():
        starts.append(1)
        return ST.sink_predictions(failing(scored_stream(spark, f"{base}/src"), 1), f"{base}/out")

    with pytest.raises(StreamingQueryException):
        R.run_recovering(start, spark, f"{base}/out/checkpoint", attempts=2)
    assert len(starts) == 2


def test_leftovers_are_told_from_committed_files(spark):
    base = work_path(spark, "t-stray")
    src, out = f"{base}/src", f"{base}/out"
    write_batch(spark, src, 0, [ev(i) for i in range(5)])
    ST.run_stream(ST.sink_predictions(scored_stream(spark, src), out))
    assert R.stray_files(spark, out).count() == 0
    spark.createDataFrame([('{"EventId":"stray"}',)], "value string").coalesce(1).write.text(f"{base}/stray")
    ST.move_file(spark, f"{base}/stray", f"{out}/predictions", "part-*.txt", "part-stray.json")
    assert [r.path.rsplit("/", 1)[1] for r in R.stray_files(spark, out).collect()] == ["part-stray.json"]
    assert offsets(spark, out) == list(range(5))
    assert spark.read.schema(SCHEMA).json(f"{out}/predictions/*.json").count() == 6
    with pytest.raises(OSError):
        ST.move_file(spark, f"{base}/stray", out, "part-*.txt", "x")


def test_copies_are_written_by_many_tasks_and_are_one_stray_entry(spark, monkeypatch):
    from conftest import SF

    from rareflow.plans import recovery_queries as Q

    seen, entries, split = [], R.stray_entries, "spark.sql.files.maxPartitionBytes"
    monkeypatch.setattr(R, "stray_entries", lambda *a: seen.append(entries(*a)) or seen[0])
    before = spark.conf.get(split)
    try:
        spark.conf.set(split, "8k")
        got = Q.q_read_predictions_committed(spark, SF).collect()
        files = {r.entry: r.files for r in seen[0].collect()}
    finally:
        spark.conf.set(split, before)
    assert {r.stray_files for r in got} == {2} and set(files) == {"stray-copy.json", "stray-broken.json"}
    assert files["stray-copy.json"] > 1 and files["stray-broken.json"] == 1


def test_observed_batches_agree_with_what_is_written(spark):
    base = work_path(spark, "t-observed")
    src, out = f"{base}/src", f"{base}/out"
    with ST.recording(spark, queries=2) as seen:
        for start in (0, 10):
            write_batch(spark, src, start, [ev(i) for i in range(start, start + 9)] + ["{malformed"])
            ST.run_stream(ST.sink_predictions(R.observing(scored_stream(spark, src)), out))
    seen_rows = sorted(map(tuple, R.batch_metrics(spark, seen.events).drop("input_rows").collect()))
    assert seen_rows == sorted(map(tuple, R.written_metrics(ST.read_predictions(spark, out, SCHEMA), f"{out}/checkpoint").collect()))
    assert [r[:4] for r in seen_rows] == [(0, 10, 9, 1), (1, 10, 9, 1)]
    assert R.batch_metrics(spark, []).count() == 0


def test_closed_open_and_late_rows_are_the_input(spark):
    base = work_path(spark, "t-late")
    for minutes in ([0, 1, 61, 200], [30, 150, 201, 330], [10, 331, 100, 200, 329]):
        rows = [(None, None, None, None, None, m * 60) for m in minutes]
        frame = spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset long, s long").withColumn("timestamp", F.timestamp_seconds("s")).drop("s")
        frame.coalesce(1).write.mode("append").parquet(f"{base}/in")
        ST.run_stream(R.sink_windows(ST.throughput_windows(ST.file_source(spark, f"{base}/in"), "timestamp", "1 hour", watermark="1 hour"), f"{base}/out"))
    account = R.window_account(spark, f"{base}/out", f"{base}/in", "timestamp", "1 hour")
    got = sorted((int(r.window_start.timestamp()) // 3600, r.state, r.n) for r in account.collect())
    # watermarks 140, 270, 271 minutes: of the second batch minute 30, of the third 10, 100 and 200 are late
    assert got == [(0, "closed", 2), (0, "late", 2), (1, "closed", 1), (1, "late", 1), (2, "closed", 1), (3, "closed", 2), (3, "late", 1), (5, "open", 3)]
    assert sum(n for *_, n in got) == 13


def test_streams_side_by_side_one_fails(spark):
    base = work_path(spark, "t-side")
    for topic in ("a", "b", "c"):
        write_batch(spark, f"{base}/{topic}", 0, [ev(i) for i in range(6)])

    def start(topic):
        def run():
            scored = scored_stream(spark, f"{base}/{topic}")
            return ST.sink_predictions(failing(scored, 2) if topic == "b" else scored, f"{base}/out/{topic}")
        return run

    def unstartable():
        raise ValueError("no such source")

    ended = R.run_side_by_side(spark, {**{t: start(t) for t in ("a", "b", "c")}, "d": unstartable})
    assert list(ended) == ["a", "b", "c", "d"] and ended["a"] is None and ended["c"] is None
    assert "marked row" in ended["b"] and "no such source" in ended["d"]
    assert all(offsets(spark, f"{base}/out/{t}") == list(range(6)) for t in ("a", "c"))
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_delivery_that_breaks_off_and_is_repeated(spark):
    target = work_path(spark, "t-delivered")
    records = spark.range(50).select(F.col("id").cast("string").cast("binary").alias("key"), F.lit("x").alias("value"))

    def delivered():
        return spark.read.schema(records.schema).parquet(target) if ST.path_exists(spark, target) else spark.createDataFrame([], records.schema)

    def broken(frame):
        frame.where("cast(key as string) < '3'").write.mode("append").parquet(target)
        raise OSError("broke off")

    with pytest.raises(OSError):
        R.deliver(records, broken, delivered, attempts=1)
    part = delivered().count()
    assert 0 < part < 50
    sink = lambda frame: frame.write.mode("append").parquet(target)
    assert R.deliver(records, sink, delivered) == R.Delivery(50, 50 - part, 50, 50, 0, 1)
    assert R.deliver(records, sink, delivered) == R.Delivery(50, 0, 50, 50, 0, 1)
    with pytest.raises(RuntimeError):
        R.deliver(records.withColumn("key", F.concat("key", F.lit("z").cast("binary"))), lambda frame: frame.count(), delivered, attempts=1)
