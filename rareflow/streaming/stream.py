"""Structured Streaming runs: sources, the predictions sink with checkpoint and
output binding, progress, and processing/event-time throughput windows."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

# JSON timestamps with microseconds so a read-back equals what was written.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

PREDICTION_SCHEMA_FIELDS = [
    ("EventId", T.StringType()), ("ProducerRunId", T.StringType()), ("EventTimestamp", T.DoubleType()),
    ("IngestionRate", T.DoubleType()), ("Class", T.DoubleType()),
]
TAIL_FIELDS = [
    ("kafka_topic", T.StringType()), ("kafka_partition", T.IntegerType()), ("kafka_offset", T.LongType()),
    ("kafka_timestamp", T.TimestampType()), ("fraud_probability", T.DoubleType()),
    ("final_prediction", T.IntegerType()), ("status", T.StringType()), ("error", T.StringType()),
    ("raw_json", T.StringType()), ("ModelUID", T.StringType()), ("Threshold", T.DoubleType()),
    ("BatchTimestamp", T.TimestampType()),
]


def prediction_schema(keep: Sequence[str] = ()) -> T.StructType:
    fields = PREDICTION_SCHEMA_FIELDS + [(k, T.DoubleType()) for k in keep] + TAIL_FIELDS
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


def kafka_options(bootstrap_servers: str, topics: Sequence[str] | str, *, starting_offsets: str = "earliest",
                  max_offsets_per_trigger: int | None = 10000, fail_on_data_loss: bool = True) -> dict:
    """Options of the Kafka source; a topic listed twice is subscribed once."""
    if isinstance(topics, str):
        topics = [t.strip() for t in topics.split(",")]
    topics = list(dict.fromkeys(t for t in topics if t))
    if not topics:
        raise ValueError("at least one topic is required")
    if starting_offsets not in ("earliest", "latest"):
        raise ValueError("starting offsets must be earliest or latest")
    opts = {"kafka.bootstrap.servers": bootstrap_servers, "subscribe": ",".join(topics),
            "startingOffsets": starting_offsets, "failOnDataLoss": str(bool(fail_on_data_loss)).lower()}
    if max_offsets_per_trigger is not None:
        if max_offsets_per_trigger <= 0:
            raise ValueError("max offsets per trigger must be positive")
        opts["maxOffsetsPerTrigger"] = str(int(max_offsets_per_trigger))
    return opts


def kafka_source(spark: SparkSession, **options) -> DataFrame:
    """Streaming Kafka source (needs the spark-sql-kafka package on the classpath)."""
    return spark.readStream.format("kafka").options(**kafka_options(**options)).load()


KAFKA_RECORD_SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()), T.StructField("timestamp", T.TimestampType())])


def file_source(spark: SparkSession, path: str, schema: T.StructType = KAFKA_RECORD_SCHEMA,
                max_files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Streaming file source in Kafka record shape (for replay and tests)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(int(max_files_per_trigger)))
    return reader.load(path)


def publish_frame(records: DataFrame, topic: str | None = None) -> DataFrame:
    """The columns a Kafka write sends: key, value and (unless fixed) topic. A ``partition``
    column is left out on purpose so the producer spreads records by key hash."""
    cols = ["key", "value"] + (["topic"] if topic is None and "topic" in records.columns else [])
    return records.select(*cols)


def publish_records(records: DataFrame, bootstrap_servers: str | None = None, topic: str | None = None, fmt: str = "kafka", **options: str) -> int:
    """Batch write of (key, value[, topic]) records to Kafka (acks=all), or in another format with its ``options`` (``path``). A failed send fails the
    job; the number written is observed during the write itself (no second pass). ``recovery.deliver`` makes it safe to repeat."""
    import uuid

    from pyspark.sql import Observation

    if fmt == "kafka":
        options = {"kafka.bootstrap.servers": bootstrap_servers, "kafka.acks": "all", **({"topic": topic} if topic else {}), **options}
    seen = Observation(f"rf_published_{uuid.uuid4().hex[:12]}")  # unique per write
    frame = publish_frame(records, topic).observe(seen, F.count(F.lit(1)).alias("records"))
    frame.write.format(fmt).mode("append").options(**options).save()
    return int(seen.get["records"])


def stream_alerts(alerts: DataFrame, bootstrap_servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    from rareflow.streaming.events import alert_records
    return (alert_records(alerts).writeStream.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap_servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).outputMode("append").start())


# --- file system helpers (Hadoop FS: works for local, HDFS and object stores) -----

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder within its file system."""
    fs, p = _fs(spark, source)
    _, to = _fs(spark, target)
    fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        raise OSError(f"{source} could not be moved to {target}")


def move_file(spark: SparkSession, source: str, target: str, pattern: str, name: str) -> None:
    """Move the one file of ``source`` that fits the pattern into the folder ``target`` under a new name."""
    fs, p = _fs(spark, f"{source}/{pattern}")
    found = fs.globStatus(p)
    if len(found) != 1:
        raise OSError(f"{len(found)} files fit {source}/{pattern}")
    if not fs.rename(found[0].getPath(), _fs(spark, f"{target}/{name}")[1]):
        raise OSError(f"{found[0].getPath()} could not be moved")


def move_parts(spark: SparkSession, source: str, target: str) -> None:
    """Move the files that a job wrote to ``source`` into the folder ``target``, which may hold others, and remove ``source``."""
    fs, p = _fs(spark, source)
    _, to = _fs(spark, target)
    fs.mkdirs(to)
    for found in fs.globStatus(_fs(spark, f"{source}/part-*")[1]):
        if not fs.rename(found.getPath(), to):
            raise OSError(f"{found.getPath()} could not be moved")
    fs.delete(p, True)


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    """Copy one file, into folders that are made for it."""
    (fs, p), (to_fs, to) = _fs(spark, source), _fs(spark, target)
    to_fs.mkdirs(to.getParent())
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to_fs, to, False, spark.sparkContext._jsc.hadoopConfiguration())


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file, which only one of several callers at once can: True for that one, False if the file is there."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    try:
        if fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
            file = spark.sparkContext._jvm.java.io.File(p.toUri().getPath())
            return bool(file.createNewFile())
        fs.create(p, False).close()
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise


def dir_is_empty(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return not fs.exists(p) or len(fs.listStatus(p)) == 0


def bind_output(spark: SparkSession, output_dir: str, configuration: dict) -> None:
    """Tie an output folder to one configuration, or make sure that it is tied to this one.

    A folder may be used if nothing is in it, or if it was begun with the same configuration and has both
    predictions and their checkpoint, or neither yet. Anything else is refused, with what was found.
    """
    wanted = json.dumps(configuration, sort_keys=True)
    note = f"{output_dir}/stream_config"
    there = {name: path_exists(spark, f"{output_dir}/{name}") for name in ("stream_config", "predictions", "checkpoint")}
    begun = spark.read.text(note).first() if there["stream_config"] else None
    if begun is None and not there["stream_config"] and dir_is_empty(spark, output_dir):
        spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.text(note)
        return
    state = "other" if begun is None or begun[0] != wanted else "same"
    if (state, there["predictions"] == there["checkpoint"]) != ("same", True):
        found = f"{'a' if there['checkpoint'] else 'no'} checkpoint, {'some' if there['predictions'] else 'no'} predictions"
        raise ValueError(f"{output_dir} cannot go on with this run: {state} configuration, {found}. Give the run a folder of its own.")


def sink_predictions(scored: DataFrame, output_dir: str, *, available_now: bool = True,
                     trigger_seconds: float = 2.0, configuration: dict | None = None,
                     query_name: str | None = None, fmt: str = "json") -> StreamingQuery:
    """Append scored events with a checkpoint; restart-safe (the sink's commit log makes each
    micro-batch visible exactly once). JSON writes nulls out; ``fmt="parquet"`` is the columnar
    choice for large volumes."""
    if fmt not in ("json", "parquet"):
        raise ValueError("predictions are written as json or parquet")
    if configuration is not None:
        bind_output(scored.sparkSession, output_dir, configuration)
    w = (scored.writeStream.format(fmt).outputMode("append")
         .option("path", f"{output_dir}/predictions")
         .option("checkpointLocation", f"{output_dir}/checkpoint"))
    if fmt == "json":
        w = w.option("ignoreNullFields", "false").option("timestampFormat", TIMESTAMP_FORMAT)
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()


def sink_complete(agg: DataFrame, path: str, checkpoint: str, *, available_now: bool = True,
                  trigger_seconds: float = 2.0) -> StreamingQuery:
    """Complete-mode aggregate to Parquet: each micro-batch writes the whole current result to a folder of its
    own (again, if it is retried), and ``read_complete`` takes the last finished one, so a reader never
    sees a result half written. The one before the last stays for readers that have begun."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        for old in finished_batches(batch.sparkSession, path)[:-2]:
            fs, p = _fs(batch.sparkSession, f"{path}/batch={old}")
            fs.delete(p, True)

    w = agg.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()


def finished_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose result is written, ascending."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and path_exists(spark, f"{path}/{n}/_SUCCESS"))


def read_complete(spark: SparkSession, path: str) -> DataFrame:
    """The last finished result of ``sink_complete``."""
    done = finished_batches(spark, path)
    if not done:
        raise ValueError(f"no batch of {path} is finished")
    return spark.read.parquet(f"{path}/batch={done[-1]}")


def read_predictions(spark: SparkSession, output_dir: str, schema: T.StructType | None = None,
                     fmt: str = "json") -> DataFrame:
    """Committed predictions only: read the folder (its ``_spark_metadata`` log), never a glob."""
    if fmt == "parquet":
        return spark.read.parquet(f"{output_dir}/predictions")
    return (spark.read.schema(schema or prediction_schema()).option("timestampFormat", TIMESTAMP_FORMAT)
            .json(f"{output_dir}/predictions"))


def run_stream(query: StreamingQuery, timeout_seconds: float | None = None, drain: bool = False) -> list[dict]:
    """Wait for an availableNow run, or with ``drain`` process what a processing-time query has
    available; return its last progress reports (``recording`` has all of them). A run that isn't over after
    ``timeout_seconds`` is an error. The query is stopped on the way out in every case.
    """
    try:
        if drain:
            query.processAllAvailable()
        elif timeout_seconds is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout_seconds):
            raise TimeoutError(f"the stream was not over after {timeout_seconds} s")
        if query.exception() is not None:
            raise RuntimeError(str(query.exception()))
        return list(query.recentProgress)
    finally:
        if query.isActive:
            query.stop()


class ProgressRecorder(StreamingQueryListener):
    """Keeps the progress of every micro-batch that read data, for one query or all.

    ``query.recentProgress`` only retains the last reports
    (``spark.sql.streaming.numRecentProgressUpdates``); a listener sees them all. None is dropped: an entry is a
    small dict, and a caller that runs for months takes them out with ``take()`` now and then.
    """

    def __init__(self, query_id: str | None = None):
        self.query_id = query_id
        self.events: list[dict] = []
        self.ended: set[str] = set()

    def take(self) -> list[dict]:
        """The entries so far, which are then forgotten."""
        out, self.events = self.events, []
        return out

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.query_id and str(p.id) != self.query_id:
            return
        if p.numInputRows:
            self.events.append({"batchId": p.batchId, "numInputRows": p.numInputRows,
                                "processedRowsPerSecond": p.processedRowsPerSecond,
                                "durationMs": dict(p.durationMs or {}),
                                "observed": {name: row.asDict() for name, row in (p.observedMetrics or {}).items()}})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))  # a restarted query keeps its id


@contextmanager
def recording(spark: SparkSession, queries: int = 1, wait_seconds: float = 60.0) -> Iterator[ProgressRecorder]:
    """A recorder of the streams that run inside the block; on the way out it waits until the reports of
    ``queries`` ended runs have all arrived."""
    recorder = ProgressRecorder()
    spark.streams.addListener(recorder)
    try:
        yield recorder
        until = time.monotonic() + wait_seconds
        while len(recorder.ended) < queries:  # a stream's end is reported after its last batch
            if time.monotonic() > until:
                raise TimeoutError("the streams' last reports did not arrive")
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(recorder)


def batch_progress(spark: SparkSession, progress: list[dict]) -> DataFrame:
    """One row per micro-batch that read data: batch id, input rows, rows/s, trigger ms."""
    seen, rows = set(), []
    for p in progress:
        if not p.get("numInputRows") or p["batchId"] in seen:
            continue
        seen.add(p["batchId"])
        rows.append((int(p["batchId"]), int(p["numInputRows"]), float(p.get("processedRowsPerSecond") or 0.0),
                     int((p.get("durationMs") or {}).get("triggerExecution", 0))))
    return spark.createDataFrame(rows, "batch_id bigint, input_rows bigint, rows_per_second double, "
                                       "trigger_ms bigint")


def throughput_windows(df: DataFrame, time_col: str | Column, duration: str = "1 second", *,
                       by: Sequence[str] = (), watermark: str | None = None) -> DataFrame:
    """Rows per tumbling window (and per ``by`` column, e.g. topic).

    Without a watermark this is for complete mode, over wall-clock time; with one
    it can run in append mode over instants (a window is emitted once the
    watermark passes its end).
    """
    t = F.col(time_col) if isinstance(time_col, str) else time_col
    name = "_rf_time"
    if watermark:
        # a watermark needs an instant (timestamp); windows align to the epoch
        src = df.withColumn(name, t.cast("timestamp")).withWatermark(name, watermark)
    else:
        # wall-clock windows (timestamp_ntz): hours align to the clock in any session time zone
        src = df.withColumn(name, t.cast("timestamp_ntz"))
    agg = src.groupBy(F.window(name, duration).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def processing_time_windows(df: DataFrame, duration: str = "1 second", by: Sequence[str] = ()) -> DataFrame:
    """Throughput per window of processing time (arrival time of each row)."""
    return throughput_windows(df.withColumn("_rf_pt", F.current_timestamp()), "_rf_pt", duration, by=by)
