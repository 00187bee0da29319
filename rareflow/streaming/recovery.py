"""What a stream's checkpoint and sink keep about it, and runs that go on after a failure.

A micro-batch is *begun* once its offsets are in the checkpoint and *finished* once its commit is; a failure in between leaves a
begun batch, which the next start with the same checkpoint runs again, on the same input. The file sink has a log of its own: files of
a batch that it logged are committed, all others in its folder are leftovers that a reader of the folder doesn't see.

All of it is read with Spark from the logs that Spark retains (``spark.sql.streaming.minBatchesToRetain``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rareflow.streaming.stream import path_exists, run_stream


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """(batch_id, value) of a checkpoint's log, a file per batch; none if the log isn't there yet."""
    if not path_exists(spark, folder):
        return spark.createDataFrame([], "batch_id long, value string")
    files = spark.read.text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_name").try_cast("long").alias("batch_id"), "value").where("batch_id is not null")


def batches(spark: SparkSession, checkpoint: str) -> DataFrame:
    """A row per begun batch: batch_id, started, watermark (that its windows are closed by), late_watermark (that its rows are late by: the one of
    the batch before), source_offset (log offset of the first file source, if it is one) and whether it is committed."""
    lines = F.split("value", "\n")
    instant = lambda name: F.timestamp_millis(F.get_json_object(lines[1], f"$.{name}").cast("long"))
    begun = _log(spark, f"{checkpoint}/offsets").select(
        "batch_id", instant("batchTimestampMs").alias("started"), instant("batchWatermarkMs").alias("watermark"),
        F.get_json_object(F.get(lines, 2), "$.logOffset").cast("long").alias("source_offset"))
    done = _log(spark, f"{checkpoint}/commits").select("batch_id", F.lit(True).alias("committed"))
    before = F.lag("watermark").over(Window.partitionBy().orderBy("batch_id"))  # a row per retained batch
    return begun.join(done, "batch_id", "left").select(
        "batch_id", "started", "watermark", F.coalesce(before, F.timestamp_millis(F.lit(0))).alias("late_watermark"), "source_offset", F.coalesce("committed", F.lit(False)).alias("committed"))


def unfinished(spark: SparkSession, checkpoint: str) -> list[int]:
    """Numbers of the batches that were begun and not committed: one at most, unless the log was tampered with."""
    return [r["batch_id"] for r in batches(spark, checkpoint).where("not committed").orderBy("batch_id").collect()]


@dataclass
class Attempt:
    """One start of a stream: its last progress reports, or the error that ended it and the batches that it left unfinished."""

    reports: list[dict] = field(default_factory=list)
    error: str | None = None
    unfinished: list[int] = field(default_factory=list)


def run_recovering(start: Callable[[], StreamingQuery], spark: SparkSession, checkpoint: str, attempts: int = 3,
                   timeout_seconds: float | None = None) -> list[Attempt]:
    """Run a stream to its end, starting it again from its checkpoint after a failure, ``attempts`` times at most.

    ``start`` starts the query, with the same checkpoint each time. Returns all attempts, the last without error; if the last one
    allowed fails too, its error is raised. Other errors than the query's own aren't retried.
    """
    tried: list[Attempt] = []
    while True:
        try:
            tried.append(Attempt(reports=run_stream(start(), timeout_seconds)))
            return tried
        except StreamingQueryException as error:
            tried.append(Attempt(error=str(error), unfinished=unfinished(spark, checkpoint)))
            if len(tried) >= attempts:
                raise


def _path(c: str | Column) -> Column:
    """A file's path in one spelling: logs escape it, and write local ones with one or three slashes."""
    return F.regexp_replace(F.url_decode(c), "^file:/+", "file:/")


def source_files(spark: SparkSession, checkpoint: str, source: int = 0) -> DataFrame:
    """(path, batch_id) of each file that a file source has handed to a batch."""
    lines = spark.read.text(f"{checkpoint}/sources/{source}").where(F.col("value").startswith("{"))
    entry = lambda name: F.get_json_object("value", f"$.{name}")
    files = lines.select(_path(entry("path")).alias("path"), entry("batchId").cast("long").alias("source_offset")).distinct()  # compacted logs repeat entries
    first = batches(spark, checkpoint).groupBy("source_offset").agg(F.min("batch_id").alias("batch_id"))
    return files.join(first, "source_offset").select("path", "batch_id")


def late_rows(spark: SparkSession, checkpoint: str, path: str, time_col: str | Column, duration: str, fmt: str = "parquet") -> DataFrame:
    """The rows of a file stream that a windowed aggregate left out, with ``window_start``, ``window_end`` and ``batch_id``: those whose window had
    ended by the watermark when their batch began. Told from the logs and the files alone, not from the aggregate."""
    time = F.col(time_col) if isinstance(time_col, str) else time_col
    rows = spark.read.format(fmt).load(path).withColumn("_rf_file", _path(F.col("_metadata.file_path")))
    arrived = source_files(spark, checkpoint).join(batches(spark, checkpoint).select("batch_id", "late_watermark"), "batch_id")
    rows = rows.join(arrived, F.col("_rf_file") == F.col("path")).drop("_rf_file", "path").withColumn("_rf_w", F.window(time.cast("timestamp"), duration))
    return rows.where(F.col("_rf_w.end") <= F.col("late_watermark")).select("*", F.col("_rf_w.start").alias("window_start"), F.col("_rf_w.end").alias("window_end")).drop("_rf_w", "late_watermark")


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(window_start, window_end, the other keys, n) that a stopped stream of ``throughput_windows`` still holds in its state."""
    state = spark.read.format("statestore").load(checkpoint)
    keys = state.schema["key"].dataType.names
    window, others = keys[0], keys[1:]
    return state.select(F.col(f"key.`{window}`.start").alias("window_start"), F.col(f"key.`{window}`.end").alias("window_end"),
                        *[F.col(f"key.`{k}`").alias(k) for k in others], F.col(f"value.`{state.schema['value'].dataType.names[0]}`").cast("long").alias("n"))


def sink_windows(windows: DataFrame, output_dir: str, *, available_now: bool = True, trigger_seconds: float = 2.0) -> StreamingQuery:
    """Append-mode sink of windows over a watermark: each window is written once, when the watermark has passed its end."""
    w = (windows.writeStream.format("parquet").outputMode("append").option("path", f"{output_dir}/windows").option("checkpointLocation", f"{output_dir}/checkpoint"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()


def window_account(spark: SparkSession, output_dir: str, path: str, time_col: str | Column, duration: str, by: list[str] | None = None) -> DataFrame:
    """(window_start, window_end, keys, state, n): where the rows of an append-mode stream went. ``closed`` windows are written, ``open`` ones are
    held until the watermark passes them, ``late`` rows came after their window was closed. The three together are the input."""
    keys = ["window_start", "window_end", *(by or [])]
    checkpoint = f"{output_dir}/checkpoint"
    closed = spark.read.parquet(f"{output_dir}/windows").select(*keys, F.lit("closed").alias("state"), "n")
    held = open_windows(spark, checkpoint).select(*keys, F.lit("open").alias("state"), "n")
    late = late_rows(spark, checkpoint, path, time_col, duration).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.lit("late").alias("state"), "n")
    return closed.unionByName(held).unionByName(late)


# --- what the file sink committed ------------------------------------------------------

def committed_files(spark: SparkSession, output_dir: str) -> DataFrame:
    """Paths of the files that the sink's log names as written: those that a reader of the folder plans to read."""
    paths = spark.read.text(f"{output_dir}/predictions").inputFiles()
    return spark.createDataFrame([(p,) for p in paths], "path string").select(_path("path").alias("path"))


def stray_files(spark: SparkSession, output_dir: str, pattern: str = "*.json") -> DataFrame:
    """(path, length) of files in the sink's folder that no finished batch wrote: left by a batch that failed, or put there by others. A reader of
    the folder doesn't see them; one of a file pattern does."""
    there = spark.read.format("binaryFile").load(f"{output_dir}/predictions/{pattern}").select(_path("path").alias("path"), "length")
    return there.join(committed_files(spark, output_dir), "path", "left_anti")


def stray_entries(spark: SparkSession, output_dir: str, pattern: str = "*.json") -> DataFrame:
    """(entry, files, length) of the stray files by what lies directly in the sink's folder: a file, or a folder of part files that tasks wrote together."""
    entry = F.regexp_extract("path", r"/predictions/([^/]+)(?:/[^/]+)?$", 1).alias("entry")
    return stray_files(spark, output_dir, pattern).groupBy(entry).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("length"))


# --- metrics of each batch -------------------------------------------------------------

OBSERVED = "scored_events"


def observing(scored: DataFrame, name: str = OBSERVED) -> DataFrame:
    """``scored``, counted as it streams: rows, scored, rejected and alerts of each batch come with its progress report."""
    status = F.col("status")
    return scored.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(status == "scored").alias("scored"), F.count_if(status == "rejected").alias("rejected"),
                          F.count_if(F.col("final_prediction") == 1).alias("alerts"))


def batch_metrics(spark: SparkSession, reports: list[dict], name: str = OBSERVED) -> DataFrame:
    """(batch_id, input_rows, rows, scored, rejected, alerts) of each reported batch (``stream.recording``) of an observed stream."""
    fields = ("rows", "scored", "rejected", "alerts")
    found = {r["batchId"]: (int(r["batchId"]), int(r["numInputRows"]), *(int(r["observed"][name][f]) for f in fields)) for r in reports if name in r.get("observed", {})}
    return spark.createDataFrame(list(found.values()), "batch_id long, input_rows long, " + ", ".join(f"{f} long" for f in fields))


def written_metrics(predictions: DataFrame, checkpoint: str) -> DataFrame:
    """(batch_id, rows, scored, rejected, alerts) of the committed predictions, told apart by the start of their batch."""
    status = F.col("status")
    per = predictions.groupBy("BatchTimestamp").agg(F.count(F.lit(1)).alias("rows"), F.count_if(status == "scored").alias("scored"), F.count_if(status == "rejected").alias("rejected"),
                                                     F.count_if(F.col("final_prediction") == 1).alias("alerts"))
    started = batches(predictions.sparkSession, checkpoint).select("batch_id", F.col("started").alias("BatchTimestamp"))
    return per.join(started, "BatchTimestamp", "left").drop("BatchTimestamp").select("batch_id", "rows", "scored", "rejected", "alerts")


# --- several streams side by side --------------------------------------------------------

def run_side_by_side(spark: SparkSession, starts: dict[str, Callable[[], StreamingQuery]], timeout_seconds: float = 3600.0) -> dict[str, str | None]:
    """Start a stream for each name, each in a scheduler pool of that name, and wait until all have ended: the error of each, or None.

    One that fails doesn't stop the others. Streams still running after ``timeout_seconds`` are stopped and have an error.
    """
    import time

    running: dict[str, StreamingQuery] = {}
    ended: dict[str, str | None] = {}
    context, pool = spark.sparkContext, "spark.scheduler.pool"
    outer = context.getLocalProperty(pool)
    try:
        for name, start in starts.items():
            context.setLocalProperty(pool, name)
            try:
                running[name] = start()
            except Exception as error:  # noqa: BLE001 - a stream that can't start is one that failed
                ended[name] = f"{type(error).__name__}: {error}"
    finally:
        context.setLocalProperty(pool, outer)
    until = time.monotonic() + timeout_seconds
    while running:
        left = until - time.monotonic()
        spark.streams.resetTerminated()
        if all(q.isActive for q in running.values()) and left > 0:
            try:
                spark.streams.awaitAnyTermination(min(left, 1.0))
            except StreamingQueryException:  # which one it was is asked below
                pass
        for name, query in list(running.items()):
            if not query.isActive or left <= 0:
                error = query.exception()
                ended[name] = str(error) if error is not None else "not over in time" if query.isActive else None
                query.stop()
                del running[name]
    return {name: ended[name] for name in starts}


# --- delivery ------------------------------------------------------------------------------

@dataclass
class Delivery:
    """``records`` to deliver, ``sent`` by the last attempt (observed in its write), found as ``delivered`` rows with ``distinct`` keys, ``missing``
    keys, and ``attempts`` made."""

    records: int
    sent: int
    delivered: int
    distinct: int
    missing: int
    attempts: int


def deliver(records: DataFrame, write: Callable[[DataFrame], None], delivered: Callable[[], DataFrame], key: str = "key", attempts: int = 3) -> Delivery:
    """Write records with unique keys until each is found where they go; safe to repeat.

    ``write`` sends a frame, ``delivered`` reads what has arrived (a frame with the key; empty at first). Each attempt sends only what
    isn't there yet, so neither a failed attempt that got part of the way nor a second call sends a record twice. The last error is raised
    if records are missing after all attempts.
    """
    import uuid

    from pyspark.sql import Observation

    error: Exception | None = None
    account = Delivery(0, 0, 0, 0, 0, 0)
    for account.attempts in range(1, attempts + 1):
        there = delivered().select(key).distinct()
        seen = Observation(f"rf_sent_{uuid.uuid4().hex[:12]}")
        try:
            write(records.join(there, key, "left_anti").observe(seen, F.count(F.lit(1)).alias("n")))
            account.sent, error = int(seen.get["n"]), None
        except Exception as failed:  # noqa: BLE001 - whatever the sink raises; raised again below if records stay missing
            account.sent, error = 0, failed
        found = delivered().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        both = records.groupBy(key).agg(F.count(F.lit(1)).alias("want")).join(found, key, "left")
        totals = both.agg(F.sum("want").alias("records"), F.sum("n").alias("delivered"), F.count("n").alias("distinct"), F.count_if(F.col("n").isNull()).alias("missing")).first()
        for name in ("records", "delivered", "distinct", "missing"):
            setattr(account, name, int(totals[name] or 0))
        if not account.missing:
            return account
    raise error or RuntimeError(f"{account.missing} of {account.records} records did not arrive in {attempts} attempts")
