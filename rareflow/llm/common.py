"""What the operators share: reading columns whatever their types, batches of bytes, tables kept for reuse."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rareflow.session import work_path

#: Python workers take texts in pieces of about this many bytes.
PIECE = 1 << 20
BATCH_LIMIT = 4 << 20


def kept(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once as Parquet below ``spark.checkpoint.dir`` and read back: later jobs neither
    compute it again nor depend on the executors that made it."""
    path = work_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def in_small_batches(frame: DataFrame) -> DataFrame:
    """``frame``, after the session's limit of an Arrow batch was lowered to 4 MB if it is larger: a batch is held by the
    JVM and by a worker at once, and rows of long texts would otherwise make each of them 64 MB."""
    conf, name = frame.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)b?\s*", conf.get(name).lower())
    if not size or int(size[1]) << (10 * " kmgt".index(size[2] or " ")) > BATCH_LIMIT:
        conf.set(name, str(BATCH_LIMIT))
    return frame


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          position_col: str | None = None) -> DataFrame:
    """The two columns as ``doc_id`` (long) and ``text`` (never null); a position (long) goes with them if it is named."""
    position = [docs[position_col].cast("long").alias("position")] if position_col else []
    return in_small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"),
                                         F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *position)


def crc(value: Column) -> Column:
    """Unsigned CRC-32 of a string's UTF-8 bytes."""
    return F.crc32(value.cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def raw(column: pa.Array) -> list[bytes]:
    """Each string's UTF-8 bytes; null as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def parts(batch: pa.RecordBatch, column: str = "text", size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive rows of a batch with about ``size`` bytes of text each (one row at least), and their texts; only
    one part's texts are held at a time."""
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, start = np.cumsum(length), 0
    while start < batch.num_rows:
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + size, "right")))
        rows = batch.slice(start, stop - start)
        yield rows, raw(rows.column(column))
        start = stop


def pieces(items: list[bytes], size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about ``size`` bytes each (one item at least)."""
    start = held = 0
    for i, item in enumerate(items):
        if i > start and held + len(item) > size:
            yield start, i
            start, held = i, 0
        held += len(item)
    if items:
        yield start, len(items)


def ids_crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
