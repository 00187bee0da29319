"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A record is: payload length (8 bytes, little-endian), masked CRC-32C of those 8 bytes (4), payload, masked
CRC-32C of the payload (4). A payload is: one byte of flags (1: the id is null, 2: token ids take 4 bytes
instead of 2), the document's id (8 bytes), its token ids. Files hold documents in ascending id; the order of
files is the order of ids. The index is a Parquet table with a row per record: file, its place in the order,
byte offset, length of the record, tokens before it in the file, and its tokens.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rareflow.llm.checksums import crc32c, masked
from rareflow.llm.common import ids_crc, parts, texts
from rareflow.llm.tokens import encoder
from rareflow.session import work_path

INDEX = "part int, file string, doc_id long, offset long, length long, tokens_before long, n_tokens long"
#: Bytes of records that a reader fetches and checks at once.
FETCH = 8 << 20
#: Bytes of records that one task reads.
TASK_BYTES = 64 << 20


class DamagedRecord(ValueError):
    """A record whose length or payload doesn't match its checksum."""


def frame(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    head_crc, body_crc = masked(crc32c(heads)).tolist(), masked(crc32c(payloads)).tolist()
    return [h + struct.pack("<I", a) + p + struct.pack("<I", b)
            for h, a, p, b in zip(heads, head_crc, payloads, body_crc, strict=True)]


def unframe(framed: list[bytes]) -> list[bytes]:
    """The payloads of whole records; raises DamagedRecord where a length or checksum is off."""
    heads, payloads = [x[:8] for x in framed], [x[12:-4] for x in framed]
    if any(len(x) < 20 or struct.unpack("<Q", x[:8])[0] != len(x) - 16 for x in framed):
        raise DamagedRecord("a record's length doesn't match its frame")
    said = np.array([struct.unpack("<I", x[8:12]) + struct.unpack("<I", x[-4:]) for x in framed], np.uint32).reshape(-1, 2)
    if (masked(crc32c(heads)) != said[:, 0]).any() or (masked(crc32c(payloads)) != said[:, 1]).any():
        raise DamagedRecord("a record's checksum doesn't match")
    return payloads


def payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return struct.pack("<Bq", (doc_id is None) + 2 * bool(wide), doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def parse(body: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack("<Bq", body[:9])
    return None if flags & 1 else doc_id, np.frombuffer(body[9:], "<u4" if flags & 2 else "<u2").astype(np.uint32)


def _store(uri: str):
    """File system and path of an address (file:, hdfs:, s3: and what else pyarrow opens)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_records(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Encode every whole text, append ``end_id``, write record files and their index; returns (folder, index).

    Rows are dealt into ranges of the id and sorted within, so file order and ids ascend together; rows that
    share an id follow each other in the order of a text hash, and one id's rows are spread by that hash. A null
    id sorts first; a null text is empty and its record holds only the end id. An empty table gives no files and
    an empty index. A task writes to a file name of its own, and only the files that a finished task put into the
    index count, so a task that runs twice does no harm.
    """
    spark = docs.sparkSession
    folder = (folder or work_path(spark, "records")).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, out = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.records", None
        at = tokens = 0
        try:
            for batch in batches:
                for rows, items in parts(batch):
                    if out is None:
                        store, path = _store(f"{folder}/data")
                        store.create_dir(path)
                        out = store.open_output_stream(f"{path}/{name}")
                    keys, (flat, edge) = rows.column("doc_id"), encoder(vocabulary).encode(items)
                    ids = [np.append(flat[i:j], np.uint32(end_id)) for i, j in zip(edge[:-1], edge[1:], strict=True)]
                    framed = frame([payload(k, x) for k, x in zip(keys.to_pylist(), ids, strict=True)])
                    out.write(b"".join(framed))
                    length, n = np.array([len(x) for x in framed]), np.array([len(x) for x in ids])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(items), part, np.int32)), pa.array([name] * len(items)), keys,
                         pa.array(at + np.cumsum(length) - length), pa.array(length), pa.array(tokens + np.cumsum(n) - n), pa.array(n)],
                        names=["part", "file", "doc_id", "offset", "length", "tokens_before", "n_tokens"])
                    at, tokens = at + int(length.sum()), tokens + int(n.sum())
        finally:
            if out is not None:
                out.close()

    dealt = texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    dealt = dealt.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    dealt.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return folder, read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with ``start``: the tokens of all records before each one, in all files."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    files = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row per file
    return index.join(files, "part").withColumn("start", F.col("base") + F.col("tokens_before")).drop("base")


def dealt_by_bytes(index: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``index`` in as many partitions as its records have bytes / ``task_bytes``, whatever the size of the index itself: stretches of
    neighbouring records of a quarter of that, dealt by hash and in the order of their files. An empty index is one partition;
    repeated rows of the index stay, and are read as often."""
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    stretch = F.floor(F.col("offset") / (task_bytes / 4))
    return index.repartition(-(-total // task_bytes) or 1, "part", stretch).sortWithinPartitions("part", "offset")


def read_records(index: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and token_ids unless told otherwise): the records that ``index``
    names, in its order, each fetched at its offset and checked. Sort the index by anything for a shuffled read; for a whole one
    deal it with ``dealt_by_bytes``, as its splits are sized by the index, not by the records."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(f"{folder}/data")
        name, source = None, None
        for batch in batches:
            files, offset = batch.column("file").to_pylist(), batch.column("offset").to_numpy().tolist()
            length, start = batch.column("length").to_numpy().tolist(), batch.column("start").to_pylist()
            k = 0
            while k < len(files):
                j = k + 1  # a run of neighbours is fetched at once
                while j < len(files) and files[j] == files[k] and offset[j] == offset[j - 1] + length[j - 1] and offset[j] + length[j] - offset[k] <= FETCH:
                    j += 1
                if files[k] != name:
                    if source is not None:
                        source.close()
                    name, source = files[k], store.open_input_file(f"{path}/{files[k]}")
                whole = source.read_at(offset[j - 1] + length[j - 1] - offset[k], offset[k])
                found = [parse(x) for x in unframe([whole[o - offset[k]:o - offset[k] + n] for o, n in zip(offset[k:j], length[k:j], strict=True)])]
                ids = [x for _, x in found]
                columns = [pa.array([i for i, _ in found], pa.int64()), pa.array(start[k:j], pa.int64()),
                           pa.array([len(x) for x in ids], pa.int64()), pa.array([ids_crc(x) for x in ids], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()),
                                                            pa.array(np.concatenate(ids).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "token_ids"][:len(columns)])
                k = j
        if source is not None:
            source.close()

    return index.select("file", "offset", "length", "start").mapInArrow(run, schema)
