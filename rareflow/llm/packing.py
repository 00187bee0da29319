"""Best-fit packing of documents into sequences of at most ``capacity`` tokens, planned on a length histogram.

The plan is made over counts, not over documents: lengths go from the longest to the shortest, and each time the
fullest open sequences that still have room take as many pieces of that length as there are. Sequences with the
same remaining room and a run of consecutive numbers are one group, so a step moves a whole group or splits one.
The plan is a list of (length, ranks from..to, first sequence, offset); its size depends on the capacity alone.
Pieces are numbered within their length, spread over buckets, and take the planned places by joining on that rank.

Documents that have a position keep it as far as a plan over lengths lets them: the sequences are numbered by the position
of their first piece, and pieces of a length that follow another piece take their places in the order of the sequences.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rareflow.llm.common import ids_crc, kept, partitions, parts, texts
from rareflow.llm.tokens import encoder

#: Rows that one task numbers, on average.
BUCKET_ROWS = 1 << 19


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first rank, offset) runs, ranks from 0: best-fit decreasing.

    All pieces of a run stand at the same offset of consecutive sequences.
    """
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("piece lengths must be from 1 to the capacity")
    out, opened = [], 0
    rooms: list[int] = []  # remaining rooms in use, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, how many)]

    def put(room: int, first: int, many: int) -> None:
        if room:
            if room not in groups:
                rooms.insert(bisect_left(rooms, room), room)
                groups[room] = []
            groups[room].append((first, many))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, many = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
                used = min(many, left)
                if used < many:
                    put(room, first + used, many - used)
            else:  # open sequences, each filled with as many of this length as fit
                room, used = capacity, -(-left // (capacity // length))
                first, opened = opened, opened + used
            out.append((length, rank, rank + used - 1, first, capacity - room))
            put(room - length, first, used)
            rank, left = rank + used, left - used
    return out


def by_place(moves: list[tuple[int, int, int, int, int]]) -> tuple[list[tuple], list[tuple]]:
    """A plan's runs of pieces that begin a sequence, and those of pieces that follow another; ranks from 0 in each kind of a length."""
    out, many = ([], []), (Counter(), Counter())
    for length, first, last, sequence, offset in moves:
        kind = int(offset > 0)
        out[kind].append((length, many[kind][length], many[kind][length] + last - first, sequence, offset))
        many[kind][length] += last - first + 1
    return out


def stride(n: int) -> int:
    """A step with which 0, step, 2 step, ... modulo n meets every number below n once and every range of them evenly."""
    step = max(1, round(min(n, 1 << 20) * 0.618))
    while gcd(step, n) > 1:
        step += 1
    return step


def cut(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text",
        position_col: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a row per piece of a document's ids, the end id included.
    Documents of up to ``capacity`` tokens are one piece; of a longer one every piece is full but the first.
    With ``position_col``, that column comes last as ``position``."""
    named = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long"} | ({"position": "long"} if position_col else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, items in parts(batch):
                flat, edge = encoder(vocabulary).encode(items)
                doc, piece, start, length, crc = [], [], [], [], []
                for i, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                    ids = np.append(flat[lo:hi], np.uint32(end_id)).astype("<u4")
                    at = np.arange(len(ids) % capacity or capacity, len(ids) + 1, capacity).tolist()
                    for k, (x, y) in enumerate(zip([0, *at[:-1]], at, strict=True)):
                        doc.append(i)
                        piece.append(k)
                        start.append(x)
                        length.append(y - x)
                        crc.append(ids_crc(ids[x:y]))
                at = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *([part.column("position").take(at)] if position_col else [])],
                    names=list(named))

    return texts(docs, id_col, text_col, position_col).mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in named.items()))


def ranked(rows: DataFrame, total: int, key: str, order: list[str], span: int | None = None) -> DataFrame:
    """``rows`` with ``rank`` from 0 within ``key``, which may be one value for all: rows are spread over buckets
    by a hash of ``order``, each bucket numbers its own, and the buckets before it are added. With ``span``, ranks
    ascend by ``order``, whose first column is a number from 0 to below ``span`` and is dealt to buckets by range."""
    buckets = max(partitions(rows.sparkSession), total // BUCKET_ROWS + 1)
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets)) if span is None else F.expr(f"`{order[0]}` * {buckets}L div {max(span, 1)}L")
    rows = rows.withColumn("_bucket", bucket.cast("int"))
    sums = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    sums = sums.withColumn("_base", F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1
    return rows.withColumn("_own", own).join(sums, [key, "_bucket"]).withColumn("rank", F.col("_own") + F.col("_base")).drop("_bucket", "_own", "_base")


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece at its place.

    A null or empty text has the end id alone. Repeated rows are packed each; equal lengths are ranked by a hash of
    their row, and rows equal in all columns are interchangeable. An empty table packs to no rows. Only the histogram
    (one count for each length up to ``capacity``) and the plan made from it pass through the driver.
    """
    spark = docs.sparkSession
    parts = kept(cut(docs, vocabulary, end_id, capacity, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    moves = plan(histogram, capacity)
    schema = "length long, first long, last long, first_sequence long, offset long"
    steps = F.broadcast(spark.createDataFrame(moves, schema))  # at most capacity^2 / 2 runs, whatever the input
    places = ranked(parts, sum(histogram.values()), "length", ["doc_id", "piece", "start", "ids_crc32"])
    places = places.join(steps.withColumnRenamed("length", "_length"),
                         (F.col("length") == F.col("_length")) & F.col("rank").between(F.col("first"), F.col("last")))
    return places.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("first_sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def pack_in_order(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text",
                  position_col: str = "position") -> DataFrame:
    """The columns of ``pack``, and the same number of sequences, for documents with a gapless position from 0.

    Sequences are numbered by (position, piece) of their first piece. Of each length, every n-th piece by position begins a
    sequence, as often as the plan has it so, and the others take the places behind another piece in the order of the
    sequences. Lengths that come evenly in the order thus stay near their positions; a length that only comes early is
    still shared out to the sequences that have room for it.
    """
    spark = docs.sparkSession
    parts = kept(cut(docs, vocabulary, end_id, capacity, id_col, text_col, position_col), "pieces")
    found = parts.groupBy("length").agg(F.count("*").alias("n"), F.max("position").alias("top")).collect()
    histogram, span = {r["length"]: r["n"] for r in found}, max((r["top"] for r in found), default=-1) + 1
    begins, follows = by_place(plan(histogram, capacity))
    first = Counter()
    for length, a, b, _, _ in begins:
        first[length] += b - a + 1
    sequences = sum(first.values())

    def planned(rows: DataFrame, runs: list[tuple]) -> DataFrame:
        steps = spark.createDataFrame(runs, "_length long, _first long, _last long, _sequence long, offset long")  # bounded as in pack
        rows = rows.join(F.broadcast(steps), (F.col("length") == F.col("_length")) & F.col("_place").between(F.col("_first"), F.col("_last")))
        return rows.withColumn("_planned", F.col("_sequence") + F.col("_place") - F.col("_first")).drop("_length", "_first", "_last", "_sequence", "_place")

    kinds = spark.createDataFrame([(x, n, first[x], stride(max(first[x], 1))) for x, n in histogram.items()], "length long, _n long, _begin long, _stride long")
    rows = ranked(parts, sum(histogram.values()), "length", ["position", "piece"], span).join(F.broadcast(kinds), "length")  # a row per length
    before = "cast({} as decimal(18, 0)) * cast(_begin as decimal(18, 0))"  # pieces of the length up to this one that begin a sequence
    rows = rows.withColumn("_before", F.expr(f"({before.format('rank')} + _n - 1) div _n")).withColumn("_upto", F.expr(f"({before.format('rank + 1')} + _n - 1) div _n"))
    rows = kept(rows.select(*parts.columns, "rank", "_before", (F.col("_upto") > F.col("_before")).alias("_begins"), "_begin", "_stride"), "ranks")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    heads = planned(rows.where("_begins").withColumn("_place", F.expr("_before * _stride % _begin")).drop("rank"), begins).withColumn("_all", F.lit(0))
    heads = kept(ranked(heads, sequences, "_all", ["position", "piece"], span).withColumnRenamed("rank", "sequence_id").select(*columns, "_planned"), "sequences")

    others = rows.where("not _begins").withColumn("_place", F.expr("rank - _before"))
    places = planned(others.select("length", "_place"), follows).join(heads.select("_planned", "sequence_id"), "_planned")
    places = ranked(places, sum(histogram.values()) - sequences, "length", ["sequence_id", "offset"], sequences).withColumnRenamed("rank", "_place")
    others = others.join(places.select("length", "_place", "sequence_id", "offset"), ["length", "_place"])
    return heads.select(*columns).unionByName(others.select(*columns))
