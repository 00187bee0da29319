"""Order-dependent helpers that stay distributed.

A running sum or a row number over a *global* order is planned by Spark as one window over
``Exchange SinglePartition``: every row through one task. The helpers here cut the order into
buckets first, count per bucket, turn the counts into offsets (one row per bucket), and let a
window *partitioned by bucket* add the rest. There are two kinds of buckets:

- ranges of the order itself (``in_ranges``): Spark's range partitioning deals the rows, so any
  type that can be sorted will do, nulls included; the number of a row's partition is its bucket,
  and it is frozen by writing the table below ``spark.checkpoint.dir``. How many buckets there
  are follows the session's shuffle partitions, and nothing about them passes through the plan;
- equal parts of a hash (``global_row_number``), where the order is that of a hash.

How rows fall into buckets never changes a result, only how the work is spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rareflow.functions.columns import hash32
from rareflow.session import work_path

BUCKET, TIE = "_rf_bucket", "_rf_tie"
LEAST_HASH_BUCKETS = 1 << 14
ROWS_PER_BUCKET = 2_000_000


def buckets_for(rows: int | None) -> int:
    """Hash buckets of about ``ROWS_PER_BUCKET`` rows; many even for small inputs, where they cost nothing."""
    return max(LEAST_HASH_BUCKETS, -(-(rows or 0) // ROWS_PER_BUCKET))


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, to order rows that tie."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("map", "variant"))])


def in_ranges(df: DataFrame, *order: str | Column, observed: tuple | None = None) -> DataFrame:
    """``df`` dealt into ranges of ``order`` (ascending, nulls first) and written; ``_rf_bucket`` ascends with it.

    ``observed`` (an Observation and its aggregates) is computed while the table is written.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(*order).withColumn(BUCKET, F.spark_partition_id())
    if observed:
        dealt = dealt.observe(observed[0], *observed[1])
    path = work_path(spark, "ranges")
    dealt.write.parquet(path)
    return spark.read.parquet(path)


def _offsets(tagged: DataFrame, partition_by: Sequence[str], totals: dict[str, Column], descending: bool) -> DataFrame:
    """Per-bucket exclusive running totals; one row per (partition, bucket)."""
    per_bucket = tagged.groupBy(*partition_by, BUCKET).agg(*[expr.alias(name) for name, expr in totals.items()])
    order = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    before = Window.partitionBy(*partition_by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.select(
        *[F.col(c).alias(f"_rf_of_{c}") for c in [*partition_by, BUCKET]],
        *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_rf_off_{name}") for name in totals])


def _with_offsets(tagged: DataFrame, offsets: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Offsets joined back (a null partition value is a partition); Spark picks the join by the offsets' real size."""
    same = F.col(BUCKET) == F.col(f"_rf_of_{BUCKET}")
    for c in partition_by:
        same = same & F.col(c).eqNullSafe(F.col(f"_rf_of_{c}"))
    return tagged.join(offsets, same)


def prefix_sum(df: DataFrame, order_col: str, sums: dict[str, str], *, descending: bool = True,
               partition_by: Sequence[str] = (), first_of_ties: str | None = None) -> DataFrame:
    """Running (inclusive) sums ``{out: sum(in)}`` in order of ``order_col``, within each ``partition_by`` group.

    ``order_col`` must be unique within a group, unless ``first_of_ties`` names a column: rows that
    tie are then ordered by it and only the first of them stays. A frame from ``in_ranges`` over the same order is used as it is.
    """
    partition_by = list(partition_by)
    tagged = df if BUCKET in df.columns else in_ranges(df, *partition_by, order_col)
    offsets = _offsets(tagged, partition_by, {o: F.sum(i) for o, i in sums.items()}, descending)
    ties = [F.col(first_of_ties)] if first_of_ties else []
    spec = Window.partitionBy(*partition_by, BUCKET).orderBy(F.col(order_col).desc() if descending else F.col(order_col).asc(), *ties)
    running = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _with_offsets(tagged, offsets, partition_by).select(
        *[c for c in tagged.columns if c != BUCKET],
        *[(F.sum(i).over(running) + F.col(f"_rf_off_{o}")).alias(o) for o, i in sums.items()],
        *([F.lag(F.struct(order_col)).over(spec).alias("_rf_before")] if first_of_ties else []))
    if first_of_ties:  # equal values share a bucket, so a tie is seen within it
        out = out.where(~F.col("_rf_before").eqNullSafe(F.struct(order_col))).drop("_rf_before")
    return out


def first_rows(df: DataFrame, order: Sequence[str], count: int, *, partition_by: Sequence[str] = (),
               thin: bool = False) -> DataFrame:
    """The first ``count`` rows by ``order`` (nulls first), of each ``partition_by`` group; rows that tie follow a hash of the
    whole row, so the choice doesn't depend on the layout.

    Ranges that begin after the ``count``-th row are left out before anything else is shuffled. With ``thin``,
    rows are first dealt into portions by that hash and each portion keeps its first ``count`` of a group:
    a small count then moves little (Spark limits each task's share before the shuffle), and none is too large.
    """
    partition_by = list(partition_by)
    columns = df.columns
    rows = df.withColumn(TIE, row_hash(df))
    if thin:
        portions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        share = Window.partitionBy(*partition_by, F.pmod(TIE, F.lit(portions))).orderBy(*order, TIE)
        rows = rows.withColumn("_rf_share", F.row_number().over(share)).where(F.col("_rf_share") <= count).drop("_rf_share")
    tagged = in_ranges(rows, *partition_by, *order, TIE)
    joined = _with_offsets(tagged, _offsets(tagged, partition_by, {"n": F.count(F.lit(1))}, False), partition_by)
    place = F.row_number().over(Window.partitionBy(*partition_by, BUCKET).orderBy(*order, TIE)) + F.col("_rf_off_n")
    joined = joined.where(F.col("_rf_off_n") < count).withColumn("_rf_place", place)
    return joined.where(F.col("_rf_place") <= count).select(*columns)


def global_row_number(df: DataFrame, key: Sequence[str], *, seed: int | str | None = None,
                      partition_by: Sequence[str] = (), name: str = "row_number", buckets: int | None = None,
                      rows: int | None = None, hasher: str = "md5", limit: int | None = None) -> DataFrame:
    """1-based row number in the order ``(hash32(seed, key), key)``, per ``partition_by``.

    Equal to ``row_number() over (partition by p order by md5-prefix(k), k)`` without putting a
    partition's rows into a single task. ``key`` must be unique (within the partition) for the
    number to be deterministic. ``rows`` (the table's row count) sizes the buckets. With ``limit``
    only rows numbered up to it remain, and buckets that begin after it are left out before the
    shuffle. The input is evaluated twice, so it must be deterministic.
    """
    key, partition_by = list(key), list(partition_by)
    buckets = buckets or buckets_for(rows)
    h = "_rf_hash"
    tagged = df.withColumn(h, hash32(*key, seed=seed, hasher=hasher)) \
        .withColumn(BUCKET, F.floor(F.col(h) * F.lit(buckets) / F.lit(float(1 << 32))).cast("int"))
    joined = _with_offsets(tagged, _offsets(tagged, partition_by, {"n": F.count(F.lit(1))}, False), partition_by)
    if limit is not None:
        joined = joined.where(F.col("_rf_off_n") < limit)
    order = Window.partitionBy(*partition_by, BUCKET).orderBy(F.col(h), *[F.col(k) for k in key])
    out = joined.select(*df.columns, (F.row_number().over(order) + F.col("_rf_off_n")).alias(name))
    return out if limit is None else out.where(F.col(name) <= limit)
