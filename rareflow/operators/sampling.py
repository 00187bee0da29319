"""Splits, balancing, replication, draws and top-k.

Reproducible variants order rows by a key hash (``hash32``), which does not
move when the input is repartitioned; ``randomSplit``/``sampleBy`` variants
keep Bernoulli semantics where approximate sizes are fine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareflow.functions.columns import hash32, hash60
from rareflow.operators.ordered import first_rows, global_row_number
from rareflow.operators.validate import counts_dict, require_both_classes_counts
from rareflow.session import work_path

# Split seeds and held-out fractions (test first, then validation).
TEST_SEED, VALIDATION_SEED = 42, 43
TEST_FRACTION, VALIDATION_FRACTION = 0.2, 0.2
SPLITS = ("train", "validation", "test")


def hash_split(df: DataFrame, key: Sequence[str], *, seeds: tuple[int, int] = (TEST_SEED, VALIDATION_SEED),
               fractions: tuple[float, float] = (TEST_FRACTION, VALIDATION_FRACTION),
               modulus: int = 100, out: str = "split", hasher: str = "md5") -> DataFrame:
    """Stable nested split: test if ``h(seed0, k) % m >= m(1-f0)``, else validation by seed1, else train.

    A fraction must be a whole number of ``1 / modulus`` parts; finer ones need a larger ``modulus``.
    """
    parts = [f * modulus for f in fractions]
    if any(abs(x - round(x)) > 1e-6 or not 0 < round(x) < modulus for x in parts) or modulus > 1 << 24:
        raise ValueError(f"fractions {fractions} are not whole parts of 1/{modulus}; choose another modulus (up to 2^24)")
    t_cut, v_cut = (modulus - round(x) for x in parts)
    h_test = hash32(*key, seed=seeds[0], hasher=hasher) % modulus
    h_val = hash32(*key, seed=seeds[1], hasher=hasher) % modulus
    return df.withColumn(out, F.when(h_test >= t_cut, F.lit("test"))
                         .when(h_val >= v_cut, F.lit("validation")).otherwise(F.lit("train")))


def split_frames(tagged: DataFrame, col: str = "split") -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(tagged.filter(F.col(col) == s).drop(col) for s in SPLITS)


def nested_split(df: DataFrame, *, seeds: tuple[int, int] = (TEST_SEED, VALIDATION_SEED),
                 fractions: tuple[float, float] = (TEST_FRACTION, VALIDATION_FRACTION),
                 levels: int = 2) -> tuple[DataFrame, ...]:
    """Random split, 80/20 by one seed, then 80/20 of the first part by another.

    Returns (train, validation, test), or (train, test) with ``levels=1``. The rows are tagged by seeded draws
    and written once as Parquet below ``spark.checkpoint.dir``; the parts are filters of that table, so each row
    is in exactly one of them, whatever the layout of the input. Which one does depend on the layout; use
    ``hash_split`` where rows must stay put.
    """
    tagged = random_tags(df, seeds=seeds, fractions=fractions, levels=levels)
    path = work_path(df.sparkSession, "random-split")
    tagged.write.parquet(path)
    tagged = df.sparkSession.read.schema(tagged.schema).parquet(path)
    names = SPLITS if levels > 1 else (SPLITS[0], SPLITS[2])
    return tuple(tagged.where(F.col("split") == s).drop("split") for s in names)


def random_tags(df: DataFrame, *, seeds: tuple[int, int] = (TEST_SEED, VALIDATION_SEED),
                fractions: tuple[float, float] = (TEST_FRACTION, VALIDATION_FRACTION), levels: int = 2,
                out: str = "split") -> DataFrame:
    """``df`` with the part of each row in one pass. A frame that is read again draws again, and by another layout otherwise."""
    inner = F.when(F.rand(seeds[1]) < fractions[1], F.lit("validation")).otherwise(F.lit("train")) if levels > 1 else F.lit("train")
    return df.withColumn(out, F.when(F.rand(seeds[0]) < fractions[0], F.lit("test")).otherwise(inner))


def tag_splits(train: DataFrame, validation: DataFrame, test: DataFrame, out: str = "split") -> DataFrame:
    return train.withColumn(out, F.lit("train")).unionByName(validation.withColumn(out, F.lit("validation"))) \
        .unionByName(test.withColumn(out, F.lit("test")))


def split_class_counts(tagged: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Rows per (split, class) in one aggregate."""
    return tagged.groupBy(split, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def split_disjointness(source: DataFrame, parts: dict[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """Cover and disjointness of splits in one shuffle: group the tagged union by key.

    Reports rows per part, keys found in more than one part, source keys in no
    part, and part keys not in the source (all 0 for a correct split).
    """
    names = list(parts)
    tagged = source.select(*key, F.lit("_source").alias("_part"))
    for n, p in parts.items():
        tagged = tagged.unionByName(p.select(*key, F.lit(n).alias("_part")))
    per_key = tagged.groupBy(*key).agg(
        *[F.count_if(F.col("_part") == n).alias(n) for n in ["_source", *names]])
    in_parts = sum((F.col(n) for n in names), F.lit(0))
    return per_key.agg(
        F.sum("_source").cast("bigint").alias("source_rows"),
        *[F.sum(n).cast("bigint").alias(f"{n}_rows") for n in names],
        F.count_if(in_parts > 1).alias("overlapping_keys"),
        F.count_if((F.col("_source") > 0) & (in_parts == 0)).alias("missing_keys"),
        F.count_if((F.col("_source") == 0) & (in_parts > 0)).alias("extra_keys"))


def shuffle_rows(df: DataFrame, seed: int = 42) -> DataFrame:
    """Random row order: rows go to partitions by a seeded hash of the row and are sorted by it inside each partition (one hash shuffle; as many
    partitions as the session's, or as AQE makes of them). The hash is the row's own, so a partition that is computed again after a
    lost executor gets the same rows; equal rows stand next to each other."""
    r = "_rf_rand"
    hashed = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("map", "variant"))])
    return df.withColumn(r, hashed).repartition(r).sortWithinPartitions(r).drop(r)


def balance_classes(df: DataFrame, label: str, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """Bernoulli down-sampling of each class to the minority size (``sampleBy``); sizes are approximate."""
    counts = counts_dict(df, label)
    require_both_classes_counts(counts, "data")
    m = min(counts.values())
    out = df.sampleBy(label, {k: m / c for k, c in counts.items()}, seed)
    return shuffle_rows(out, seed) if shuffle else out


def balance_classes_exact(df: DataFrame, label: str, key: Sequence[str], seed: int = 42,
                          hasher: str = "md5") -> DataFrame:
    """Exactly ``min(count)`` rows per class: the smallest key hashes of each class."""
    counts = counts_dict(df, label)
    require_both_classes_counts(counts, "data")
    m = min(counts.values())
    ranked = global_row_number(df, key, seed=seed, partition_by=[label], name="_rn",
                               rows=max(counts.values()), hasher=hasher, limit=m)
    return ranked.drop("_rn")


def replicate_rows(df: DataFrame, times: int, copy_col: str | None = None) -> DataFrame:
    """The table repeated ``times`` times (bag union), without n scans or a join."""
    if times < 1:
        raise ValueError("times must be >= 1")
    c = copy_col or "_rf_copy"
    out = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias(c))
    return out if copy_col else out.drop(c)


def sample_with_replacement(df: DataFrame, key: Sequence[str], count: int, seed: int = 42,
                            rows: int | None = None, hasher: str = "md5") -> DataFrame:
    """``count`` seeded draws with replacement: draw i takes row ``h60(seed, i) % n + 1`` (a 60-bit hash,
    so every row of any table can be drawn, and all alike).

    Rows are numbered in key-hash order (distributed), draws come from
    ``spark.range`` (distributed) and meet the rows in an equi-join.
    """
    if count <= 0:
        raise ValueError(f"{count} rows can't be taken: ask for one at least")
    n = rows if rows is not None else df.count()
    if n == 0:
        raise ValueError("there are no rows to draw from")
    ranked = global_row_number(df, key, name="_rn", rows=n, hasher=hasher)
    draws = df.sparkSession.range(count).select(
        F.col("id").alias("draw"), (hash60("id", seed=seed, hasher=hasher) % F.lit(n) + 1).alias("_rn"))
    return draws.join(ranked, "_rn").drop("_rn")


def sequential_take(df: DataFrame, order_col: str, count: int) -> DataFrame:
    """First ``count`` rows in ``order_col`` order, of any type that can be sorted; error if fewer rows exist
    or the column has nulls. Rows that tie follow a hash of the whole row. No single task sees all rows.
    """
    if count <= 0:
        raise ValueError(f"{count} rows can't be taken: ask for one at least")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count(order_col).alias("nonnull")).first()
    if row["nonnull"] != row["n"]:
        raise ValueError(f"{order_col} has nulls; sequential order needs a non-null column")
    if count > row["n"]:
        raise ValueError(f"{count} rows were asked for, and there are {row['n']}")
    return first_rows(df, [order_col], count)


def random_row(df: DataFrame, seed: int = 42) -> DataFrame:
    """One random row (top-1 per partition, then of those: no full sort)."""
    return df.orderBy(F.rand(seed)).limit(1)


def top_k_per_class(df: DataFrame, label: str, order: Sequence[str], k: int) -> DataFrame:
    """First ``k`` rows of each class (null is one) by ``order``, nulls first, ties by a hash of the whole row.

    One way for every ``k``: portions of each class keep their first ``k`` rows, for which Spark plans a
    partial ``WindowGroupLimit`` before the shuffle, and positions among those come from ranges of the order.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    return first_rows(df, order, k, partition_by=[label], thin=True)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def union_by_name(*frames: DataFrame, allow_missing: bool = False) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out
