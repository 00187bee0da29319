"""Splits, balancing, draws and ordered helpers."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rareflow.operators import sampling as S
from rareflow.operators.ordered import global_row_number


def keyed(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 5 == 0).cast("int").alias("y"))


def test_hash_split_cover_disjoint_fractions(spark):
    df = keyed(spark)
    tagged = S.hash_split(df, ["k"])
    train, val, test = S.split_frames(tagged)
    rep = S.split_disjointness(df, {"train": train, "validation": val, "test": test}, ["k"]).first()
    assert rep["overlapping_keys"] == rep["missing_keys"] == rep["extra_keys"] == 0
    n = rep["source_rows"]
    assert abs(rep["train_rows"] / n - 0.64) < 0.035
    assert abs(rep["validation_rows"] / n - 0.16) < 0.035
    assert abs(rep["test_rows"] / n - 0.20) < 0.035


def test_hash_split_stable_under_repartition(spark):
    df = keyed(spark)
    a = {r["k"]: r["split"] for r in S.hash_split(df, ["k"]).collect()}
    b = {r["k"]: r["split"] for r in S.hash_split(df.repartition(7), ["k"]).collect()}
    assert a == b


def test_nested_split_repeatable_and_covering(spark):
    df = keyed(spark).cache()
    parts1 = [sorted(r["k"] for r in p.collect()) for p in S.nested_split(df)]
    parts2 = [sorted(r["k"] for r in p.collect()) for p in S.nested_split(df)]
    assert parts1 == parts2
    allk = sorted(k for p in parts1 for k in p)
    assert allk == list(range(3000))


@pytest.mark.parametrize("levels", [1, 2])
def test_nested_split_of_a_shuffled_frame(spark, levels):
    n = 100_000
    df = spark.range(n).select("id", F.md5(F.col("id").cast("string")).alias("text"), (F.col("id") % 7).alias("v")).repartition("id")
    parts = S.nested_split(df, levels=levels)
    # parts read with different columns: the shuffle below each has other sizes, and is coalesced in another way
    reads = [parts[0].select("id"), *[p.select("id", "text", "v") for p in parts[1:]]]
    ids = [r["id"] for p in reads for r in p.select("id", *[c for c in p.columns if c != "id"]).collect()]
    assert len(ids) == n and len(set(ids)) == n


def test_global_row_number_matches_pandas(spark):
    df = keyed(spark, 5000)
    got = {r["k"]: r["row_number"] for r in global_row_number(df, ["k"], buckets=64).collect()}
    import hashlib
    h = {k: int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) for k in range(5000)}
    order = sorted(range(5000), key=lambda k: (h[k], k))
    assert got == {k: i + 1 for i, k in enumerate(order)}


def test_balance_exact_and_top_k(spark):
    df = keyed(spark)
    bal = S.balance_classes_exact(df, "y", ["k"]).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in bal} == {0: 600, 1: 600}
    top = S.top_k_per_class(df, "y", ["k"], 3).collect()
    assert sorted((r["y"], r["k"]) for r in top) == [(0, 1), (0, 2), (0, 3), (1, 0), (1, 5), (1, 10)]


def test_replicate_sample_take(spark):
    df = keyed(spark, 100)
    assert S.replicate_rows(df, 4).count() == 400
    draws = S.sample_with_replacement(df, ["k"], 250, seed=3)
    assert draws.count() == 250 and draws.select("draw").distinct().count() == 250
    assert sorted(r["k"] for r in S.sequential_take(df, "k", 10).collect()) == list(range(10))
    with pytest.raises(ValueError):
        S.sequential_take(df, "k", 101)


def test_balance_classes_sample(spark):
    df = keyed(spark)
    counts = {r["y"]: r["count"] for r in S.balance_classes(df, "y").groupBy("y").count().collect()}
    assert abs(counts[0] - 600) < 120 and abs(counts[1] - 600) < 120


def test_row_number_limit_keeps_the_first(spark):
    df = keyed(spark, 4000).withColumn("y", F.when(F.col("k") % 7 == 0, None).otherwise(F.col("y")))
    whole = {(r["k"], r["y"]): r["row_number"] for r in global_row_number(df, ["k"], partition_by=["y"], buckets=32).collect()}
    assert len(whole) == 4000  # a null group is a group
    cut = {(r["k"], r["y"]): r["row_number"] for r in global_row_number(df, ["k"], partition_by=["y"], buckets=32, limit=25).collect()}
    assert cut == {k: n for k, n in whole.items() if n <= 25}


def test_fractions_are_exact_or_refused(spark):
    df = keyed(spark, 100)
    for fractions, modulus in (((0.004, 0.2), 100), ((0.2, 0.005), 100), ((0.0, 0.2), 100), ((0.2, 1.0), 100), ((0.1, 0.1), 1 << 30)):
        with pytest.raises(ValueError):
            S.hash_split(df, ["k"], fractions=fractions, modulus=modulus)
    tagged = S.hash_split(keyed(spark, 200_000), ["k"], fractions=(0.004, 0.2), modulus=1000)
    assert abs(tagged.where("split = 'test'").count() / 200_000 - 0.004) < 0.001


def test_draws_reach_beyond_32_bits(spark):
    from rareflow.functions.columns import hash60

    for hasher in ("md5", "xxhash64"):
        n = 1 << 40
        got = [r[0] for r in spark.range(2000).select(hash60("id", seed=7, hasher=hasher) % F.lit(n)).collect()]
        assert max(got) > n * 0.99 and len(set(got)) == 2000 and abs(sum(got) / len(got) / n - 0.5) < 0.03


def test_fast_hasher_paths(spark):
    df = keyed(spark, 3000)
    rn = [r["row_number"] for r in global_row_number(df, ["k"], hasher="xxhash64").collect()]
    assert sorted(rn) == list(range(1, 3001))
    a = {r["k"]: r["split"] for r in S.hash_split(df, ["k"], hasher="xxhash64").collect()}
    b = {r["k"]: r["split"] for r in S.hash_split(df.repartition(5), ["k"], hasher="xxhash64").collect()}
    assert a == b and abs(sum(v == "test" for v in a.values()) / 3000 - 0.2) < 0.035
    bal = S.balance_classes_exact(df, "y", ["k"], hasher="xxhash64").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in bal} == {0: 600, 1: 600}
    assert S.sample_with_replacement(df, ["k"], 500, hasher="xxhash64").count() == 500
    import pytest as _pytest
    with _pytest.raises(ValueError):
        S.hash_split(df, ["k"], hasher="crc")


@pytest.mark.parametrize("k", [1, 6, 40, 700, 100_000])
def test_top_k_of_any_size_with_nulls_strings_and_ties(spark, k):
    df = spark.range(1500).select(
        (F.col("id") % 3).alias("y3"), F.when(F.col("id") % 10 == 0, None).otherwise((F.col("id") % 50).cast("string")).alias("o"), "id")
    df = df.withColumn("y", F.when(F.col("y3") < 2, F.col("y3"))).drop("y3")
    got = S.top_k_per_class(df, "y", ["o"], k).collect()
    w = Window.partitionBy("y").orderBy("o")
    ranks = {r["id"]: (r["y"], r["least"]) for r in df.select("id", "y", F.rank().over(w).alias("least")).collect()}
    for y in (0, 1, None):
        mine = sorted(ranks[r["id"]][1] for r in got if r["y"] == y)
        assert mine == sorted(n for z, n in ranks.values() if z == y)[:k]
    again = S.top_k_per_class(df.repartition(7), "y", ["o"], k).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_sequential_take_of_any_type(spark):
    df = spark.createDataFrame([(f"k{i % 40:02d}", i) for i in range(400)], "k string, v long")
    got = sorted(r["k"] for r in S.sequential_take(df, "k", 25).collect())
    assert got == sorted(f"k{i % 40:02d}" for i in range(400))[:25]
    with pytest.raises(ValueError):
        S.sequential_take(df.withColumn("k", F.lit(None).cast("string")), "k", 1)
