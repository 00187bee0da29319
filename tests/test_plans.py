"""Plan-shape checks: no unbounded data through one task, partial aggregation before shuffles."""

import re

from pyspark.sql import functions as F

from rareflow.operators import metrics as M
from rareflow.operators import sampling as S
from rareflow.operators.ordered import global_row_number

from conftest import SF


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def single_partition_inputs(plan: str) -> list[str]:
    """The operator directly below each ``Exchange SinglePartition``."""
    lines = plan.split("\n")
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line and i + 1 < len(lines):
            out.append(re.sub(r"^[\s:+\-*()0-9]+", "", lines[i + 1]))
    return out


def assert_bounded(plan: str):
    for below in single_partition_inputs(plan):
        assert below.startswith("HashAggregate") or below.startswith("ObjectHashAggregate"), below


def static_plan(spark, build) -> str:
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return plan_of(build())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_sweep_window_is_per_bucket(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    s = (F.col("l_quantity") / 50 + F.col("l_discount") * 10) / 2
    plan = static_plan(spark, lambda: M.sweep_scores(li.select(s.alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y")), "s", "y"))
    assert "Exchange hashpartitioning(_rf_bucket" in plan
    assert_bounded(plan)


def test_row_number_and_top_k_plans(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    plan = static_plan(spark, lambda: global_row_number(o, ["o_orderkey"]))
    assert "Exchange hashpartitioning(_rf_bucket" in plan
    assert_bounded(plan)


def test_buckets_beyond_the_limit_go_before_the_shuffle(spark):
    """The filter on the offsets stands below the exchange that feeds the window."""
    o = spark.read.parquet(f"{SF}/orders.parquet")
    for build in (lambda: S.balance_classes_exact(o.withColumn("y", (F.col("o_orderkey") % 9 == 0).cast("int")), "y", ["o_orderkey"]),
                  lambda: S.sequential_take(o, "o_orderkey", 10), lambda: S.top_k_per_class(o, "o_orderstatus", ["o_orderkey"], 3)):
        lines = static_plan(spark, build).split("\n")
        window = next(i for i, x in enumerate(lines) if "Window [row_number()" in x)
        exchange = next(i for i, x in enumerate(lines) if i > window and "Exchange hashpartitioning" in x)
        offset = re.compile(r"Filter.*(_rf_off_n|coalesce\(_w).* < ")  # Spark moves it to where the offsets are made
        assert any(offset.search(x) for x in lines[exchange:]), lines
        assert not any(offset.search(x) for x in lines[window:exchange])


def test_plan_does_not_grow_with_the_cluster(spark):
    groups = spark.createDataFrame([(i / 500, i % 3, 1) for i in range(500)], "score double, positives long, negatives long")
    sizes = set()
    for n in ("8", "512"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            sizes.add(len(re.sub(r"\d+", "", static_plan(spark, lambda: M.threshold_sweep(groups)))) // 200)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(sizes) == 1


def test_score_groups_combine_map_side(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    plan = plan_of(M.score_groups(li, "l_discount", F.lit(1)))
    assert "partial_count" in plan


def test_scan_prunes_columns(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    plan = plan_of(M.confusion_matrix(li, "l_discount", (F.col("l_returnflag") == "R").cast("int"), 0.05))
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", plan).group(1)
    assert schema == "struct<l_discount:double,l_returnflag:string>"
