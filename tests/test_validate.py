"""Validation matrix, cleaning and class weights."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rareflow.operators import validate as V
from rareflow.spec import FeatureSpec

FEATURES = ["Time"] + [f"V{i}" for i in range(1, 29)] + ["Amount"]
SPEC = FeatureSpec(FEATURES, "Class")


def rows(n=256):
    """Seeded random transactions: a fifth of them, those with the largest risk, are positive; V7 and Amount follow the risk."""
    r = random.Random(n)
    risk = [r.random() for _ in range(n)]
    cut = sorted(risk, reverse=True)[-(-n // 5) - 1]
    out = []
    for t, x in enumerate(risk):
        values = {f: r.gauss(0, 1) for f in FEATURES} | {"Time": 10.0 * t, "V7": 4 * x + r.gauss(0, 0.01), "Amount": 20 + 300 * x * x}
        out.append((*[values[f] for f in FEATURES], float(x >= cut)))
    return out


def frame(spark, data=None):
    schema = ", ".join(f"{c} double" for c in FEATURES + ["Class"])
    return spark.createDataFrame(data if data is not None else rows(), schema)


def test_valid_table(spark):
    rep = V.assert_valid(frame(spark), SPEC)
    assert rep["rows"] == 256 and rep["positives"] == 52 and rep["negatives"] == 204


@pytest.mark.parametrize("mutate", [
    lambda df: df.drop("Amount"),
    lambda df: df.withColumn("V1", F.col("V1").cast("string")),
    lambda df: df.withColumn("Class", F.col("Class").cast("string")),
])
def test_schema_rejections(spark, mutate):
    with pytest.raises(ValueError):
        V.assert_valid(mutate(frame(spark)), SPEC)


@pytest.mark.parametrize("value", [None, float("nan"), float("inf"), float("-inf")])
def test_bad_feature_values(spark, value):
    data = rows()
    data[3] = data[3][:4] + (value,) + data[3][5:]
    with pytest.raises(ValueError, match="missing/non-finite"):
        V.assert_valid(frame(spark, data), SPEC)


@pytest.mark.parametrize("label", [2.0, 0.5, None])
def test_bad_labels(spark, label):
    data = rows()
    data[7] = data[7][:-1] + (label,)
    with pytest.raises(ValueError):
        V.assert_valid(frame(spark, data), SPEC)


def test_no_rows_and_one_class(spark):
    with pytest.raises(ValueError, match="both classes"):
        V.assert_valid(frame(spark, []), SPEC)
    with pytest.raises(ValueError, match="both classes"):
        V.assert_valid(frame(spark, [r for r in rows() if r[-1] == 0.0]), SPEC)


def test_cleaning_drops_null_and_nan_only(spark):
    data = rows()
    data[1] = (None,) + data[1][1:]
    data[2] = data[2][:3] + (float("nan"),) + data[2][4:]
    acc = V.row_accounting(frame(spark, data), SPEC).first()
    assert (acc["input_rows"], acc["valid_rows"], acc["dropped_rows"]) == (256, 254, 2)
    assert V.clean_rows(frame(spark, data), SPEC).count() == 254
    data[5] = data[5][:3] + (float("inf"),) + data[5][4:]
    with pytest.raises(ValueError):
        V.clean_rows(frame(spark, data), SPEC)
    data = rows()
    data[9] = data[9][:-1] + (2.0,)
    with pytest.raises(ValueError):
        V.clean_rows(frame(spark, data), SPEC)


def test_class_weights():
    counts = {0: 900, 1: 100}
    assert V.training_class_weights(counts, "none") == {0: 1.0, 1: 1.0}
    b = V.training_class_weights(counts, "balanced")
    assert math.isclose(b[0], 5 / 9) and math.isclose(b[1], 5.0)
    s = V.training_class_weights(counts, "sqrt_balanced")
    assert math.isclose(s[0], math.sqrt(5 / 9)) and math.isclose(s[1], math.sqrt(5))


@pytest.mark.parametrize("counts", [{}, {0: 7}, {1: 7}, {0: 7, 1: 0}, {0: 3, 1: 4, 2: 1}])
def test_weights_need_both_classes_and_no_other(counts):
    for mode in V.WEIGHTINGS:
        with pytest.raises(ValueError, match="training split"):
            V.training_class_weights(counts, mode)


def test_weights_of_both_forms_agree(spark):
    df = spark.createDataFrame([(0,)] * 37 + [(1,)] * 5, "y int")
    by = {r["label"]: r for r in V.class_weights(df, "y").collect()}
    for mode in V.WEIGHTINGS:
        plain = V.training_class_weights({0: 37, 1: 5}, mode)
        assert all(math.isclose(plain[y], by[y][f"weight_{mode}"]) for y in (0, 1))


def test_unknown_weighting():
    with pytest.raises(ValueError):
        V.training_class_weights({0: 9, 1: 1}, "cubic")


def test_class_weights_frame(spark):
    df = spark.createDataFrame([(0,)] * 900 + [(1,)] * 100, "y int")
    got = {r["label"]: r for r in V.class_weights(df, "y").collect()}
    assert math.isclose(got[0]["weight_balanced"], 5 / 9) and math.isclose(got[1]["weight_balanced"], 5.0)
    assert math.isclose(got[1]["weight_sqrt_balanced"], math.sqrt(5))


def test_feature_order_check():
    with pytest.raises(ValueError):
        SPEC.check_order(["V1", "Time"] + FEATURES[2:])
    with pytest.raises(ValueError):
        FeatureSpec(["a", "a"], "y")


def test_cluster_conf_scales_with_input():
    from rareflow.session import cluster_conf

    small = cluster_conf(10 << 30, 8, "hdfs:///ckpt")
    big = cluster_conf(100 << 40, 8000, "hdfs:///ckpt")
    assert int(small["spark.sql.shuffle.partitions"]) == 40
    assert int(big["spark.sql.shuffle.partitions"]) == 200_000
    assert big["spark.checkpoint.dir"] == "hdfs:///ckpt"


def test_class_presence_guard_in_plan(spark):
    ok = V.class_presence(spark.createDataFrame([(0,), (1,), (1,)], "y int"), "y").first()
    assert (ok["positives"], ok["negatives"], ok["both_classes"]) == (2, 1, True)
    with pytest.raises(Exception, match="both classes"):
        V.class_presence(spark.createDataFrame([(1,), (1,)], "y int"), "y").collect()


def test_feature_spec_rejects_bad_definitions():
    with pytest.raises(ValueError):
        FeatureSpec(["a"], "")
    with pytest.raises(ValueError):
        FeatureSpec(["a", "b"], "b")
    with pytest.raises(ValueError):
        FeatureSpec(["a"], "y", key=("k", "k"))
    assert FeatureSpec(["a", "b"], "y", key=("a", "id")).with_key() == ["a", "id", "b", "y"]
