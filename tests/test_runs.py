"""End-to-end: train run with a small search -> tune -> evaluate -> events -> stream -> parity."""

import pytest

from rareflow import runs as R
from rareflow.operators import model as MD
from rareflow.session import work_path
from rareflow.spec import FeatureSpec
from rareflow.streaming import events as E
from rareflow.streaming import stream as ST

from test_validate import FEATURES, frame, rows

SPEC = FeatureSpec(FEATURES, "Class", ("Time",))
SMALL = [dict(name="a", num_trees=4, max_depth=3, min_instances_per_node=1, weighting="none"),
         dict(name="b", num_trees=4, max_depth=3, min_instances_per_node=1, weighting="balanced")]


def test_full_lifecycle(spark):
    base = work_path(spark, "t-run")
    run_dir, registry = f"{base}/run", f"{base}/registry"
    data = frame(spark, rows(600))
    summary = R.train_run(spark, data, SPEC, run_dir, registry, candidates=SMALL, run_id="r1")
    assert 0.0 <= summary["threshold"] <= 1.0 and summary["baseline"]["threshold"] == 0.5
    done = MD.completed_runs(spark, registry)
    assert {r["run_id"] for r in done.collect()} == {"r1"}
    cfg = {r["metric"]: r["value"] for r in done.filter("kind = 'config'").collect()}
    assert cfg["test_seed"] == 42 and cfg["validation_fraction"] == 0.2
    assert done.filter("kind = 'model'").first()["name"] == summary["model_uid"]
    # the three splits cover the cleaned input and are disjoint
    parts = [R.read_split(spark, run_dir, s) for s in ("train", "validation", "test")]
    assert sum(p.count() for p in parts) == 600
    assert parts[0].join(parts[2], "Time").count() == 0

    recorded = {(r["kind"], r["name"], r["metric"]): r["value"] for r in done.collect()}
    assert recorded["rows", "data", "input_rows"] == 600 and recorded["rows", "data", "dropped_rows"] == 0
    assert recorded["candidate_settings", "b", "num_trees"] == 4 and recorded["candidate_settings", "a", "fit_seconds"] > 0
    assert recorded["candidate_settings", "b", "weight_1"] > recorded["candidate_settings", "b", "weight_0"]
    assert [k[2] for k in recorded if k[0] == "fingerprint"] == ["rows"] and [k[1] for k in recorded if k[0] == "chosen"][0] in "ab"

    # a run can be tuned again and again; table and sweep file of a tuning belong together
    for number in (2, 3):
        assert R.tune_run(spark, run_dir, SPEC)["threshold"] == summary["threshold"]
        table = spark.read.parquet(f"{run_dir}/tunings/{number}/thresholds")
        assert table.filter("selected").count() == 1
        assert spark.read.option("header", True).csv(f"{run_dir}/tunings/{number}/sweep_csv").count() == table.count()
    spark.read.parquet(f"{run_dir}/tunings/3/thresholds").limit(0).write.parquet(f"{run_dir}/tunings/4/thresholds")  # broke off
    assert R.load_run_threshold(spark, run_dir, SPEC)[2] == summary["threshold"]
    assert R.tune_run(spark, run_dir, SPEC)["threshold"] == summary["threshold"]

    ev = R.evaluate_run(spark, run_dir, SPEC).first()
    assert ev["tp"] + ev["fp"] + ev["fn"] + ev["tn"] == parts[2].count()
    inc = {r["subset_size"]: r for r in R.evaluate_run_incremental(spark, run_dir, SPEC, [10, 50]).collect()}
    assert inc[10]["rows"] == 10 and inc[50]["rows"] == 50
    assert inc[50]["tp"] + inc[50]["fp"] + inc[50]["fn"] + inc[50]["tn"] == 50
    zero = R.evaluate_run(spark, run_dir, SPEC, threshold=0.0).first()  # an explicit 0 is honoured
    assert zero["threshold"] == 0.0 and zero["fn"] == 0 and zero["tn"] == 0

    # a second run into the same folder fails, is recorded as failed, and leaves the run untouched
    before = sorted(r["Time"] for r in R.read_split(spark, run_dir, "test").collect())
    with pytest.raises(Exception):
        R.train_run(spark, data, SPEC, run_dir, registry, candidates=SMALL, run_id="r2")
    assert {r["run_id"] for r in MD.completed_runs(spark, registry).collect()} == {"r1"}
    assert sorted(r["Time"] for r in R.read_split(spark, run_dir, "test").collect()) == before

    records = R.run_events(spark, run_dir, SPEC, count=30, rate=20.0, run_id="p1")
    assert records.count() == 30
    src = f"{base}/src"
    records.write.parquet(src)
    out = f"{base}/out"
    R.score_stream(spark, run_dir, SPEC, ST.file_source(spark, src), out, source="file")
    R.score_stream(spark, run_dir, SPEC, ST.file_source(spark, src), out, source="file")  # restart: nothing new
    online = ST.read_predictions(spark, out)
    assert online.count() == 30 and online.filter("status = 'scored'").count() == 30
    _, scorer, t = R.load_run_threshold(spark, run_dir, SPEC)
    offline = E.score_events(E.parse_events(spark.read.parquet(src), FEATURES), scorer, FEATURES, t)
    par = E.score_parity(offline, online).first()
    assert par["matched"] == 30 and par["score_mismatches"] == 0 and par["decision_mismatches"] == 0
    with pytest.raises(ValueError, match="other configuration"):
        R.score_stream(spark, run_dir, SPEC, ST.file_source(spark, src), out, source="other")


def test_failed_run_is_refused(spark):
    base = work_path(spark, "t-run-gate")
    R.train_run(spark, frame(spark, rows(300)), SPEC, f"{base}/run", f"{base}/reg", candidates=SMALL[:1], run_id="g")
    MD.append_registry(MD.registry_rows(spark, "g", 99, "status", name="failed"), f"{base}/reg")
    for use in (lambda: R.evaluate_run(spark, f"{base}/run", SPEC), lambda: R.tune_run(spark, f"{base}/run", SPEC),
                lambda: R.run_events(spark, f"{base}/run", SPEC, count=1, rate=1.0), lambda: R.evaluate_run(spark, f"{base}/none", SPEC)):
        with pytest.raises(ValueError, match="failed|no finished"):
            use()


def test_every_split_needs_both_classes(spark):
    base = work_path(spark, "t-run-split")
    data = R.S.hash_split(frame(spark, rows(300)), SPEC.key)
    lacking = data.where("not (split = 'test' and Class = 1)").drop("split")
    with pytest.raises(ValueError, match="test split"):
        R.train_run(spark, lacking, SPEC, f"{base}/run", f"{base}/reg", candidates=SMALL[:1])


def test_failed_run_is_recorded(spark):
    base = work_path(spark, "t-run-fail")
    one_class = frame(spark, [r for r in rows(100) if r[-1] == 0.0])
    with pytest.raises(ValueError):
        R.train_run(spark, one_class, SPEC, f"{base}/run", f"{base}/registry", candidates=SMALL, run_id="bad")
    assert MD.completed_runs(spark, f"{base}/registry").count() == 0
    assert "both classes" in spark.read.parquet(f"{base}/registry").where("kind = 'error'").first()["name"]


def test_sequential_events_and_bad_rate(spark):
    base = work_path(spark, "t-run-ev")
    R.train_run(spark, frame(spark, rows(300)), SPEC, f"{base}/run", f"{base}/reg", candidates=SMALL[:1])
    rec = R.run_events(spark, f"{base}/run", SPEC, count=5, rate=1.0, sequential=True, run_id="s")
    assert sorted(r["key"].decode() for r in rec.collect()) == [f"s:{i}" for i in range(5)]
    with pytest.raises(ValueError):
        R.run_events(spark, f"{base}/run", SPEC, count=5, rate=0.0)
    with pytest.raises(ValueError):
        R.run_events(spark, f"{base}/run", SPEC, count=10 ** 6, rate=1.0, sequential=True)


def test_score_kafka_needs_the_connector(spark):
    base = work_path(spark, "t-run-kafka")
    R.train_run(spark, frame(spark, rows(300)), SPEC, f"{base}/run", f"{base}/reg", candidates=SMALL[:1])
    with pytest.raises(Exception, match="(?i)kafka"):
        R.score_kafka(spark, f"{base}/run", SPEC, "localhost:9092", ["t"], f"{base}/out")


def test_balanced_evaluation_experiment(spark):
    base = work_path(spark, "t-run-exp")
    data = frame(spark, rows(300))
    R.train_run(spark, data, SPEC, f"{base}/run", f"{base}/reg", candidates=SMALL[:1])
    out = R.balanced_evaluation(spark, f"{base}/run", SPEC, data, times=3)
    assert out["rows"] == 900
    # 60 positives x 3 copies: exactly 180 of each class after exact balancing
    assert out["tp"] + out["fn"] == 180 and out["fp"] + out["tn"] == 180
    assert out["balanced_csv"].endswith(".csv")
