"""Forest fit, scoring, save/load parity, evaluation conservation, small search."""

import pytest
from pyspark.sql import functions as F

from rareflow.operators import model as MD
from rareflow.spec import FeatureSpec
from rareflow.session import work_path

from test_validate import FEATURES, frame, rows

SPEC = FeatureSpec(FEATURES, "Class")


@pytest.fixture(scope="module")
def fitted(spark):
    return MD.train_forest(frame(spark), SPEC, num_trees=5, max_depth=3)


def test_fit_scores_learnable_rows(spark, fitted):
    scored = MD.score_table(fitted, frame(spark), SPEC)
    assert scored.count() == 256
    ev = MD.evaluate_model(fitted, frame(spark), SPEC, 0.5).first()
    assert ev["tp"] + ev["fp"] + ev["fn"] + ev["tn"] == 256
    assert ev["auprc"] > 0.9 and 0.0 <= ev["f1"] <= 1.0


def test_save_load_same_scores(spark, fitted):
    path = work_path(spark, "t-model")
    MD.save_model(fitted, path)
    loaded = MD.load_model(path, FEATURES)
    a = {r["Time"]: r["fraud_probability"] for r in MD.ModelScorer(fitted).score(frame(spark)).collect()}
    b = {r["Time"]: r["fraud_probability"] for r in MD.ModelScorer(loaded).score(frame(spark)).collect()}
    assert a == b
    with pytest.raises(ValueError):
        MD.load_model(path, list(reversed(FEATURES)))
    with pytest.raises(Exception):
        MD.save_model(fitted, path)


def test_weighted_fit_and_threshold_table(spark, fitted):
    m = MD.train_forest(frame(spark), SPEC, num_trees=3, max_depth=2, weighting="balanced")
    sweep, best = MD.tune_threshold(MD.ModelScorer(m), frame(spark), SPEC)
    path = work_path(spark, "t-thr")
    MD.write_threshold_table(MD.threshold_table(sweep, m.stages[1].uid, FEATURES), path)
    t = MD.load_selected_threshold(spark, path, m.stages[1].uid, FEATURES)
    assert t == best.first()["threshold"]
    with pytest.raises(ValueError):
        MD.load_selected_threshold(spark, path, "other-uid", FEATURES)


def test_search_two_candidates(spark):
    cands = [dict(name="a", num_trees=3, max_depth=2, min_instances_per_node=1, weighting="none"),
             dict(name="b", num_trees=3, max_depth=3, min_instances_per_node=1, weighting="sqrt_balanced")]
    data = frame(spark, rows(400))
    model, ranked = MD.search_candidates(data.filter(F.col("Time") < 3000), data.filter(F.col("Time") >= 3000),
                                         SPEC, cands)
    assert ranked.count() == 2 and sorted(r["rank"] for r in ranked.collect()) == [1, 2]
    assert MD.ModelScorer(model).uid


def test_run_registry_reads_completed_only(spark):
    path = work_path(spark, "t-reg")
    counts = spark.createDataFrame([("train", 0, 10), ("train", 1, 2)], "name string, label int, n bigint")
    for run, final in (("r1", "completed"), ("r2", "failed"), ("r3", None)):
        MD.append_registry(MD.registry_rows(spark, run, 0, "status", name="running"), path)
        MD.append_registry(MD.registry_rows(spark, run, 1, "counts", counts, metric_cols=["n"]), path)
        if final:
            MD.append_registry(MD.registry_rows(spark, run, 2, "status", name=final), path)
    got = MD.completed_runs(spark, path).collect()
    assert {r["run_id"] for r in got} == {"r1"} and len(got) == 2


def test_assemble_embeddings(spark):
    from pyspark.ml.functions import vector_to_array

    from conftest import SF

    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    v = MD.assemble(emb, ["label", "embedding"]).select("vec_id", "label", "embedding",
                                                         vector_to_array("features").alias("a"))
    r = v.first()
    assert len(r["a"]) == 65 and r["a"][0] == r["label"]
    assert all(abs(x - y) < 1e-6 for x, y in zip(r["a"][1:], r["embedding"]))


def test_model_layout_checks(spark, fitted):
    from pyspark.ml import PipelineModel

    assembler, forest = fitted.stages
    with pytest.raises(ValueError, match="VectorAssembler"):
        MD.ModelScorer(PipelineModel(stages=[forest]))
    with pytest.raises(ValueError, match="VectorAssembler"):
        MD.ModelScorer(PipelineModel(stages=[forest, assembler]))
    short = assembler.copy()
    short.setInputCols(FEATURES[:-1])
    with pytest.raises(ValueError, match="feature count"):
        MD.ModelScorer(PipelineModel(stages=[short, forest]))
    with pytest.raises(ValueError, match="feature order"):
        MD.ModelScorer(fitted, ["V1", "Time"] + FEATURES[2:])


def test_scorer_refuses_output_clash(spark, fitted):
    df = frame(spark).withColumn("probability", F.lit(1.0))
    with pytest.raises(ValueError, match="output columns"):
        MD.ModelScorer(fitted).score(df)


def test_scoring_after_observe_in_same_session(spark):
    """A sweep (which observes its guard report) followed by a fresh fit and scoring."""
    from rareflow.operators import metrics as M

    M.sweep_scores(spark.createDataFrame([(0.2, 1), (0.7, 0), (0.9, 1)], "s double, y int"), "s", "y").collect()
    m = MD.train_forest(frame(spark), SPEC, num_trees=2, max_depth=2)
    assert MD.score_table(m, frame(spark), SPEC).count() == 256
    raw = MD.RandomForestClassifier(labelCol="Class", featuresCol="features", numTrees=2, maxDepth=2).fit(
        MD.assemble(frame(spark), FEATURES))
    assert raw.hasSummary
    pipe = MD.PipelineModel(stages=[MD.VectorAssembler(inputCols=FEATURES, outputCol="features"), raw])
    assert MD.ModelScorer(pipe).score(frame(spark)).count() == 256


def test_load_bare_forest_with_feature_order(spark, fitted):
    path = work_path(spark, "t-bare")
    fitted.stages[1].write().save(path)
    wrapped = MD.load_model(path, FEATURES)
    a = {r["Time"]: r["fraud_probability"] for r in MD.ModelScorer(fitted).score(frame(spark)).collect()}
    b = {r["Time"]: r["fraud_probability"] for r in MD.ModelScorer(wrapped).score(frame(spark)).collect()}
    assert a == b
    with pytest.raises(ValueError, match="feature order"):
        MD.load_model(path)


def test_search_same_result_sequential_and_concurrent(spark):
    cands = [dict(name=f"c{i}", num_trees=3, max_depth=2 + i % 2, min_instances_per_node=1,
                  weighting=("none", "balanced", "sqrt_balanced")[i % 3]) for i in range(4)]
    data = frame(spark, rows(400))
    train, val = data.filter(F.col("Time") < 3000), data.filter(F.col("Time") >= 3000)
    one = sorted(tuple(r) for r in MD.search_candidates(train, val, SPEC, cands, concurrency=1)[1].collect())
    many = sorted(tuple(r) for r in MD.search_candidates(train, val, SPEC, cands, concurrency=4)[1].collect())
    assert one == many


def test_same_forest_from_any_layout(spark):
    def trees(df):
        return MD.train_forest(df, SPEC, num_trees=3, max_depth=3, weighting="balanced").stages[1].toDebugString.split("\n", 1)[1]

    assert trees(frame(spark).repartition(5)) == trees(frame(spark).coalesce(1).orderBy(F.desc("V3")))


def test_two_selected_thresholds_are_refused(spark):
    path = work_path(spark, "t-two")
    sweep = spark.createDataFrame([(t, 1, 1, 1, 1, 0.5, 0.5, 0.5, True, "m", ["a"]) for t in (0.3, 0.7)],
                                  "threshold double, tp long, fp long, fn long, tn long, precision double, recall double, f1 double, "
                                  "selected boolean, model_uid string, feature_columns array<string>")
    sweep.write.parquet(path)
    with pytest.raises(ValueError, match="more than one"):
        MD.load_selected_threshold(spark, path, "m", ["a"])


def test_a_fit_reads_its_dealt_rows_from_disk_and_lets_them_go(spark, monkeypatch):
    seen, fit = [], MD.fit_forest
    monkeypatch.setattr(MD, "fit_forest", lambda vectors, *a: seen.append((vectors, vectors.storageLevel.useDisk)) or fit(vectors, *a))
    MD.train_forest(frame(spark), SPEC, num_trees=2, max_depth=2)
    assert seen[0][1] and not seen[0][0].storageLevel.useDisk
