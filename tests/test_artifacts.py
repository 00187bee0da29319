"""Model loading by stored class, tree hashes of files, tunings at once, recounted candidates, the random split on a shuffled frame."""

import hashlib
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from rareflow import runs as R
from rareflow.operators import model as MD
from rareflow.operators import sampling as S
from rareflow.session import work_path
from rareflow.sources import files as FS
from rareflow.spec import FeatureSpec
from rareflow.streaming import stream as ST

SPEC = FeatureSpec(("a", "b"), "y", ("id",))


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    return spark.range(400).select("id", (n % 7).cast("double").alias("a"), (n % 5).cast("double").alias("b"), (n % 7 > 4).cast("int").alias("y"))


@pytest.fixture(scope="module")
def forest(rows):
    return MD.train_forest(rows, SPEC, num_trees=3)


def test_each_stored_class_has_its_way(spark, rows, forest):
    base = work_path(spark, "t-load")
    MD.save_model(forest, f"{base}/pipeline")
    forest.stages[1].write().save(f"{base}/bare")
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    other = LogisticRegression(labelCol="y", maxIter=1).fit(vectors)
    other.write().save(f"{base}/other")
    PipelineModel(stages=[forest.stages[0], other]).write().save(f"{base}/odd-pipeline")
    assert MD.saved_class(spark, f"{base}/pipeline").endswith("PipelineModel")
    want = [tuple(r) for r in MD.score_table(forest, rows, SPEC, ["id"]).orderBy("id").collect()]
    for name in ("pipeline", "bare"):
        assert [tuple(r) for r in MD.score_table(MD.load_model(f"{base}/{name}", SPEC.features), rows, SPEC, ["id"]).orderBy("id").collect()] == want
    with pytest.raises(ValueError, match="feature order"):
        MD.load_model(f"{base}/bare")
    with pytest.raises(ValueError, match="LogisticRegressionModel, which can't"):
        MD.load_model(f"{base}/other", SPEC.features)
    with pytest.raises(ValueError, match="pipeline of"):
        MD.load_model(f"{base}/odd-pipeline", SPEC.features)
    with pytest.raises(ValueError, match="holds no saved model"):
        MD.load_model(f"{base}/nothing", SPEC.features)
    for i, text in enumerate(["{broken", json.dumps({"uid": "x"}), ""]):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{base}/bad{i}/metadata")
        with pytest.raises(ValueError, match="names no class"):
            MD.load_model(f"{base}/bad{i}", SPEC.features)


def test_a_loaders_own_error_comes_through(spark, forest):
    path = work_path(spark, "t-load-broken")
    MD.save_model(forest, f"{path}/whole")
    ST.move(spark, f"{path}/whole/metadata", f"{path}/torn/metadata")  # a pipeline without stages
    with pytest.raises(Exception) as error:
        MD.load_model(f"{path}/torn", SPEC.features)
    assert not isinstance(error.value, ValueError)


def plain_tree(data, fan):
    pieces = data.split(b"\n")
    level = [hashlib.sha256(p).digest() for p in (pieces[:-1] if pieces[-1] == b"" else pieces)]
    while True:
        level = [hashlib.sha256(b"".join(level[i:i + fan])).digest() for i in range(0, len(level), fan)]
        if len(level) == 1:
            return hashlib.sha256(f"{len(data)}:".encode() + level[0]).hexdigest()


@pytest.mark.parametrize("split", ["64", "1000", "128m"])
def test_tree_hash_of_files_in_any_splits(spark, tmp_path, monkeypatch, split):
    monkeypatch.setattr(FS, "FAN", 4)
    noise = os.urandom(3000).replace(b"\xef\xbb\xbf", b"abc")
    files = {"noise": noise, "lines": b"one\ntwo\r\n\nthree", "ended": b"one\ntwo\r\n\nthree\n", "empty": b"", "long": b"x" * 5000, "one": b"\n", "two": b"\n\n"}
    for name, data in files.items():
        (tmp_path / f"{name}.bin").write_bytes(data)
    (tmp_path / "other.txt").write_bytes(b"not asked for")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {r.path.rsplit("/", 1)[1].removesuffix(".bin"): (r.length, r.tree_hash) for r in FS.file_tree_hash(spark, f"file://{tmp_path}", "*.bin").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {name: (len(data), plain_tree(data, 4)) for name, data in files.items() if data}
    assert len({h for _, h in got.values()}) == len(files) - 1


def test_numbers_are_claimed_once(spark):
    folder = work_path(spark, "t-claims")
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda _: R.claim_number(spark, folder, 2), range(16)))
    assert sorted(numbers) == list(range(2, 18))


def test_entries_appended_at_once_are_all_there(spark):
    path = work_path(spark, "t-entries")
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: MD.append_registry(MD.registry_rows(spark, f"r{i % 3}", i, "rows", values={"a": i, "b": -i}), path), range(48)))
    found = sorted((r.run_id, r.seq, r.metric, r.value) for r in spark.read.parquet(path).collect())
    assert found == sorted((f"r{i % 3}", i, m, v) for i in range(48) for m, v in (("a", float(i)), ("b", float(-i))))


def test_tunings_at_once_are_all_recorded(spark, rows):
    base = work_path(spark, "t-tunings")
    small = [dict(name="small", num_trees=3, max_depth=3, min_instances_per_node=1, weighting="none")]
    summary = R.train_run(spark, rows, SPEC, f"{base}/run", f"{base}/reg", candidates=small, run_id="r")
    with ThreadPoolExecutor(3) as pool:
        found = list(pool.map(lambda _: R.tune_run(spark, f"{base}/run", SPEC), range(3)))
    assert {f["threshold"] for f in found} == {summary["threshold"]}
    entries = MD.completed_runs(spark, f"{base}/reg").where("kind = 'tuning'").collect()
    assert sorted(e.name for e in entries) == ["1", "2", "3", "4"] and len({e.seq for e in entries}) == 4
    ST.create_new(spark, f"{base}/run/tunings/_claims/5")  # one that broke off
    R.tune_run(spark, f"{base}/run", SPEC)
    assert R.load_run_threshold(spark, f"{base}/run", SPEC)[2] == summary["threshold"]
    names = {e.name for e in MD.completed_runs(spark, f"{base}/reg").where("kind = 'tuning'").collect()}
    assert names == {"1", "2", "3", "4", "6"}
    assert MD.run_status(spark, f"{base}/reg", "r") == "completed"


def test_candidates_scores_are_written(spark, rows):
    path = work_path(spark, "t-scores")
    small = [dict(name=n, num_trees=2, max_depth=d, min_instances_per_node=1, weighting="none") for n, d in (("flat", 1), ("deep", 4))]
    _, ranked = MD.search_candidates(rows.where("id % 4 > 0"), rows.where("id % 4 = 0"), SPEC, small, scores=path)
    scores = spark.read.parquet(path).collect()
    assert len(scores) == 200 and {r.candidate for r in scores} == {0, 1}
    for r in ranked.collect():
        own = [(s.score >= r.threshold, s.y) for s in scores if s.candidate == r.candidate]
        assert (r.tp, r.fp, r.fn, r.tn) == tuple(own.count(k) for k in ((True, 1), (True, 0), (False, 1), (False, 0)))


def test_publishing_to_a_folder_counts_what_it_wrote(spark):
    path = work_path(spark, "t-publish")
    records = spark.range(20).select(F.col("id").cast("string").cast("binary").alias("key"), F.lit("v").cast("binary").alias("value"), F.lit("t").alias("topic"))
    assert ST.publish_records(records, fmt="parquet", path=path) == 20
    assert spark.read.parquet(path).count() == 20


def test_random_split_of_a_shuffled_frame(spark):
    frame = spark.range(5000).select("id", (F.col("id") % 13).alias("k")).repartition("k")
    parts = [{r.id for r in p.select("id").collect()} for p in S.nested_split(frame)]
    assert sum(map(len, parts)) == 5000 and set.union(*parts) == set(range(5000))
