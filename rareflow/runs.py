"""End-to-end flows over a run folder, composed from the operators.

``train_run``   clean -> stable split -> splits written -> candidate search on train/validation
                (test never scored) -> model, threshold table, sweep file, registry entries.
``tune_run``    re-sweep the saved validation split for the saved model; new threshold table.
``evaluate_run`` held-out metrics of the saved model on the test split at the saved threshold.
``score_stream`` start the scoring stream of Kafka-shaped records into a bound, checkpointed sink.
``publish_run`` the test split as events (sequential or seeded draws) to Kafka.

All folders are below ``run_dir`` (a shared file system path on a cluster); the registry is an
append-only Parquet table; whoever reads a run checks there that its latest status is ``completed``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rareflow.operators import metrics as M
from rareflow.operators import model as MD
from rareflow.operators.ordered import global_row_number
from rareflow.operators import sampling as S
from rareflow.operators import validate as V
from rareflow.sources import files as FS
from rareflow.spec import FeatureSpec
from rareflow.streaming import events as E
from rareflow.streaming import stream as ST


def _paths(run_dir: str) -> dict:
    r = run_dir.rstrip("/")
    return {k: f"{r}/{k}" for k in ("splits", "model", "tunings", "candidates", "about")}


def read_split(spark: SparkSession, run_dir: str, name: str) -> DataFrame:
    """One split of a run (partition pruning reads only that folder)."""
    if name not in S.SPLITS:
        raise ValueError(f"unknown split {name}")
    return spark.read.parquet(_paths(run_dir)["splits"]).filter(F.col("split") == name).drop("split")


class _Record:
    """Appends a run's entries to the registry, numbered in the order they come."""

    def __init__(self, spark: SparkSession, registry: str, run_id: str, seq: int = 0):
        self.spark, self.registry, self.run_id, self.seq = spark, registry, run_id, seq

    def __call__(self, kind: str, rows: DataFrame | None = None, **about) -> None:
        MD.append_registry(MD.registry_rows(self.spark, self.run_id, self.seq, kind, rows, **about), self.registry)
        self.seq += 1


def train_run(spark: SparkSession, data: DataFrame, spec: FeatureSpec, run_dir: str, registry: str, *,
              candidates=MD.CANDIDATES, search: bool = True, run_id: str | None = None,
              hasher: str = "md5") -> dict:
    """Train, tune on validation only, and persist a complete run; failures are recorded as such.

    The registry gets the data's fingerprint and row accounting, the split's settings and class counts, each
    candidate's settings, class weights, fit seconds and results, the one chosen, the model, and the status.
    """
    if not spec.key:
        raise ValueError("a key is required for a stable split")
    p = _paths(run_dir)
    record = _Record(spark, registry, run_id or uuid.uuid4().hex[:12])
    record("status", name="running")
    try:
        prints = FS.table_fingerprint(data, spec.with_key()).first()
        record("fingerprint", name=f"{prints['hash_one']}:{prints['hash_two']}", values={"rows": prints["rows"]})
        record("rows", name="data", values=V.row_accounting(data, spec).first().asDict())
        cleaned = V.clean_rows(data, spec, "Cleaned dataset")
        # one pass writes all three splits (partitioned by split); refuses to overwrite a run
        S.hash_split(cleaned, spec.key, hasher=hasher).write.partitionBy("split").mode("errorifexists").parquet(p["splits"])
        train, val = read_split(spark, run_dir, "train"), read_split(spark, run_dir, "validation")
        counts = S.split_class_counts(spark.read.parquet(p["splits"]), spec.label).withColumnRenamed("split", "name")
        record("split_counts", counts, metric_cols=["n"])
        known = {(r["name"], int(r["label"])): int(r["n"]) for r in counts.collect()}  # six rows at most
        for split in S.SPLITS:
            V.require_both_classes_counts({y: known.get((split, y), 0) for y in (0, 1)}, f"the {split} split")
        record("config", name="split", values={
            "test_seed": S.TEST_SEED, "validation_seed": S.VALIDATION_SEED, "test_fraction": S.TEST_FRACTION,
            "validation_fraction": S.VALIDATION_FRACTION, "model_seed": MD.MODEL_SEED})
        chosen, seconds = (list(candidates) if search else list(candidates)[:1]), {}
        of_train = {y: known["train", y] for y in (0, 1)}
        model, ranked = MD.search_candidates(train, val, spec, chosen, counts=of_train, seconds=seconds)
        ranked.write.parquet(p["candidates"])
        for c in chosen:
            weights = V.training_class_weights(of_train, c["weighting"])
            record("candidate_settings", name=c["name"], values={
                **{k: v for k, v in c.items() if k not in ("name", "weighting")}, "weight_0": weights[0], "weight_1": weights[1],
                "fit_seconds": seconds[c["name"]]})
        record("candidates", ranked, metric_cols=["threshold", "precision", "recall", "f1", "rank"])
        record("chosen", name=ranked.where("rank = 1").first()["name"])
        MD.save_model(model, p["model"])
        record("model", name=model.stages[1].uid)
        spark.createDataFrame([(record.run_id, registry)], "run_id string, registry string").coalesce(1).write.parquet(p["about"])
        summary = _tune(spark, model, val, spec, p, record)
        record("status", name="completed")
        return dict(run_id=record.run_id, **summary)
    except Exception as error:
        record("error", name=f"{type(error).__name__}: {error}"[:2000])
        record("status", name="failed")
        raise


def _tune(spark, model, validation, spec, p, record: _Record, number: int = 1) -> dict:
    """Write the threshold table and the sweep file of one tuning to a folder of their own; the registry
    entry that makes readers use them comes last."""
    scorer, folder = MD.ModelScorer(model, spec.features), f"{p['tunings']}/{number}"
    sweep, _ = MD.tune_threshold(scorer, validation, spec, validate=False)
    MD.write_threshold_table(MD.threshold_table(sweep, scorer.uid, spec.features), f"{folder}/thresholds")
    stored = spark.read.parquet(f"{folder}/thresholds")
    FS.write_sweep(stored.select(*M.SWEEP_COLUMNS), f"{folder}/sweep_csv")
    selected = stored.filter("selected").first()
    base = stored.filter(F.col("threshold") == 0.5).first()
    record("tuning", name=str(number), values={"threshold": selected["threshold"]})
    return dict(model_uid=scorer.uid, threshold=selected["threshold"], selected=selected.asDict(),
                baseline=base.asDict() if base else None)


def _entries(spark: SparkSession, run_dir: str) -> tuple[str, str, DataFrame]:
    """(run id, registry, entries) of a run that is completed; anything else is refused."""
    p = _paths(run_dir)
    if not ST.path_exists(spark, p["about"]):
        raise ValueError(f"{run_dir} holds no finished training run")
    about = spark.read.parquet(p["about"]).first()
    status = MD.run_status(spark, about["registry"], about["run_id"])
    if status != "completed":
        raise ValueError(f"run {about['run_id']} is {status or 'not recorded'}, not completed")
    entries = MD.completed_runs(spark, about["registry"]).where(F.col("run_id") == about["run_id"])
    return about["run_id"], about["registry"], entries


def _last_tuning(entries: DataFrame) -> tuple[int, int]:
    """Number of the last tuning and the number of its registry entry."""
    row = entries.where("kind = 'tuning'").agg(F.max(F.col("name").cast("int")).alias("n"), F.max("seq").alias("seq")).first()
    return row["n"], row["seq"]


def claim_number(spark: SparkSession, folder: str, least: int) -> int:
    """The smallest free number from ``least`` on, which is the caller's alone: each number is an empty file that only one can create, and whoever finds
    it there tries the next."""
    number = least
    while ST.path_exists(spark, f"{folder}/{number}") or not ST.create_new(spark, f"{folder}/_claims/{number}"):
        number += 1
    return number


def tune_run(spark: SparkSession, run_dir: str, spec: FeatureSpec) -> dict:
    """Re-select the threshold of a completed run from its saved validation split, any number of times, also at once. Each
    tuning claims a number, writes a folder of its own, and is seen by readers once its registry entry is there: they use the table and the
    sweep of the highest number recorded. A tuning that breaks off leaves its number unused."""
    run_id, registry, entries = _entries(spark, run_dir)
    p = _paths(run_dir)
    number = claim_number(spark, p["tunings"], _last_tuning(entries)[0] + 1)
    first = entries.where("kind = 'tuning'").agg(F.min("seq")).first()[0]  # that of the training, which the final status follows
    record = _Record(spark, registry, run_id, first + number)
    return _tune(spark, MD.load_model(p["model"], spec.features), read_split(spark, run_dir, "validation"), spec, p, record, number)


def load_run_threshold(spark: SparkSession, run_dir: str, spec: FeatureSpec) -> tuple:
    """(model, scorer, threshold) of a completed run whose model and feature order are those it recorded."""
    _, _, entries = _entries(spark, run_dir)
    p = _paths(run_dir)
    model = MD.load_model(p["model"], spec.features)
    scorer = MD.ModelScorer(model, spec.features)
    recorded = entries.where("kind = 'model'").agg(F.max_by("name", "seq").alias("uid")).first()["uid"]
    if recorded != scorer.uid:
        raise ValueError(f"the model in {run_dir} is {scorer.uid}; the run recorded {recorded}")
    table = f"{p['tunings']}/{_last_tuning(entries)[0]}/thresholds"
    return model, scorer, MD.load_selected_threshold(spark, table, scorer.uid, spec.features)


def evaluate_run(spark: SparkSession, run_dir: str, spec: FeatureSpec, threshold: float | None = None) -> DataFrame:
    """Held-out test metrics (confusion, precision, recall, F1, exact AUPRC) of a run."""
    model, _, saved = load_run_threshold(spark, run_dir, spec)
    t = saved if threshold is None else threshold
    return MD.evaluate_model(model, read_split(spark, run_dir, "test"), spec, t)


def evaluate_run_incremental(spark: SparkSession, run_dir: str, spec: FeatureSpec, sizes,
                             threshold: float | None = None) -> DataFrame:
    """Metrics and exact AUPRC of a run's model on growing subsets of its test split (key-hash order)."""
    model, scorer, saved = load_run_threshold(spark, run_dir, spec)
    t = saved if threshold is None else threshold
    test = read_split(spark, run_dir, "test")
    scored = scorer.score(test.select(*spec.with_key()))
    return M.incremental_evaluation(scored, MD.PROBABILITY, spec.label, spec.key, sizes, t)


def balanced_evaluation(spark: SparkSession, run_dir: str, spec: FeatureSpec, data: DataFrame, *,
                        times: int = 1, version: int = 1, exact: bool = True, seed: int = 42,
                        threshold: float | None = None) -> dict:
    """Scale-up experiment: replicate the data ``times`` times, write it, balance the classes,
    keep the balanced set as a versioned CSV, and evaluate the run's model on it.

    Replication is an ``explode`` (no n-fold union); balancing is exact by key hash (or
    Bernoulli with ``exact=False``); every intermediate is a table in the run folder.
    """
    model, _, saved = load_run_threshold(spark, run_dir, spec)
    base = f"{run_dir.rstrip('/')}/experiments/v{int(version)}"
    big = S.replicate_rows(data.select(*spec.with_key()), times, copy_col="copy")
    big.write.mode("errorifexists").parquet(f"{base}/replicated")
    big = spark.read.parquet(f"{base}/replicated")
    key = [*spec.key, "copy"]
    balanced = (S.balance_classes_exact(big, spec.label, key, seed=seed) if exact
                else S.balance_classes(big, spec.label, seed=seed, shuffle=False))
    path = FS.write_csv_versioned(balanced, f"{base}/balanced", version)
    balanced = FS.read_csv(spark, path, big.schema)
    metrics = MD.evaluate_model(model, balanced, spec, saved if threshold is None else threshold).first()
    return dict(rows=big.count(), balanced_csv=path, **metrics.asDict())


def score_stream(spark: SparkSession, run_dir: str, spec: FeatureSpec, records: DataFrame, output_dir: str, *,
                 keep=(), available_now: bool = True, trigger_seconds: float = 2.0, source: str = ""):
    """Score a stream of Kafka-shaped records with a run's model and threshold into a bound sink."""
    _, scorer, t = load_run_threshold(spark, run_dir, spec)
    scored = E.score_events(E.parse_events(records, spec.features), scorer, spec.features, t, keep=keep)
    conf = {"schema_version": 1, "source": source, "run_dir": run_dir, "model_uid": scorer.uid,
            "feature_columns": list(spec.features), "threshold": t, "output_dir": output_dir}
    return ST.sink_predictions(scored, output_dir, available_now=available_now,
                               trigger_seconds=trigger_seconds, configuration=conf)


def score_kafka(spark: SparkSession, run_dir: str, spec: FeatureSpec, bootstrap_servers: str, topics,
                output_dir: str, *, starting_offsets: str = "earliest", max_offsets_per_trigger: int = 10000,
                available_now: bool = False, trigger_seconds: float = 2.0, keep=()):
    """The online scorer: Kafka topics -> parse -> score with the run's model and threshold -> bound sink.

    Needs the Kafka connector on the classpath. Restarting with the same output folder resumes
    from its checkpoint; ``startingOffsets`` applies to the first start only.
    """
    records = ST.kafka_source(spark, bootstrap_servers=bootstrap_servers, topics=topics,
                              starting_offsets=starting_offsets, max_offsets_per_trigger=max_offsets_per_trigger)
    source = f"kafka:{bootstrap_servers}/{','.join(topics) if not isinstance(topics, str) else topics}"
    return score_stream(spark, run_dir, spec, records, output_dir, keep=keep, available_now=available_now,
                        trigger_seconds=trigger_seconds, source=source)


def run_events(spark: SparkSession, run_dir: str, spec: FeatureSpec, *, count: int, rate: float,
               sequential: bool = False, seed: int = 42, run_id: str | None = None,
               topic: str = "transactions") -> DataFrame:
    """Kafka records for ``count`` events drawn from a run's test split (sequential or seeded)."""
    if not rate > 0 or rate != rate or rate == float("inf"):
        raise ValueError(f"{rate} is no rate: it must be a number above 0")
    _entries(spark, run_dir)
    test = read_split(spark, run_dir, "test")
    rows = V.assert_valid(test, spec, "Producer test data", require_both_classes=False)["rows"]
    if not rows:
        raise ValueError("Test dataset is empty")
    key = list(spec.key)
    if sequential:
        if count > rows:
            raise ValueError(f"{count} events in sequence need as many rows; the test split has {rows}")
        ranked = test.select(*spec.with_key())
        picked = global_row_number(ranked, key, name="_i", rows=rows, limit=count).withColumn("draw", F.col("_i") - 1)
    else:
        picked = S.sample_with_replacement(test.select(*spec.with_key()), key, count, seed,
                                           rows=rows)
    rid = run_id or uuid.uuid4().hex
    return E.build_events(picked, spec.features, spec.label, "draw", run_id=rid, ingestion_rate=rate,
                          topic=topic)


def publish_run(spark: SparkSession, run_dir: str, spec: FeatureSpec, bootstrap_servers: str, **kw) -> int:
    """Publish a run's events to Kafka (needs the Kafka connector); returns the records written."""
    return ST.publish_records(run_events(spark, run_dir, spec, **kw), bootstrap_servers)
