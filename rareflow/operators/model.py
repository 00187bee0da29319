"""Model operators on Spark ML: assemble, fit a weighted Random Forest, score,
search candidates, evaluate, and keep thresholds and runs as Parquet tables.

Scorers share one interface (``uid``, ``score(df)`` adding
``fraud_probability``) so batch tables and event streams are scored by the
same code, whether the score comes from a fitted pipeline or an expression.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rareflow.functions.columns import check_threshold
from rareflow.operators import forest as FO
from rareflow.operators import metrics as M
from rareflow.operators.validate import assert_valid, counts_dict, training_class_weights
from rareflow.spec import FeatureSpec
from rareflow.streaming import stream as ST

PROBABILITY = "fraud_probability"

# The candidate search (name, trees, depth, min rows per leaf, class weighting).
CANDIDATES = (
    dict(name="baseline", num_trees=100, max_depth=5, min_instances_per_node=1, weighting="none"),
    dict(name="deeper", num_trees=100, max_depth=8, min_instances_per_node=1, weighting="none"),
    dict(name="larger_leaves", num_trees=100, max_depth=8, min_instances_per_node=5, weighting="none"),
    dict(name="more_trees", num_trees=200, max_depth=8, min_instances_per_node=5, weighting="none"),
    dict(name="balanced", num_trees=100, max_depth=8, min_instances_per_node=5, weighting="balanced"),
    dict(name="sqrt_balanced", num_trees=100, max_depth=8, min_instances_per_node=5, weighting="sqrt_balanced"),
)
MODEL_SEED = 42


@dataclass
class ExpressionScorer:
    """Score = a built-in column expression (deterministic, SQL-checkable)."""
    expression: Column | str
    uid: str = "expression-scorer"

    def score(self, df: DataFrame) -> DataFrame:
        e = F.expr(self.expression) if isinstance(self.expression, str) else self.expression
        return df.withColumn(PROBABILITY, e.cast("double"))


class ModelScorer:
    """Score with a fitted pipeline of exactly (VectorAssembler, RandomForest)."""

    def __init__(self, model: PipelineModel, features: Sequence[str] | None = None):
        self.assembler, self.classifier = model_layout(model)
        if features is not None:
            FeatureSpec(tuple(features)).check_order(self.assembler.getInputCols())
        # a copy without the training summary that computes only the probability column
        # (Spark ML skips outputs whose column name is empty)
        forest = without_summary(self.classifier)
        forest.setRawPredictionCol("").setPredictionCol("")
        self.classifier = forest
        self.model = PipelineModel(stages=[self.assembler, forest])
        self.features = list(self.assembler.getInputCols())
        self.uid = self.classifier.uid

    def score(self, df: DataFrame) -> DataFrame:
        c = self.classifier
        produced = [self.assembler.getOutputCol(), c.getProbabilityCol()]
        clash = [p for p in produced if p in df.columns]
        if clash:
            raise ValueError(f"input already has model output columns {clash}")
        out = self.model.transform(df)
        return out.withColumn(PROBABILITY, vector_to_array(c.getProbabilityCol())[1]).drop(*produced)


def without_summary(forest: RandomForestClassificationModel) -> RandomForestClassificationModel:
    """The same forest (same uid and trees) without its training summary.

    A freshly fitted model keeps a summary that references the session; once the
    session has used ``observe``, every task closure that captures such a model fails
    to serialize (the session's observation manager is not serializable). Scoring
    never needs the summary.
    """
    return forest.copy()


def model_layout(model) -> tuple[VectorAssembler, RandomForestClassificationModel]:
    """Exactly assembler + binary forest, assembler output feeding the forest."""
    stages = getattr(model, "stages", None)
    if not stages or len(stages) != 2 or not isinstance(stages[0], VectorAssembler) \
            or not isinstance(stages[1], RandomForestClassificationModel):
        raise ValueError("model must be a pipeline of VectorAssembler and RandomForestClassificationModel")
    assembler, forest = stages
    if assembler.getOutputCol() != forest.getFeaturesCol():
        raise ValueError("assembler output is not the forest's features column")
    if forest.numClasses != 2:
        raise ValueError("model must be a binary classifier")
    if forest.numFeatures != len(assembler.getInputCols()):
        raise ValueError("feature count differs from the assembler inputs")
    return assembler, forest


def assemble(df: DataFrame, features: Sequence[str], out: str = "features",
             handle_invalid: str = "error") -> DataFrame:
    """Features in order into one vector; numeric array columns (e.g. embeddings) are expanded
    in place through ``array_to_vector``."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql.types import ArrayType

    arrays = [f for f in features if isinstance(df.schema[f].dataType, ArrayType)]
    src = df
    for f in arrays:
        src = src.withColumn(f"_rf_vec_{f}", array_to_vector(F.col(f)))
    cols = [f"_rf_vec_{f}" if f in arrays else f for f in features]
    out_df = VectorAssembler(inputCols=cols, outputCol=out, handleInvalid=handle_invalid).transform(src)
    return out_df.drop(*[f"_rf_vec_{f}" for f in arrays])


def fit_input(rows: DataFrame, spec: FeatureSpec) -> tuple[DataFrame, list[list[float]]]:
    """The counted cells of all rows, in a layout that only the rows decide, and the thresholds between the bins of each feature."""
    cells, cuts = FO.count_cells(rows, spec.features, spec.label)
    return FO.deal(cells), cuts


def assembler_for(spec: FeatureSpec) -> VectorAssembler:
    return VectorAssembler(inputCols=list(spec.features), outputCol="features")


def fit_forest(cells: DataFrame, cuts: list[list[float]], label: str, counts: dict, settings: dict, seed: int) -> RandomForestClassificationModel:
    """One forest on the cells of ``fit_input``, with ``settings`` as in ``CANDIDATES``."""
    weights = training_class_weights(counts, settings.get("weighting", "none"))
    forest = RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed, numTrees=settings["num_trees"],
                                    maxDepth=settings["max_depth"], minInstancesPerNode=settings["min_instances_per_node"])
    if len(set(weights.values())) > 1:
        forest = forest.setWeightCol("class_weight")
    return FO.grow(cells, cuts, forest, weights)


def train_forest(train: DataFrame, spec: FeatureSpec, *, seed: int = MODEL_SEED, counts: dict | None = None,
                 validate: bool = True, **settings) -> PipelineModel:
    """Assembler and a binary forest fitted on a table; ``settings`` override those of the baseline candidate.

    The same rows and seed give the same forest on any cluster and from any file layout.
    """
    if counts is None and validate:
        report = assert_valid(train, spec, "Training data")
        counts = {0: int(report["negatives"]), 1: int(report["positives"])}
    counts = counts or counts_dict(train, spec.label)
    chosen = {**{k: v for k, v in CANDIDATES[0].items() if k != "name"}, **settings}
    cells, cuts = fit_input(train, spec)
    cells = cells.persist(StorageLevel.DISK_ONLY)  # read once for each level
    try:
        forest = fit_forest(cells, cuts, spec.label, counts, chosen, seed)
    finally:
        cells.unpersist()
    return PipelineModel(stages=[assembler_for(spec), forest])


def score_table(model: PipelineModel, df: DataFrame, spec: FeatureSpec, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., label, fraud_probability) in the model's stored feature order."""
    scorer = ModelScorer(model, spec.features)
    return scorer.score(df.select(*keep, *spec.features, spec.label)).select(*keep, spec.label, PROBABILITY)


def save_model(model: PipelineModel, path: str) -> None:
    """Write a new model; refuses to overwrite."""
    model.write().save(path)


def saved_class(spark: SparkSession, path: str) -> str:
    """The class that a saved model's metadata names; an error if there is no metadata, or none that names a class."""
    try:
        lines = spark.read.text(f"{path.rstrip('/')}/metadata").select(F.get_json_object("value", "$.class").alias("name")).limit(2).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"{path} holds no saved model") from None
    if len(lines) != 1 or not lines[0]["name"]:
        raise ValueError(f"the metadata of {path} names no class")
    return lines[0]["name"]


def _bare_forest(path: str, features: Sequence[str] | None) -> PipelineModel:
    if features is None:
        raise ValueError("a bare forest needs its feature order to be scored")
    forest = RandomForestClassificationModel.load(path)
    return PipelineModel(stages=[VectorAssembler(inputCols=list(features), outputCol=forest.getFeaturesCol()), forest])


#: How each class that a metadata file may name is loaded.
LOADERS = {
    "org.apache.spark.ml.PipelineModel": lambda path, features: PipelineModel.load(path),
    "pyspark.ml.pipeline.PipelineModel": lambda path, features: PipelineModel.load(path),
    "org.apache.spark.ml.classification.RandomForestClassificationModel": _bare_forest,
}


def load_model(path: str, features: Sequence[str] | None = None) -> PipelineModel:
    """Load a saved model by the class in its metadata, which is read before any loader runs: a pipeline (assembler + forest) as it is,
    a bare forest of an older run with an assembler over ``features``, which must then be given in training order. Any other
    class, missing or malformed metadata, and a pipeline of another layout are errors; so are those of the loader itself."""
    name = saved_class(SparkSession.active(), path)
    if name not in LOADERS:
        raise ValueError(f"{path} holds a {name}, which can't score rows here")
    model = LOADERS[name](path, features)
    ModelScorer(model, features)
    return model


def evaluate_model(model_or_scorer, test: DataFrame, spec: FeatureSpec, threshold: float = 0.5) -> DataFrame:
    """Held-out evaluation: validate, score, decide, confusion, metrics, exact AUPRC.

    Scores are reduced to score groups once (written to the work folder, with the guard
    report observed during the write), from which both the confusion at ``threshold`` and
    the threshold-free AUPRC are computed.
    """
    t = check_threshold(threshold)
    assert_valid(test, spec, "Test data")
    scorer = model_or_scorer if hasattr(model_or_scorer, "score") else ModelScorer(model_or_scorer, spec.features)
    scored = scorer.score(test.select(*spec.features, spec.label))
    groups, totals = M.dealt_groups(M.score_groups(scored, PROBABILITY, spec.label))
    s = F.col("score")
    confusion = groups.agg(
        F.coalesce(F.sum(F.when(s >= t, F.col("positives"))), F.lit(0)).cast("bigint").alias("tp"),
        F.coalesce(F.sum(F.when(s >= t, F.col("negatives"))), F.lit(0)).cast("bigint").alias("fp"),
        F.coalesce(F.sum(F.when(s < t, F.col("positives"))), F.lit(0)).cast("bigint").alias("fn"),
        F.coalesce(F.sum(F.when(s < t, F.col("negatives"))), F.lit(0)).cast("bigint").alias("tn"))
    metrics = M.classification_metrics(confusion)
    area = M.auprc_dealt(groups, totals).first()["auprc"]
    return metrics.withColumn("auprc", F.lit(area)).withColumn("threshold", F.lit(t))


def tune_threshold(scorer, validation: DataFrame, spec: FeatureSpec, *, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Sweep of validation scores and its selected row."""
    if validate:
        assert_valid(validation, spec, "Validation data")
    scored = scorer.score(validation.select(*spec.features, spec.label))
    sweep = M.sweep_scores(scored, PROBABILITY, spec.label)
    return sweep, M.select_threshold(sweep)


def search_candidates(train: DataFrame, validation: DataFrame, spec: FeatureSpec, candidates: Sequence[dict] = CANDIDATES,
                      seed: int = MODEL_SEED, concurrency: int = 3, counts: dict | None = None, seconds: dict | None = None, scores: str | None = None):
    """Fit each candidate on train, tune its threshold on validation only, rank.

    Returns (best model, ranked results DataFrame with one row per candidate). The training rows are binned and counted
    once for all fits, up to ``concurrency`` of which run at the same time (each is seeded). All
    forests then score the validation rows in one pass, and one sweep, split by candidate, tunes all thresholds. With ``counts``
    ({label: rows} of train) both splits count as validated; ``seconds`` receives the time of each fit by name. With ``scores``, a new folder, each validation row's
    score by each candidate (key, label, candidate, score) is written there, and the sweep reads it back.
    """
    from concurrent.futures import ThreadPoolExecutor

    if counts is None:
        report = assert_valid(train, spec, "Training data")
        assert_valid(validation, spec, "Validation data")
        counts = {0: int(report["negatives"]), 1: int(report["positives"])}
    cells, cuts = fit_input(train, spec)
    cells = cells.persist(StorageLevel.DISK_ONLY)  # read once for each level of each fit

    def timed(candidate: dict) -> RandomForestClassificationModel:
        began = time.monotonic()
        forest = fit_forest(cells, cuts, spec.label, counts, candidate, seed)
        if seconds is not None:
            seconds[candidate["name"]] = time.monotonic() - began
        return forest

    try:
        with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
            forests = list(pool.map(timed, candidates))
    finally:
        cells.unpersist()
    models = [PipelineModel(stages=[assembler_for(spec), f]) for f in forests]
    keys = list(spec.key) if scores else []
    scored = validation.select(*dict.fromkeys([*keys, *spec.features, spec.label]))
    for i, model in enumerate(models):
        scored = ModelScorer(model, spec.features).score(scored).withColumnRenamed(PROBABILITY, f"_rf_p{i}")
    stacked = scored.select(*keys, spec.label, F.posexplode(F.array(*[F.col(f"_rf_p{i}") for i in range(len(models))])).alias("candidate", "score"))
    if scores:
        stacked.write.parquet(scores)
        stacked = stacked.sparkSession.read.schema(stacked.schema).parquet(scores)
    groups = stacked.groupBy("candidate", "score").agg(F.count_if(F.col(spec.label) == 1).alias("positives"), F.count_if(F.col(spec.label) == 0).alias("negatives"))
    best = M.select_threshold(M.threshold_sweep(groups, partition_by="candidate", unique_scores=True), partition_by=["candidate"])
    names = F.array(*[F.lit(c["name"]) for c in candidates])
    rows = best.select("candidate", names[F.col("candidate")].alias("name"), *M.SWEEP_COLUMNS).collect()  # one for each candidate
    ranked = M.rank_candidates(train.sparkSession.createDataFrame(rows, best.select("candidate", F.lit("").alias("name"), *M.SWEEP_COLUMNS).schema), "candidate")
    return models[ranked.where("rank = 1").first()["candidate"]], ranked


# --- threshold table -------------------------------------------------------------

def threshold_table(sweep: DataFrame, model_uid: str, features: Sequence[str]) -> DataFrame:
    """Sweep rows + ``selected`` flag, bound to a model uid and a feature order."""
    best = M.select_threshold(sweep).select(F.col("threshold").alias("_best"))
    flagged = sweep.join(F.broadcast(best), how="left",
                         on=sweep["threshold"] == best["_best"])  # one-row side
    return flagged.select(
        *sweep.columns, F.col("_best").isNotNull().alias("selected"),
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("validation_rows"),
        F.lit(model_uid).alias("model_uid"),
        F.array(*[F.lit(f) for f in features]).alias("feature_columns"),
        F.lit("fraud_probability >= threshold").alias("comparison"),
        F.lit("fraud_f1").alias("objective"))


def write_threshold_table(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    table.write.mode(mode).parquet(path)


def load_selected_threshold(spark: SparkSession, path: str, model_uid: str, features: Sequence[str]) -> float:
    """The one selected threshold for this model and feature order; an error if there is none, or more than one."""
    t = spark.read.parquet(path)
    feats = F.array(*[F.lit(f) for f in features])
    rows = t.filter(F.col("selected") & (F.col("model_uid") == model_uid)
                    & (F.col("feature_columns") == feats)).select("threshold").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{'no' if not rows else 'more than one'} threshold is selected for this model and feature order; tune it again")
    return check_threshold(rows[0]["threshold"])


# --- run registry ----------------------------------------------------------------

REGISTRY_SCHEMA = ("run_id string, seq int, recorded_at timestamp, kind string, name string, "
                   "label int, metric string, value double")


def registry_rows(spark: SparkSession, run_id: str, seq: int, kind: str, rows: DataFrame | None = None,
                  name: str | None = None, metric_cols: Sequence[str] = (), values: dict | None = None) -> DataFrame:
    """Registry entries: a status row (``rows`` None), one row per named value (``values``, e.g.
    seeds and fractions), or one row per (row, metric) of a metrics frame."""
    if values is not None:
        return spark.createDataFrame([(run_id, seq, None, kind, name, None, m, float(v)) for m, v in values.items()],
                                     REGISTRY_SCHEMA).withColumn("recorded_at", F.current_timestamp())
    if rows is None:
        return spark.createDataFrame([(run_id, seq, None, kind, name, None, None, None)], REGISTRY_SCHEMA) \
            .withColumn("recorded_at", F.current_timestamp())
    stacked = rows.select(
        F.col("name").cast("string").alias("name") if "name" in rows.columns else F.lit(name).alias("name"),
        F.col("label").cast("int").alias("label") if "label" in rows.columns else F.lit(None).cast("int")
        .alias("label"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                            for m in metric_cols])).alias("m"))
    return stacked.select(F.lit(run_id).alias("run_id"), F.lit(seq).alias("seq"),
                          F.current_timestamp().alias("recorded_at"), F.lit(kind).alias("kind"),
                          "name", "label", "m.metric", "m.value")


def append_registry(entries: DataFrame, path: str) -> None:
    """Add entries, also at once with others: each writes a hidden folder of its own, whose files are moved when whole. Jobs that append to one folder
    share the folder of their temporary files, and the first to end removes it."""
    staged = f"{path.rstrip('/')}/_entries-{uuid.uuid4().hex}"
    entries.write.parquet(staged)
    ST.move_parts(entries.sparkSession, staged, path)


def run_status(spark: SparkSession, path: str, run_id: str) -> str | None:
    """The latest status of a run, or None if the registry has none."""
    row = spark.read.parquet(path).where((F.col("kind") == "status") & (F.col("run_id") == run_id)) \
        .agg(F.max_by("name", F.struct("seq", "recorded_at")).alias("status")).first()
    return row["status"]


def completed_runs(spark: SparkSession, path: str) -> DataFrame:
    """Entries of runs whose latest status is ``completed`` (max_by over the status rows)."""
    reg = spark.read.parquet(path)
    latest = reg.filter(F.col("kind") == "status").groupBy("run_id") \
        .agg(F.max_by("name", F.struct("seq", "recorded_at")).alias("status"))
    done = latest.filter(F.col("status") == "completed").select("run_id")
    return reg.filter(F.col("kind") != "status").join(done, "run_id", "left_semi")
