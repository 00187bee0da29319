"""Queries for model operators (tx view, learnable label y2) and run tables.

A forest's probabilities are not reproducible across engines, so the queries that
fit one return what must hold whatever the trees are (rows covered, metrics that
follow from counts, ranks that follow from metrics), which SQL can state. Evaluation
also runs with an expression scorer, whose result SQL gives in full.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from rareflow.operators import metrics as M
from rareflow.operators import model as MD
from rareflow.operators import sampling as S
from rareflow.plans.data_queries import SPLIT_CTE
from rareflow.plans.metric_queries import GROUPS_SQL, SWEEP_COLS, sweep_sql
from rareflow.plans.registry import md5_hash_sql, register
from rareflow.plans.views import TX_FEATURES, TX_KEY, TX_SPEC2, TX_SQL, orders_labelled, tx
from rareflow.session import work_path
from rareflow.spec import FeatureSpec

TX_SPLIT_SQL = f"""case when {md5_hash_sql(*TX_KEY, seed=42)} % 100 >= 80 then 'test'
            when {md5_hash_sql(*TX_KEY, seed=43)} % 100 >= 80 then 'validation' else 'train' end"""


def _splits(spark, d):
    """Train, validation and test from one written table: the hash split is computed once for all that a query does with it."""
    path = work_path(spark, "splits")
    S.hash_split(tx(spark, d), TX_KEY).write.partitionBy("split").parquet(path)
    return S.split_frames(spark.read.parquet(path))


def _fit(spark, d, **settings):
    train, val, test = _splits(spark, d)
    return MD.train_forest(train, TX_SPEC2, **settings), (train, val, test)


@register("assemble", "with " + TX_SQL + """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_quantity as f0, l_extendedprice as f1, l_discount as f2, l_tax as f3
from tx""")
def q_assemble(spark, d):
    a = vector_to_array(F.col("features"))
    v = MD.assemble(tx(spark, d), TX_FEATURES)
    return v.select(*TX_KEY, *[a[i].alias(f"f{i}") for i in range(len(TX_FEATURES))])


@register("train_forest", "with " + TX_SQL + f"""
select y2 as label, count(*) as rows, 100 as trees, true as sound from tx where {TX_SPLIT_SQL} = 'train' group by y2""")
def q_train_forest(spark, d):
    """Fit on the train split, then score that split: rows per class, trees, and probabilities that favour the right class."""
    model, (train, _, _) = _fit(spark, d)
    scored = MD.score_table(model, train, TX_SPEC2)
    p, y = F.col("fraud_probability"), F.col("y2")
    return scored.groupBy(y.alias("label")).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(model.stages[1].getNumTrees).alias("trees"),
        (F.every(p.between(0, 1)) & ((F.avg(p) > 0.5) == (F.max(y) == 1))).alias("sound"))


@register("score_table", "with " + TX_SQL + f"""
select l_linenumber, y2, count(*) as rows, count(*) as in_range, sum(l_orderkey::hugeint)::bigint as order_sum
from tx where {TX_SPLIT_SQL} = 'test' group by l_linenumber, y2""")
def q_score_table(spark, d):
    """Every test row is scored once, keeps its key, and has a probability."""
    model, (_, _, test) = _fit(spark, d)
    scored = MD.score_table(model, test, TX_SPEC2, keep=TX_KEY)
    return scored.groupBy("l_linenumber", "y2").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("fraud_probability").between(0, 1)).alias("in_range"),
        F.sum("l_orderkey").cast("bigint").alias("order_sum"))


CANDIDATE_NAMES = ", ".join(f"({i}, '{c['name']}')" for i, c in enumerate(MD.CANDIDATES))


@register("search_candidates", "with " + TX_SQL + f""",
v as (select count(*) filter (where y2 = 1) as positives, count(*) as rows from tx where {TX_SPLIT_SQL} = 'validation')
select c.candidate, c.name, v.positives, v.rows, true as counts_agree, true as f1_agrees, true as rank_agrees
from (values {CANDIDATE_NAMES}) c(candidate, name), v""")
def q_search_candidates(spark, d):
    """Each candidate's counts, F1 and rank beside a recount of the written scores of the validation rows at its threshold."""
    train, val, _ = _splits(spark, d)
    path = work_path(spark, "candidate-scores")
    _, ranked = MD.search_candidates(train, val, TX_SPEC2, scores=path)
    hit, label = F.col("score") >= F.col("threshold"), F.col("y2")
    cells = {"tp": hit & (label == 1), "fp": hit & (label == 0), "fn": ~hit & (label == 1), "tn": ~hit & (label == 0)}
    scores = spark.read.parquet(path).join(F.broadcast(ranked.select("candidate", "threshold")), "candidate")  # six rows
    recount = scores.groupBy("candidate").agg(*[F.count_if(c).alias(f"{n}_again") for n, c in cells.items()], F.count_distinct(*TX_KEY).alias("keys"))
    tp, fp, fn = (F.col(f"{n}_again") for n in ("tp", "fp", "fn"))
    by = [F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0), F.when(tp > 0, tp / (tp + fn)).otherwise(0.0), F.when(tp > 0, tp / (tp + fp)).otherwise(0.0)]
    place = F.row_number().over(Window.orderBy(*[x.desc() for x in by], "candidate"))  # six rows
    both = ranked.join(recount, "candidate").withColumn("place", place)
    agree = [F.col(n) == F.col(f"{n}_again") for n in cells]
    return both.select("candidate", "name", (tp + fn).alias("positives"), "keys", reduce(and_, agree).alias("counts_agree"),
                       (F.abs(F.col("f1") - by[0]) < 1e-12).alias("f1_agrees"), (F.col("rank") == F.col("place")).alias("rank_agrees")).withColumnRenamed("keys", "rows")


@register("evaluate_forest", "with " + TX_SQL + f"""
select count(*) filter (where y2 = 1) as positives, count(*) filter (where y2 = 0) as negatives, true as metrics_agree
from tx where {TX_SPLIT_SQL} = 'test'""")
def q_evaluate_forest(spark, d):
    """Held-out evaluation of a forest: its cells cover the test rows, and its metrics are those of its cells."""
    model, (_, _, test) = _fit(spark, d)
    out = MD.evaluate_model(model, test, TX_SPEC2, 0.5)
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    agree = (F.abs(F.col("precision") * (tp + fp) - tp) < 1e-6) & (F.abs(F.col("recall") * (tp + fn) - tp) < 1e-6) & F.col("auprc").between(0, 1 + 1e-9)
    return out.select((F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"), agree.alias("metrics_agree"))


@register("evaluate_model", "with " + TX_SQL + f""",
te as (select * from tx where {TX_SPLIT_SQL} = 'test'),
g as (select s as score, count(*) filter (where y2 = 1) as p, count(*) filter (where y2 = 0) as n
      from te group by s),
cm as (select coalesce(sum(p) filter (where score >= 0.5), 0)::bigint as tp,
              coalesce(sum(n) filter (where score >= 0.5), 0)::bigint as fp,
              coalesce(sum(p) filter (where score < 0.5), 0)::bigint as fn,
              coalesce(sum(n) filter (where score < 0.5), 0)::bigint as tn from g),
pr as (select *, case when tp + fp > 0 then tp::double / (tp + fp)::double else 0.0::double end as precision,
                 case when tp + fn > 0 then tp::double / (tp + fn)::double else 0.0::double end as recall
       from cm),
cu as (select p, n, sum(p) over w as tp, sum(n) over w as fp, sum(p) over () as pp
       from g window w as (order by score desc rows between unbounded preceding and current row)),
pz as (select p, pp, case when tp + fp > 0 then tp::double / (tp + fp)::double else 0.0::double end as prec,
              case when (tp - p) + (fp - n) > 0 then (tp - p)::double / ((tp - p) + (fp - n))::double end as prev
       from cu)
select tp, fp, fn, tn, precision, recall,
       case when precision + recall > 0 then 2.0::double * precision * recall / (precision + recall)
            else 0.0::double end as f1,
       (select round(sum(p::double * (prec + coalesce(prev, prec)) / 2.0::double / pp::double), 9) from pz) as auprc,
       0.5::double as threshold
from pr""")
def q_evaluate_model(spark, d):
    """Held-out evaluation (validate, score, decide, confusion, metrics, exact AUPRC) of the tx score
    on the test split; the forest path of the same operator is covered by the model tests."""
    _, _, test = _splits(spark, d)
    scorer = MD.ExpressionScorer(F.col("s"), uid="tx-score")
    spec = FeatureSpec((*TX_FEATURES, "s"), "y2", TX_KEY)
    out = MD.evaluate_model(scorer, test, spec, 0.5)
    return out.withColumn("auprc", F.round("auprc", 9))


@register("model_roundtrip", "with " + TX_SQL + f"""
select count(*) as matched, 0::bigint as only_offline, 0::bigint as only_online,
       0::bigint as score_mismatches, 0::bigint as decision_mismatches
from tx where {TX_SPLIT_SQL} = 'test'""")
def q_model_roundtrip(spark, d):
    """Save, load, and score the test split with both: every row equal."""
    from rareflow.streaming.events import score_parity

    model, (_, _, test) = _fit(spark, d)
    path = work_path(spark, "model")
    MD.save_model(model, path)
    loaded = MD.load_model(path, TX_FEATURES)
    key = F.concat_ws(":", *TX_KEY)

    def scored(m):
        s = MD.score_table(m, test, TX_SPEC2, keep=TX_KEY)
        return s.select(key.alias("EventId"), "fraud_probability",
                        (F.col("fraud_probability") >= 0.5).cast("int").alias("final_prediction"))
    return score_parity(scored(model), scored(loaded))


@register("threshold_table", "with " + sweep_sql(GROUPS_SQL) + f""",
best as (select threshold from m order by f1 desc, recall desc, precision desc, threshold desc limit 1)
select {SWEEP_COLS}, threshold in (select threshold from best) as selected,
       tp + fp + fn + tn as validation_rows, 'tx-score' as model_uid,
       '{",".join(TX_FEATURES)}' as feature_columns, 'fraud_probability >= threshold' as comparison,
       'fraud_f1' as objective
from m""")
def q_threshold_table(spark, d):
    sweep = M.sweep_scores(tx(spark, d), "s", "y")
    path = work_path(spark, "threshold-table")
    MD.write_threshold_table(MD.threshold_table(sweep, "tx-score", TX_FEATURES), path)
    MD.load_selected_threshold(spark, path, "tx-score", TX_FEATURES)
    back = spark.read.parquet(path)
    return back.withColumn("feature_columns", F.array_join("feature_columns", ","))


@register("run_registry", f"""with {SPLIT_CTE}
select 'run-1' as run_id, split as name, urgent as label, 'rows' as metric, count(*)::double as value
from sp group by split, urgent""")
def q_run_registry(spark, d):
    """A completed run and a failed run in one registry; readers see the completed one only."""
    path = work_path(spark, "registry")
    counts = S.split_class_counts(S.hash_split(orders_labelled(spark, d), ["o_orderkey"]), "urgent") \
        .withColumnRenamed("split", "name")
    for run, final in (("run-1", "completed"), ("run-2", "failed")):
        MD.append_registry(MD.registry_rows(spark, run, 0, "status", name="running"), path)
        MD.append_registry(MD.registry_rows(spark, run, 1, "split_counts", counts, metric_cols=["n"]), path)
        MD.append_registry(MD.registry_rows(spark, run, 2, "status", name=final), path)
    done = MD.completed_runs(spark, path)
    return done.select("run_id", "name", "label", F.lit("rows").alias("metric"), "value")


PUBLISH_RUN = "producer-run"
PUBLISH_TIME = 1704067200.0


@register("publish_events", "with " + TX_SQL + f""",
te as (select * from tx where {TX_SPLIT_SQL} = 'test'),
r as (select *, row_number() over (order by {md5_hash_sql(*TX_KEY)}, {', '.join(TX_KEY)}) - 1 as idx from te)
select '{PUBLISH_RUN}:' || idx::varchar as key_text, 'transactions' as topic,
       l_quantity, l_extendedprice, l_discount, l_tax, y2::double as Class,
       '{PUBLISH_RUN}:' || idx::varchar as EventId, {PUBLISH_TIME}::double as EventTimestamp
from r""")
def q_publish_events(spark, d):
    """Producer records for the test split: validated, indexed in key-hash order, JSON-encoded;
    the frame ``publish_records`` hands to the Kafka batch writer."""
    from rareflow.operators.ordered import global_row_number
    from rareflow.streaming.events import build_events, event_schema
    from rareflow.streaming.stream import publish_frame

    _, _, test = _splits(spark, d)
    indexed = global_row_number(test, TX_KEY, name="idx").withColumn("idx", F.col("idx") - 1)
    rec = publish_frame(build_events(indexed, TX_FEATURES, "y2", "idx", run_id=PUBLISH_RUN,
                                     ingestion_rate=20.0, event_time=F.lit(PUBLISH_TIME)))
    back = F.from_json(F.col("value").cast("string"), event_schema(TX_FEATURES))
    return rec.select(F.col("key").cast("string").alias("key_text"), "topic",
                      *[back[f].alias(f) for f in TX_FEATURES], back["Class"].alias("Class"),
                      back["EventId"].alias("EventId"), back["EventTimestamp"].alias("EventTimestamp"))
