"""Queries for score groups, the threshold sweep and evaluation metrics (tx view)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rareflow.functions.columns import decision
from rareflow.operators import metrics as M
from rareflow.plans.registry import md5_hash_sql, register
from rareflow.plans.views import TX_KEY, TX_SQL, table, tx

# The candidate scores of the ranking query, in order.
CANDIDATE_SCORES = (
    "(l_quantity / 50 + l_discount * 10) / 2",
    "l_quantity / 50",
    "abs(l_discount) * 10",
    "(l_quantity / 50 + l_tax * 12.5) / 2",
)

GROUPS_SQL = TX_SQL + """,
g as (select s as score, count(*) filter (where y = 1) as positives,
             count(*) filter (where y = 0) as negatives
      from tx group by s)"""


def sweep_sql(groups_cte: str, part: str | None = None) -> str:
    """CTEs ``m`` (the sweep) after a CTE ``g(part?, score, positives, negatives)``."""
    p = f"{part}, " if part else ""
    pby = f"partition by {part} " if part else ""
    extras = "(values (0.0::double), (0.5::double), (1.0::double)) v(x)"
    if part:
        points = f"select {part}, score from g union select {part}, x from (select distinct {part} from g) cross join {extras}"
        using = f"using ({part}, score)"
    else:
        points = f"select score from g union select x from {extras}"
        using = "using (score)"
    return groups_cte + f""",
pts as ({points}),
gg as (select {p}score, coalesce(g.positives, 0) as p, coalesce(g.negatives, 0) as n
       from pts left join g {using}),
cu as (select {p}score,
              sum(p) over (w rows between unbounded preceding and current row) as tp,
              sum(n) over (w rows between unbounded preceding and current row) as fp,
              sum(p) over (partition by {part or 'true'}) as pp,
              sum(n) over (partition by {part or 'true'}) as nn
       from gg window w as ({pby}order by score desc)),
m as (select {p}score as threshold, tp::bigint as tp, fp::bigint as fp,
             (pp - tp)::bigint as fn, (nn - fp)::bigint as tn,
             case when tp + fp > 0 then tp::double / (tp + fp)::double else 0.0::double end as precision,
             tp::double / pp::double as recall,
             case when 2 * tp + fp + (pp - tp) > 0
                  then (2 * tp)::double / (2 * tp + fp + (pp - tp))::double else 0.0::double end as f1
       from cu)"""


SWEEP_SQL = "with " + sweep_sql(GROUPS_SQL)
SWEEP_COLS = "threshold, tp, fp, fn, tn, precision, recall, f1"


def _groups(spark, d):
    return M.score_groups(tx(spark, d), "s", "y")


def _sweep(spark, d):
    return M.sweep_scores(tx(spark, d), "s", "y")


@register("scan_parquet", "select * from orders")
def q_scan_parquet(spark, d):
    return table(spark, d, "orders")


@register("score_groups", "with " + GROUPS_SQL + " select score, positives, negatives from g")
def q_score_groups(spark, d):
    return _groups(spark, d)


@register("check_scores", "with " + GROUPS_SQL + """
select count(*) as groups,
       count(*) filter (where score is null or isnan(score) or isinf(score) or score < 0 or score > 1) as bad_scores,
       count(*) filter (where positives < 0 or negatives < 0) as bad_counts,
       sum(positives)::bigint as positives, sum(negatives)::bigint as negatives
from g""")
def q_check_scores(spark, d):
    return M.checked_report(_groups(spark, d))


@register("threshold_sweep", SWEEP_SQL + f" select {SWEEP_COLS} from m")
def q_threshold_sweep(spark, d):
    return _sweep(spark, d)


@register("select_threshold", SWEEP_SQL + f"""
select {SWEEP_COLS} from m
order by f1 desc, recall desc, precision desc, threshold desc limit 1""")
def q_select_threshold(spark, d):
    return M.select_threshold(_sweep(spark, d))


@register("baseline_row", SWEEP_SQL + f" select {SWEEP_COLS} from m where threshold = 0.5")
def q_baseline_row(spark, d):
    return M.baseline_row(_sweep(spark, d))


CONFUSION_SQL = "with " + TX_SQL + """,
cm as (select count(*) filter (where y = 1 and s >= 0.5) as tp,
              count(*) filter (where y = 0 and s >= 0.5) as fp,
              count(*) filter (where y = 1 and s < 0.5) as fn,
              count(*) filter (where y = 0 and s < 0.5) as tn
       from tx)"""


@register("confusion_matrix", CONFUSION_SQL + " select tp, fp, fn, tn from cm")
def q_confusion_matrix(spark, d):
    return M.confusion_matrix(tx(spark, d), "s", "y", 0.5)


METRICS_SQL = CONFUSION_SQL + """,
pr as (select tp, fp, fn, tn,
              case when tp + fp > 0 then tp::double / (tp + fp)::double else 0.0::double end as precision,
              case when tp + fn > 0 then tp::double / (tp + fn)::double else 0.0::double end as recall
       from cm)"""


@register("classification_metrics", METRICS_SQL + """
select tp, fp, fn, tn, precision, recall,
       case when precision + recall > 0 then 2.0::double * precision * recall / (precision + recall)
            else 0.0::double end as f1
from pr""")
def q_classification_metrics(spark, d):
    return M.classification_metrics(M.confusion_matrix(tx(spark, d), "s", "y", 0.5))


@register("weighted_metrics", CONFUSION_SQL + """,
z as (select (tp + fp + fn + tn)::double as n,
             case when tp + fp > 0 then tp::double / (tp + fp)::double else 0.0::double end as p1,
             case when tp + fn > 0 then tp::double / (tp + fn)::double else 0.0::double end as r1,
             case when tn + fn > 0 then tn::double / (tn + fn)::double else 0.0::double end as p0,
             case when tn + fp > 0 then tn::double / (tn + fp)::double else 0.0::double end as r0,
             (tp + fn)::double as s1, (tn + fp)::double as s0
      from cm),
w as (select *, s1 / n as w1, s0 / n as w0,
             case when p1 + r1 > 0 then 2.0::double * p1 * r1 / (p1 + r1) else 0.0::double end as f1c,
             case when p0 + r0 > 0 then 2.0::double * p0 * r0 / (p0 + r0) else 0.0::double end as f0c
      from z)
select w0 * p0 + w1 * p1 as weighted_precision, w0 * r0 + w1 * r1 as weighted_recall,
       w0 * f0c + w1 * f1c as weighted_f1
from w""")
def q_weighted_metrics(spark, d):
    return M.weighted_metrics(M.confusion_matrix(tx(spark, d), "s", "y", 0.5))


@register("auprc", "with " + GROUPS_SQL + """,
cu as (select positives as p, negatives as n,
              sum(positives) over w as tp, sum(negatives) over w as fp,
              sum(positives) over () as pp
       from g window w as (order by score desc rows between unbounded preceding and current row)),
pr as (select p, pp,
              case when tp + fp > 0 then tp::double / (tp + fp)::double else 0.0::double end as prec,
              case when (tp - p) + (fp - n) > 0
                   then (tp - p)::double / ((tp - p) + (fp - n))::double end as prev
       from cu)
select round(sum(p::double * (prec + coalesce(prev, prec)) / 2.0::double / pp::double), 9) as auprc
from pr""")
def q_auprc(spark, d):
    return M.auprc(_groups(spark, d), unique_scores=True) \
        .select(F.round("auprc", 9).alias("auprc"))


@register("apply_threshold", "with " + TX_SQL + """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, s as score,
       case when s >= 0.5 then 1 else 0 end as decision
from tx""")
def q_apply_threshold(spark, d):
    return tx(spark, d).select(*TX_KEY, F.col("s").alias("score"), decision("s", 0.5).alias("decision"))


def _candidates(spark, d):
    t = tx(spark, d)
    stacked = t.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("candidate"), F.expr(e).alias("score"))
        for i, e in enumerate(CANDIDATE_SCORES)])).alias("c"), "y2")
    return stacked.groupBy("c.candidate", "c.score").agg(
        F.count_if(F.col("y2") == 1).alias("positives"),
        F.count_if(F.col("y2") == 0).alias("negatives"))


CANDIDATE_GROUPS_SQL = TX_SQL + """,
c as (""" + "\n      union all ".join(
    f"select {i} as candidate, {e} as score, y2 from tx" for i, e in enumerate(CANDIDATE_SCORES)) + """),
g as (select candidate, score, count(*) filter (where y2 = 1) as positives,
             count(*) filter (where y2 = 0) as negatives
      from c group by candidate, score)"""


@register("rank_candidates", "with " + sweep_sql(CANDIDATE_GROUPS_SQL, "candidate") + f""",
best as (select * from (select *, row_number() over (partition by candidate
             order by f1 desc, recall desc, precision desc, threshold desc) as r from m) where r = 1)
select candidate, {SWEEP_COLS},
       (row_number() over (order by f1 desc, recall desc, precision desc, candidate asc))::int as rank
from best""")
def q_rank_candidates(spark, d):
    sweep = M.threshold_sweep(_candidates(spark, d), partition_by="candidate", unique_scores=True)
    best = M.select_threshold(sweep, partition_by=["candidate"])
    return M.rank_candidates(best, "candidate")


TX_HASH = md5_hash_sql(*TX_KEY)


@register("incremental_evaluation", "with " + TX_SQL + f""",
n as (select count(*) as n from tx),
sz as (select * from (values (0, 8), (1, 4), (2, 2), (3, 1)) v(idx, div)),
sizes as (select idx, (select n from n) // div as subset_size from sz),
r as (select s, y, row_number() over (order by {TX_HASH}, {', '.join(TX_KEY)}) as rn from tx),
sub as (select subset_size, s, y from sizes join r on r.rn <= sizes.subset_size),
cm as (select subset_size, count(*) as rows,
              count(*) filter (where y = 1 and s >= 0.5) as tp, count(*) filter (where y = 0 and s >= 0.5) as fp,
              count(*) filter (where y = 1 and s < 0.5) as fn, count(*) filter (where y = 0 and s < 0.5) as tn
       from sub group by subset_size),
g as (select subset_size, s as score, count(*) filter (where y = 1) as p, count(*) filter (where y = 0) as n
      from sub group by subset_size, s),
cu as (select subset_size, p, n, sum(p) over w as tp, sum(n) over w as fp,
              sum(p) over (partition by subset_size) as pp
       from g window w as (partition by subset_size order by score desc rows between unbounded preceding and current row)),
pz as (select subset_size, p, pp,
              case when tp + fp > 0 then tp::double / (tp + fp)::double else 0.0::double end as prec,
              case when (tp - p) + (fp - n) > 0 then (tp - p)::double / ((tp - p) + (fp - n))::double end as prev
       from cu),
au as (select subset_size, round(sum(p::double * (prec + coalesce(prev, prec)) / 2.0::double / pp::double), 9) as auprc
       from pz group by subset_size),
pr as (select *, case when tp + fp > 0 then tp::double / (tp + fp)::double else 0.0::double end as precision,
                 case when tp + fn > 0 then tp::double / (tp + fn)::double else 0.0::double end as recall
       from cm)
select pr.subset_size::bigint as subset_size, rows, tp, fp, fn, tn, precision, recall,
       case when precision + recall > 0 then 2.0::double * precision * recall / (precision + recall)
            else 0.0::double end as f1,
       au.auprc
from pr join au using (subset_size)""")
def q_incremental_evaluation(spark, d):
    t = tx(spark, d)
    n = t.count()
    sizes = [n // 8, n // 4, n // 2, n]
    out = M.incremental_evaluation(t, "s", "y", TX_KEY, sizes, 0.5)
    return out.withColumn("auprc", F.round("auprc", 9))
