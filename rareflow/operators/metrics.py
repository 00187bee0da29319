"""Threshold sweep, selection and evaluation metrics, all as DataFrames.

Nothing here collects rows to the driver: the only driver-side values are the
one-row results of guard aggregates (counts), whose size does not grow with the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from rareflow.functions.columns import INF, check_threshold, col, f1_from_counts, ratio
from rareflow.operators.ordered import global_row_number, in_ranges, prefix_sum

SWEEP_COLUMNS = ["threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1"]
# Thresholds always present in a sweep (endpoints and the 0.5 baseline).
EXTRA_THRESHOLDS = (0.0, 0.5, 1.0)


def score_groups(df: DataFrame, score: str | Column, label: str | Column) -> DataFrame:
    """(score, positives, negatives) per distinct score; map-side combined, so a hot score is one row."""
    y = col(label)
    return df.groupBy(col(score).cast("double").alias("score")).agg(
        F.count_if(y == 1).alias("positives"),
        F.count_if(y == 0).alias("negatives"))


def _count_ok(c: str, dtype) -> Column:
    v = F.col(c)
    ok = v.isNotNull() & (v >= 0)
    if not isinstance(dtype, IntegralType):
        ok = ok & finite_double(v) & (v == F.floor(v))
    return ok


def finite_double(v: Column) -> Column:
    d = v.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(INF))


def _report_aggs(groups: DataFrame) -> list[Column]:
    s = F.col("score")
    bad_count = ~(_count_ok("positives", groups.schema["positives"].dataType)
                  & _count_ok("negatives", groups.schema["negatives"].dataType))
    return [
        F.count(F.lit(1)).alias("groups"),
        F.count_if(~(finite_double(s) & (s >= 0) & (s <= 1))).alias("bad_scores"),
        F.count_if(bad_count).alias("bad_counts"),
        F.coalesce(F.sum("positives"), F.lit(0)).cast("bigint").alias("positives"),
        F.coalesce(F.sum("negatives"), F.lit(0)).cast("bigint").alias("negatives"),
    ]


def score_report(groups: DataFrame, partition_by: str | None = None) -> DataFrame:
    """One aggregate over score groups: faulty scores and counts, class totals."""
    aggs = _report_aggs(groups)
    return groups.groupBy(partition_by).agg(*aggs) if partition_by else groups.agg(*aggs)


def checked_report(groups: DataFrame) -> DataFrame:
    """``score_report`` that fails on what ``check_scores`` refuses, in the same pass."""
    report = score_report(groups)
    sound = (F.col("bad_scores") == 0) & (F.col("bad_counts") == 0) & (F.col("positives") > 0) & (F.col("negatives") > 0)
    refused = F.raise_error(F.concat(F.lit("score groups are not fit for a sweep: "), F.to_json(F.struct("*")))).cast("bigint")
    return report.select(*[F.when(sound, F.col(c)).otherwise(refused).alias(c) for c in report.columns])


def check_scores(groups: DataFrame, partition_by: str | None = None) -> dict:
    """Guard of a sweep (one aggregate; one row per partition to the driver): the class totals.

    Fails on a score that is null, NaN, infinite or outside [0, 1], on counts that are negative or
    fractional, and when a class is absent. ``partition_by`` (e.g. a candidate id) must have few distinct values.
    """
    return _checked([r.asDict() for r in score_report(groups, partition_by).collect()], partition_by)


def _checked(rows: list[dict], partition_by: str | None) -> dict:
    for row in rows or [dict(bad_scores=0, bad_counts=0, positives=0, negatives=0)]:
        if row["bad_scores"]:
            raise ValueError(f"{row['bad_scores']} scores are missing or outside [0, 1]")
        if row["bad_counts"]:
            raise ValueError(f"{row['bad_counts']} score groups have counts that are no whole numbers from 0 up")
        if not row["positives"] or not row["negatives"]:
            raise ValueError("a sweep needs rows of class 0 and of class 1")
    return {row[partition_by] if partition_by else None: (int(row["positives"]), int(row["negatives"])) for row in rows}


def dealt_groups(groups: DataFrame, partition_by: str | None = None, *, unique_scores: bool = True) -> tuple[DataFrame, dict]:
    """(groups in ranges of the score, class totals), checked.

    The extra thresholds are added as groups without rows (marked ``extra``). The groups are written once, in
    ranges, and without partitions the guard report is observed during that write, so a sweep needs no
    pass of its own for it.
    """
    from pyspark.sql import Observation

    part = [partition_by] if partition_by else []
    groups = groups.select(*part, F.col("score").cast("double").alias("score"), "positives", "negatives")
    if not unique_scores:
        groups = groups.groupBy(*part, "score").agg(F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"))
    points = groups.select(*part).distinct() if part else groups.sparkSession.range(1).select()
    points = points.select(*part, F.explode(F.array(*[F.lit(t) for t in EXTRA_THRESHOLDS])).alias("score"),
                           *[F.lit(0).cast(groups.schema[c].dataType).alias(c) for c in ("positives", "negatives")], F.lit(True).alias("extra"))
    groups = groups.withColumn("extra", F.lit(False)).unionByName(points)
    if partition_by:
        dealt = in_ranges(groups, partition_by, "score")
        totals = check_scores(dealt, partition_by)
    else:
        seen = Observation(f"rf_score_report_{uuid.uuid4().hex[:12]}")  # unique: concurrent sweeps never mix
        dealt = in_ranges(groups, "score", observed=(seen, _report_aggs(groups)))
        totals = _checked([dict(seen.get)], None)
    return dealt.withColumns({c: F.col(c).cast("bigint") for c in ("positives", "negatives")}), totals


def _per_partition(totals: dict, partition_by: str | None, which: int) -> Column:
    """Class total of the row's partition as a literal (one entry per partition)."""
    if not partition_by:
        return F.lit(totals[None][which])
    expr = None
    for part, tot in totals.items():
        cond = F.col(partition_by) == F.lit(part)
        expr = F.when(cond, F.lit(tot[which])) if expr is None else expr.when(cond, F.lit(tot[which]))
    return expr


def _running(dealt: DataFrame, partition_by: str | None) -> DataFrame:
    """Dealt groups plus running tp/fp in descending score order (``>=`` is inclusive); an extra
    threshold goes where a group has the same score."""
    return prefix_sum(dealt, "score", {"tp": "positives", "fp": "negatives"},
                      partition_by=[partition_by] if partition_by else [], first_of_ties="extra")


def threshold_sweep(groups: DataFrame, *, partition_by: str | None = None, unique_scores: bool = False) -> DataFrame:
    """Every distinct score plus 0, 0.5 and 1 as a threshold, with confusion and metrics."""
    dealt, totals = dealt_groups(groups, partition_by, unique_scores=unique_scores)
    P, N = _per_partition(totals, partition_by, 0), _per_partition(totals, partition_by, 1)
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = (P - tp), (N - fp)
    part = [partition_by] if partition_by else []
    return _running(dealt, partition_by).select(
        *part, F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        fn.alias("fn"), tn.alias("tn"),
        ratio(tp, tp + fp).alias("precision"),
        (tp.cast("double") / P.cast("double")).alias("recall"),
        f1_from_counts(tp, fp, fn).alias("f1"))


def sweep_scores(df: DataFrame, score: str | Column, label: str | Column) -> DataFrame:
    """score_groups + threshold_sweep. The groups are written once; offsets and the final
    window read them instead of aggregating the raw rows again."""
    return threshold_sweep(score_groups(df, score, label), unique_scores=True)


def select_threshold(sweep: DataFrame, keys: Sequence[str] = ("f1", "recall", "precision", "threshold"),
                     partition_by: Sequence[str] = ()) -> DataFrame:
    """Row maximising F1, then recall, precision, threshold (a global max_by: partial aggregation, no sort)."""
    cols = [c for c in sweep.columns if c not in partition_by]
    best = F.max_by(F.struct(*cols), F.struct(*keys)).alias("best")
    agg = sweep.groupBy(*partition_by).agg(best) if partition_by else sweep.agg(best)
    return agg.select(*partition_by, "best.*")


def baseline_row(sweep: DataFrame, threshold: float = 0.5) -> DataFrame:
    return sweep.filter(F.col("threshold") == F.lit(float(threshold)))


def confusion_matrix(df: DataFrame, score: str | Column, label: str | Column,
                     threshold: float) -> DataFrame:
    """(tp, fp, fn, tn) at ``score >= threshold``, one pass, empty cells 0. A row whose score is not finite or
    whose label is not 0 or 1 belongs to no cell: it fails the query."""
    t = F.lit(check_threshold(threshold))
    s, y = col(score).cast("double"), col(label).cast("double")
    sound = F.coalesce(finite_double(s) & y.isin(0.0, 1.0), F.lit(False))
    faulty = F.count_if(~sound)
    cells = {"tp": (y == 1) & (s >= t), "fp": (y == 0) & (s >= t), "fn": (y == 1) & (s < t), "tn": (y == 0) & (s < t)}
    counted = df.agg(faulty.alias("_faulty"), *[F.count_if(c).alias(n) for n, c in cells.items()])
    refused = F.raise_error(F.concat(F.col("_faulty").cast("string"), F.lit(" rows have no finite score or no label 0 or 1"))).cast("bigint")
    return counted.select(*[F.when(F.col("_faulty") == 0, F.col(n)).otherwise(refused).alias(n) for n in cells])


def classification_metrics(confusion: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the positive class; 0.0 for empty denominators."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return confusion.select(
        "*", p.alias("precision"), r.alias("recall"),
        F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))


def weighted_metrics(confusion: DataFrame) -> DataFrame:
    """Support-weighted precision, recall and F1 over both classes (as the multiclass evaluator)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    p1, r1 = ratio(tp, tp + fp), ratio(tp, tp + fn)
    p0, r0 = ratio(tn, tn + fn), ratio(tn, tn + fp)
    w1, w0 = ratio(tp + fn, n), ratio(tn + fp, n)

    def f(p, r):
        return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))

    return confusion.select(
        (w0 * p0 + w1 * p1).alias("weighted_precision"),
        (w0 * r0 + w1 * r1).alias("weighted_recall"),
        (w0 * f(p0, r0) + w1 * f(p1, r1)).alias("weighted_f1"))


def auprc(groups: DataFrame, *, partition_by: str | None = None, unique_scores: bool = False) -> DataFrame:
    """Exact area under the precision-recall curve (trapezoids over distinct scores).

    Equal to ``BinaryClassificationEvaluator(areaUnderPR, numBins=0)``: the curve
    starts at recall 0 with the first precision. Uses the running tp/fp of the
    group itself and of the group before (tp - p, fp - n), so no ``lag`` crosses
    a bucket boundary; thresholds without rows add nothing.
    """
    return auprc_dealt(*dealt_groups(groups, partition_by, unique_scores=unique_scores), partition_by)


def auprc_dealt(dealt: DataFrame, totals: dict, partition_by: str | None = None) -> DataFrame:
    """Exact AUPRC of ``dealt_groups``."""
    return _pr_area(_running(dealt, partition_by), totals, partition_by)


def _pr_area(cum: DataFrame, totals: dict, partition_by: str | None) -> DataFrame:
    """Trapezoids between each group's (recall, precision) and the previous group's, whose
    running counts are the group's own minus its counts; the first group pairs with itself."""
    tp, fp = F.col("tp"), F.col("fp")
    tp0, fp0 = tp - F.col("positives"), fp - F.col("negatives")
    pr = ratio(tp, tp + fp)
    pr0 = F.when(tp0 + fp0 > 0, tp0.cast("double") / (tp0 + fp0).cast("double")).otherwise(pr)
    term = F.col("positives").cast("double") * (pr + pr0) / F.lit(2.0)
    P = _per_partition(totals, partition_by, 0).cast("double")
    area = F.sum(term / P).alias("auprc")
    return cum.groupBy(partition_by).agg(area) if partition_by else cum.agg(area)


def rank_candidates(selected: DataFrame, order_col: str = "candidate") -> DataFrame:
    """Rank candidates by F1, recall, precision; an exact tie keeps the earlier one.

    ``selected`` has one row per candidate (the search size), so the global
    window runs over a table whose size is the number of candidates.
    """
    w = Window.orderBy(F.col("f1").desc(), F.col("recall").desc(), F.col("precision").desc(),
                       F.col(order_col).asc())
    return selected.withColumn("rank", F.row_number().over(w))


def incremental_evaluation(df: DataFrame, score: str | Column, label: str | Column, key: Sequence[str],
                           sizes: Sequence[int], threshold: float, *, with_auprc: bool = True) -> DataFrame:
    """Metrics on growing subsets (first ``size`` rows in key-hash order) without one job per size.

    Each row gets the index of the smallest size that covers its rank. Score
    groups are counted per (index, score) and each is added to every size
    that contains it (``explode`` over at most ``len(sizes)`` indices), which
    gives the score groups of every subset at once; confusion counts and the
    exact AUPRC per subset follow from those groups.
    """
    sizes = sorted({int(s) for s in sizes})
    if not sizes or sizes[0] <= 0:
        raise ValueError("subset sizes must be positive integers")
    t = F.lit(check_threshold(threshold))
    source = df.select(*key, col(score).alias("_s"), col(label).alias("_y"))
    ranked = global_row_number(source, key, rows=source.count(), limit=sizes[-1])
    rn = F.col("row_number")
    idx = F.when(rn <= sizes[0], F.lit(0))
    for i, s in enumerate(sizes[1:], start=1):
        idx = idx.when(rn <= s, F.lit(i))
    per_idx = ranked.groupBy(idx.alias("idx"), F.col("_s").cast("double").alias("score")) \
        .agg(F.count_if(F.col("_y") == 1).alias("positives"), F.count_if(F.col("_y") == 0).alias("negatives"),
             F.count(F.lit(1)).alias("n"))
    groups = per_idx.select(F.explode(F.sequence("idx", F.lit(len(sizes) - 1))).alias("subset"), "score",
                            "positives", "negatives", "n") \
        .groupBy("subset", "score").agg(*[F.sum(c).alias(c) for c in ("positives", "negatives", "n")])
    groups = in_ranges(groups, "subset", "score")
    s_ = F.col("score")
    conf = groups.groupBy("subset").agg(
        F.sum("n").cast("bigint").alias("rows"),
        *[F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("bigint").alias(name)
          for name, cond, c in (("tp", s_ >= t, "positives"), ("fp", s_ >= t, "negatives"),
                                ("fn", s_ < t, "positives"), ("tn", s_ < t, "negatives"))])
    spark = df.sparkSession
    size_df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "subset int, subset_size bigint")
    out = classification_metrics(conf.join(F.broadcast(size_df), "subset"))
    if with_auprc:
        area = _auprc_lenient(groups, "subset")
        out = out.join(area, "subset", "left")
    return out.drop("subset")


def _auprc_lenient(dealt: DataFrame, partition_by: str) -> DataFrame:
    """Exact AUPRC per partition of groups in ranges; 0.0 where a partition has no positive (a small subset may lack one)."""
    report = score_report(dealt, partition_by).collect()
    if any(r["bad_scores"] for r in report):
        raise ValueError("scores are missing or outside [0, 1]")
    totals = {r[partition_by]: (int(r["positives"]), int(r["negatives"])) for r in report if r["positives"]}
    parts = dealt.select(partition_by).distinct()
    if not totals:
        return parts.withColumn("auprc", F.lit(0.0))
    cum = prefix_sum(dealt.where(F.col(partition_by).isin(list(totals))), "score", {"tp": "positives", "fp": "negatives"},
                     partition_by=[partition_by])
    return parts.join(_pr_area(cum, totals, partition_by), partition_by, "left").select(partition_by, F.coalesce("auprc", F.lit(0.0)).alias("auprc"))


def auprc_binned(scored: DataFrame, score: str | Column, label: str | Column, num_bins: int = 1000) -> float:
    """AUPRC as Spark's ``BinaryClassificationEvaluator`` reports it (``num_bins`` down-sampling;
    1000 is its default), for comparison with numbers computed that way. ``auprc`` is exact."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    s = col(score).cast("double")
    raw = scored.select(col(label).cast("double").alias("label"),
                        array_to_vector(F.array(F.lit(1.0) - s, s)).alias("raw"))
    return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="raw", metricName="areaUnderPR",
                                         numBins=num_bins).evaluate(raw)
