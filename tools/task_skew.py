"""Per-stage task balance from Spark's event log, on inputs with one hot key.

Usage: python tools/task_skew.py [sf_dir]
One third of the rows share a score, a class and an id (the other scores are
continuous); each operator runs
once, then the event log (written to a fresh scratch folder) is read back and,
per stage, the largest task's records (input + shuffle read) is compared with
the median. A hot key collected into one task would show a ratio near the
number of tasks.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from rareflow.operators import metrics as M
    from rareflow.operators import sampling as S
    from rareflow.session import build_session
    from rareflow.streaming.events import score_parity

    log_dir = tempfile.mkdtemp(prefix="rf-eventlog-")
    # AQE coalescing would merge small shuffle partitions into a few tasks at this size and
    # hide (or fake) key skew; keep the planned 16 partitions so the key distribution shows.
    spark = build_session("local[8]", shuffle_partitions=16, **{
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(16)
    hot = (F.col("l_orderkey") % 3 == 0)
    df = li.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"),
        F.when(hot, F.lit(0.5)).otherwise(F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"),
                                                 F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("s"),
        F.when(hot, F.lit(1)).otherwise((F.col("l_returnflag") == "R").cast("int")).alias("y"),
        F.when(hot, F.lit("hot-id")).otherwise(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey",
                                                           "l_suppkey")).alias("id"))
    from rareflow.operators import validate as V

    jobs = {
        "threshold_sweep": lambda: M.sweep_scores(df, "s", "y"),
        "naive_global_window (contrast)": lambda: M.score_groups(df, "s", "y").select(
            "score", F.sum("positives").over(Window.orderBy(F.col("score").desc())).alias("tp")),
        "split_disjointness": lambda: S.split_disjointness(
            df, dict(zip(S.SPLITS, S.split_frames(S.hash_split(df, ["k"])))), ["k"]),
        "sequential_take": lambda: S.sequential_take(df.select("k", "s", F.xxhash64("k").alias("o")), "o",
                                                     100000),
        "class_weights": lambda: V.class_weights(df, "y"),
        "incremental_evaluation": lambda: M.incremental_evaluation(df, "s", "y", ["k"], [100000, 400000], 0.5),
        "top_k_per_class": lambda: S.top_k_per_class(df, "y", ["k"], 5),
        "balance_classes_exact": lambda: S.balance_classes_exact(df, "y", ["k"]),
        "score_parity": lambda: score_parity(df.select(F.col("id").alias("EventId"), F.col("s").alias(
            "fraud_probability"), F.lit(1).alias("final_prediction")), df.select(
            F.col("id").alias("EventId"), F.col("s").alias("fraud_probability"),
            F.lit(1).alias("final_prediction"))),
    }
    n_input = df.count()
    for name, build in jobs.items():
        spark.sparkContext.setJobGroup(name, name)
        build().write.format("noop").mode("overwrite").save()
    spark.stop()

    stages, group = {}, {}
    for path in sorted(glob.glob(f"{log_dir}/**/*", recursive=True)):
        if os.path.isdir(path):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev["Event"] == "SparkListenerJobStart":
                    g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        group[sid] = g
                if ev["Event"] != "SparkListenerTaskEnd" or "Task Metrics" not in ev:
                    continue
                m = ev["Task Metrics"]
                if m.get("Input Metrics", {}).get("Records Read", 0):
                    continue  # file scans: their split follows the files, not the keys
                recs = m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0)
                stages.setdefault(ev["Stage ID"], []).append(recs)
    report = {}
    for sid, recs in sorted(stages.items()):
        if max(recs) == 0:
            continue
        report.setdefault(group.get(sid), []).append(
            dict(stage=sid, tasks=len(recs), max=max(recs), median=statistics.median(recs), total=sum(recs)))
    for g, rows in report.items():
        if g is None:
            continue  # the input row count
        worst = max(rows, key=lambda r: r["max"])
        worst["max_share_of_input"] = round(worst["max"] / n_input, 3)
        print(json.dumps({"operator": g, "shuffle_stages": len(rows), "largest_task_stage": worst}))


if __name__ == "__main__":
    main(sys.argv)
