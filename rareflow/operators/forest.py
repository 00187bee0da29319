"""Random forests grown from counted cells instead of single rows.

A tree learner of binned features sees of a row only its bins and its label, and all rows of one *cell* (the same bins
and label) take the same way down every tree. So rows are binned and counted once, and a tree's bag holds Poisson(n)
rows of a cell of n rows: the sum of the Poisson(1) draws that each of them would get alone. Every row counts in every tree, and
with four features a fit's work is bounded by the bins, not by the rows; where cells are as many as rows it is that of the rows.

Trees grow level by level, as Spark ML's do: at most 32 bins, square root of the features (rounded up) tried at a node, Gini
gain above 0, a least number of drawn rows on both sides, and leaves of one parent that predict the same class are merged. Tasks take a block of
cells and a share of the trees and count the drawn rows of each class by node, feature and bin; Spark deals the counts by node to tasks that sum
them and pick the best split of each node; the splits (the model, a row per node) go to the driver. Counts are whole numbers and draws are seeded
by tree and block, so the same rows and seed give the same forest on any cluster and from any file layout.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rareflow.operators.ordered import in_ranges, prefix_sum
from rareflow.session import work_path

BINS = 32
#: Cells of a block, and tasks that a fit has at least: a few blocks are each taken by several tasks with other trees.
BLOCK_CELLS, FIT_TASKS = 250_000, 16
PACKED = "block int, share int, shares int, bins binary, label binary, n binary"
HISTOGRAM = "node int, feature int, bin int, n0 bigint, n1 bigint"
BEST = "node int, n0 bigint, n1 bigint, feature int, bin int, l0 bigint, l1 bigint, gain double"
NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
         "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def thresholds(values: DataFrame) -> list[list[float]]:
    """Of each column, the values whose "at most" parts its bins: all but the largest if it has at most ``BINS``, else those at which another
    ``BINS``-th of the rows is reached. Exact, from the counts of all values."""
    counted = values.select(F.posexplode(F.array(*values.columns)).alias("feature", "value")).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    counted = in_ranges(counted, "feature", "value")
    of_feature = counted.groupBy("feature").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("total"))  # a row per feature
    running = prefix_sum(counted, "value", {"upto": "n"}, descending=False, partition_by=["feature"]).join(F.broadcast(of_feature), "feature")
    ends = running.where(f"upto < total and (different <= {BINS} or upto * {BINS} div total > (upto - n) * {BINS} div total)")
    found = ends.select("feature", "value").collect()  # at most 31 of a feature
    return [sorted(r.value for r in found if r.feature == i) for i in range(len(values.columns))]


def bin_of(value: Column, cuts: Sequence[float], first: int = 0) -> Column:
    """How many of the ascending ``cuts`` are below the value, by halving."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(value > F.lit(cuts[mid]), bin_of(value, cuts[mid + 1:], first + mid + 1)).otherwise(bin_of(value, cuts[:mid], first))


def count_cells(rows: DataFrame, features: Sequence[str], label: str) -> tuple[DataFrame, list[list[float]]]:
    """The cells of ``rows`` (bins, label, n), written, and each feature's thresholds.

    A null or NaN feature and a label that is neither 0 nor 1 are errors.
    """
    spark = rows.sparkSession
    fault = F.raise_error(F.lit("a fit needs features that are neither null nor NaN, and labels 0 and 1"))
    numbers = [F.when(x.isNull() | F.isnan(x), fault.cast("double")).otherwise(x) for x in (F.col(f).cast("double") for f in features)]
    known = F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    names = [f"b{i}" for i in range(len(features))]
    rows = rows.select(*[x.alias(n) for x, n in zip(numbers, names)], F.when(known, F.col(label).cast("int")).otherwise(fault.cast("int")).alias("label"))
    cuts = thresholds(rows.select(*names))
    path = work_path(spark, "cells")
    rows.groupBy(*[bin_of(F.col(n), c).cast("byte").alias(n) for n, c in zip(names, cuts)], "label").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.parquet(path), cuts


def _arrow():
    """Two functions for tasks: all rows of Arrow batches by column (empty if there are none), and a batch of a schema's columns."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}

    def read(batches):
        batches = [b for b in batches if b.num_rows]
        return {f.name: c.to_numpy() for f, c in zip(batches[0].schema, pa.Table.from_batches(batches).columns)} if batches else {}

    def write(columns, schema):
        names, types = zip(*[c.split() for c in schema.split(", ")])
        return pa.RecordBatch.from_arrays([pa.array(c.astype(kinds[t].to_pandas_dtype())) for c, t in zip(columns, types)], list(names))

    return read, write


def deal(cells: DataFrame) -> DataFrame:
    """The cells packed for the tasks of a fit: a row for each block and share of the trees, with the block's sorted bins, labels and counts as bytes."""
    names = [c for c in cells.columns if c not in ("label", "n")]
    blocks = max(1, -(-cells.count() // BLOCK_CELLS))
    groups = -(-FIT_TASKS // blocks)
    shares = cells.sparkSession.range(groups).select(F.col("id").cast("int").alias("share"), F.lit(groups).alias("shares"))
    dealt = cells.withColumn("block", F.pmod(F.xxhash64(*names, "label"), F.lit(blocks)).cast("int")).crossJoin(F.broadcast(shares))  # 16 rows at most
    dealt = dealt.repartitionById(blocks * groups, (F.col("block") * groups + F.col("share")).cast("int"))

    read, _ = _arrow()

    def pack(batches):
        column = read(batches)
        if not column:
            return
        for block, share in np.unique(np.stack([column["block"], column["share"]], axis=1), axis=0):  # one, as dealt
            own = (column["block"] == block) & (column["share"] == share)
            parts = np.stack([column[c][own] for c in names], axis=1), column["label"][own].astype(np.int8), column["n"][own].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((block, share, groups, *[x.tobytes() for x in parts]), (pa.int32(),) * 3 + (pa.binary(),) * 3)],
                                             ["block", "share", "shares", "bins", "label", "n"])

    return dealt.sortWithinPartitions("block", "share", *names, "label").mapInArrow(pack, PACKED)


class Trees:
    """The nodes of a forest, numbered level by level, a tree's nodes of one level side by side; node t is the root of tree t. Right children follow left ones."""

    def __init__(self, trees: int, features: int, seed: int):
        self.seed, self.features = seed, features
        self.tried = features if trees == 1 else math.ceil(math.sqrt(features))
        self.tree, self.feature, self.cut, self.left = np.arange(trees), np.full(trees, -1), np.zeros(trees, int), np.zeros(trees, int)
        self.counts, self.gain = np.zeros((trees, 2), int), np.full(trees, -1.0)
        self.level, self.first = 0, 0
        self.open = np.ones(trees, bool)
        self._choose()

    def _choose(self) -> None:
        """The features tried at each node of the last level."""
        draws = np.random.default_rng([self.seed, self.level]).random((len(self.tree) - self.first, self.features))
        self.subset = np.sort(np.argsort(draws, axis=1)[:, :self.tried], axis=1)

    def split(self, best: pa.Table, depth: int, least: int) -> None:
        """Give the last level its splits (as ``BEST``, feature -1 where there is none) and add their children as the next level."""
        found = best.sort_by("node")
        column = {c: found.column(c).to_numpy() for c in found.column_names}
        node, whole = column["node"], np.stack([column["n0"], column["n1"]], axis=1)
        self.counts[node] = whole
        some = (column["feature"] >= 0) & (self.level < depth)
        node, left = node[some], np.stack([column["l0"], column["l1"]], axis=1)[some]
        self.feature[node], self.cut[node], self.gain[node] = (column[c][some] for c in ("feature", "bin", "gain"))
        self.left[node] = len(self.tree) + 2 * np.arange(len(node))
        self.first, self.level = len(self.tree), self.level + 1
        grown, new = 2 * len(node), np.stack([left, whole[some] - left], axis=1).reshape(-1, 2)
        self.tree, self.counts = np.concatenate([self.tree, np.repeat(self.tree[node], 2)]), np.concatenate([self.counts, new])
        self.feature, self.gain = np.concatenate([self.feature, np.full(grown, -1)]), np.concatenate([self.gain, np.full(grown, -1.0)])
        self.cut, self.left = np.concatenate([self.cut, np.zeros(grown, int)]), np.concatenate([self.left, np.zeros(grown, int)])
        divisible = (new > 0).all(axis=1) & (new.sum(axis=1) >= 2 * least)
        self.open = np.concatenate([np.zeros(self.first, bool), divisible & (self.level < depth)])
        self._choose()

    def merge(self, weights: np.ndarray) -> np.ndarray:
        """The class that each node predicts, after leaves of one parent that predict the same class have become one."""
        predicted = (self.counts * weights).argmax(axis=1)
        for node in range(len(self.tree) - 1, -1, -1):
            a = self.left[node]
            if self.feature[node] >= 0 and self.feature[a] < 0 and self.feature[a + 1] < 0 and predicted[a] == predicted[a + 1]:
                self.feature[node] = -1
        return predicted


def _histograms(trees: Trees, number: int):
    """A function of Arrow batches: the drawn rows of both classes by open node, tried feature and bin, of each block and share of trees among them."""
    _, write = _arrow()
    n_features, first, tried = trees.features, trees.first, trees.tried
    state = [a.astype(np.int32) for a in (trees.feature, trees.cut, trees.left)]
    seed, level, is_open, subset = trees.seed, trees.level, trees.open, trees.subset.astype(np.int32)
    at = np.searchsorted(trees.tree[first:], np.arange(number + 1)) + first  # where a tree's nodes of the level begin

    def one_tree(tree, block, bins, label, n):
        feature, cut, left = state
        drawn = np.random.default_rng([seed, tree, block]).poisson(n)
        rows = np.flatnonzero(drawn)
        node = np.full(len(rows), tree, np.int32)
        for _ in range(level):
            rows, node = rows[(inner := feature[node] >= 0)], node[inner]
            node = left[node] + (bins[rows * n_features + feature[node]] > cut[node])
        rows, node = rows[(inside := is_open[node])], node[inside]
        wide = at[tree + 1] - at[tree]
        for j in range(tried):
            tested = subset[node - first, j]
            key = ((node - at[tree]) * BINS + bins[rows * n_features + tested]) * 2 + label[rows]
            counts = np.bincount(key, weights=drawn[rows], minlength=wide * BINS * 2).astype(np.int64).reshape(-1, 2)
            some = np.flatnonzero(counts.any(axis=1))
            nodes = some // BINS + at[tree]
            yield np.stack([nodes, subset[nodes - first, j], some % BINS, counts[some, 0], counts[some, 1]])

    def run(batches):
        for row in (r for b in batches for r in b.to_pylist()):  # one, as dealt
            bins, label, n = (np.frombuffer(row[c], t) for c, t in (("bins", np.int8), ("label", np.int8), ("n", np.int64)))
            for tree in range(row["share"], number, row["shares"]):
                if is_open[at[tree]:at[tree + 1]].any():
                    yield write(np.concatenate(list(one_tree(tree, row["block"], bins, label, n)), axis=1), HISTOGRAM)

    return run


def _best_splits(weights: np.ndarray, least: int):
    """A function of Arrow batches with all histograms of some nodes: of each node its drawn rows and the split of greatest Gini gain, feature -1
    if none has a gain and enough drawn rows on both sides. Of equal gains the first feature and the first bin count."""
    read, write = _arrow()

    def gini(counts, total):
        return 1 - (counts * counts).sum(axis=-1) / np.maximum(total * total, 1e-300)

    def run(batches):
        column = read(batches)
        if not column:
            return
        tested, place = np.unique(np.stack([column["node"], column["feature"]], axis=1), axis=0, return_inverse=True)
        key = place.ravel() * BINS + column["bin"]
        drawn = np.stack([np.bincount(key, weights=column[c], minlength=len(tested) * BINS) for c in ("n0", "n1")], axis=1).reshape(-1, BINS, 2)
        left = drawn.cumsum(axis=1)
        whole = left[:, -1:]
        right = whole - left
        wl, wr, wt = (x * weights for x in (left, right, whole))
        tl, tr, tt = (x.sum(axis=-1) for x in (wl, wr, wt))
        gain = gini(wt, tt) - tl / tt * gini(wl, tl) - tr / tt * gini(wr, tr)
        gain = np.where((left.sum(axis=-1) >= least) & (right.sum(axis=-1) >= least) & (gain > 0), gain, -1.0)
        cut = gain.argmax(axis=1)
        rows = np.arange(len(tested))
        gain, left = gain[rows, cut], left[rows, cut]
        order = np.lexsort((tested[:, 1], -gain, tested[:, 0]))
        best = order[np.unique(tested[order, 0], return_index=True)[1]]
        split = np.where(gain[best] > 0, tested[best, 1], -1)
        yield write([tested[best, 0], *whole[best, 0].T, split, cut[best], *left[best].T, gain[best]], BEST)

    return run


def grow(cells: DataFrame, cuts: list[list[float]], estimator: RandomForestClassifier, weights: dict) -> RandomForestClassificationModel:
    """A forest with the estimator's number of trees, depth, least rows of a node and seed, on the packed cells of ``deal``, with ``weights`` by label."""
    number, depth, least = estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getMinInstancesPerNode()
    by_class = np.array([weights[0], weights[1]], float)
    trees = Trees(number, len(cuts), estimator.getSeed())
    while trees.level == 0 or trees.open.any():
        histograms = cells.mapInArrow(_histograms(trees, number), HISTOGRAM).repartition("node")
        trees.split(histograms.mapInArrow(_best_splits(by_class, least), BEST).toArrow(), depth, least)  # a row per open node
    return _as_model(trees, cuts, estimator, by_class, cells)


def _as_model(trees: Trees, cuts: list[list[float]], estimator: RandomForestClassifier, weights: np.ndarray, cells: DataFrame) -> RandomForestClassificationModel:
    """The forest in the files in which Spark ML keeps one, loaded."""
    spark = cells.sparkSession
    predicted, stats = trees.merge(weights), trees.counts * weights
    share = stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300)
    impurity = np.where(stats.sum(axis=1) > 0, 1 - (share * share).sum(axis=1), 0.0)
    number, rows = estimator.getNumTrees(), []
    place, ids = dict.fromkeys(range(number), 0), [0] * number  # a node's number in its tree, the last one of each tree
    for node in range(len(trees.tree)):  # parents come before their children
        if node not in place:
            continue  # below a merged leaf
        tree, f, a = int(trees.tree[node]), int(trees.feature[node]), int(trees.left[node])
        if f >= 0:
            place[a], place[a + 1], ids[tree] = ids[tree] + 1, ids[tree] + 2, ids[tree] + 2
        below = (float(trees.gain[node]), place[a], place[a + 1], (f, [cuts[f][trees.cut[node]]], -1)) if f >= 0 else (-1.0, -1, -1, (-1, [], -1))
        rows.append((tree, (place[node], float(predicted[node]), float(impurity[node]), [float(x) for x in stats[node]], int(trees.counts[node].sum()), *below)))
    path = work_path(spark, "forest")
    params = {p.name: v for p, v in estimator.extractParamMap().items()}
    about = {"class": "org.apache.spark.ml.classification.RandomForestClassificationModel", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
             "uid": f"RandomForestClassifier_{uuid.uuid4().hex[:12]}", "paramMap": params, "defaultParamMap": {}, "numFeatures": len(cuts), "numClasses": 2, "numTrees": number}
    of_tree = {k: v for k, v in params.items() if k not in ("numTrees", "subsamplingRate", "bootstrap", "featureSubsetStrategy")}
    one = [(t, json.dumps({**about, "class": "org.apache.spark.ml.classification.DecisionTreeClassificationModel", "uid": f"dtc_{uuid.uuid4().hex[:12]}", "paramMap": of_tree}), 1.0)
           for t in range(number)]
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(one, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(rows, NODES).coalesce(1).write.parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)
