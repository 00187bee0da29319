"""Forests grown from counted cells: thresholds, cells, bags of single rows, splits, leaves, the stored form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rareflow.operators import forest as FO
from rareflow.operators import model as MD
from rareflow.spec import FeatureSpec

SPEC = FeatureSpec(("a", "b"), "y")
SETTINGS = dict(max_depth=4, min_instances_per_node=1, weighting="none")


def table(spark, n=600, copies=1):
    """Two features of 24 and 600 values, a label that both decide for the most part, each row ``copies`` times."""
    a, b = F.col("id") % 24, (F.col("id") * 37 % n).cast("double")
    y = F.when(F.col("id") % 11 == 0, 1).otherwise(((a > 15) & (b > n / 3)).cast("int"))
    return spark.range(n).select(a.alias("a"), b.alias("b"), y.alias("y")).crossJoin(spark.range(copies).select(F.lit(1).alias("_"))).drop("_")


def fit(rows, seed=3, **settings):
    return MD.train_forest(rows, SPEC, seed=seed, **{**SETTINGS, **settings}).stages[1]


def nodes(spark, forest):
    """{tree: {id: node}} of a forest, from the files that Spark ML writes of it."""
    from rareflow.session import work_path

    path = work_path(spark, "t-forest")
    forest.write().save(path)
    found = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        found.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    return found


def test_repeated_rows_make_no_more_cells(spark):
    (once, cuts), (many, same) = (FO.count_cells(table(spark, copies=k), SPEC.features, SPEC.label) for k in (1, 40))
    one, more = ({(r.b0, r.b1, r.label): r.n for r in cells.collect()} for cells in (once, many))
    sizes = [sum(len(r.n) for r in MD.fit_input(table(spark, copies=k), SPEC)[0].where("share = 0").collect()) for k in (1, 40)]
    assert sizes[0] == sizes[1] == 8 * len(one)
    assert cuts == same and sum(one.values()) == 600 and more == {k: 40 * n for k, n in one.items()}


def test_thresholds_are_all_values_or_equal_shares_of_the_rows(spark):
    _, (few, many) = MD.fit_input(table(spark), SPEC)
    assert few == [float(v) for v in range(23)]
    assert len(many) == 31 and all(abs((np.arange(600) <= t).mean() - (i + 1) / 32) <= 1 / 600 for i, t in enumerate(many))
    heavy = spark.range(1000).select(F.when(F.col("id") < 900, 5.0).otherwise(F.col("id")).alias("a"), F.lit(2.0).alias("b"))
    shares, constant = FO.thresholds(heavy)
    assert constant == [] and shares[0] == 5.0 and shares[1] > 900 and shares == sorted(set(shares)) and shares[-1] < 999


def test_bins_count_the_thresholds_below(spark):
    cuts = [-1.5, 0.0, 0.25, 2.0, 7.0]
    values = [-9.0, -1.5, -1.0, 0.0, 0.1, 0.25, 2.0, 2.5, 7.0, 7.5, float("inf")]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v double").select(FO.bin_of(F.col("v"), cuts).alias("b")).collect()]
    assert got == list(np.searchsorted(cuts, values))


def test_a_bag_draws_single_rows(spark):
    """A cell of many rows gives a bag about as many, not none or a multiple: counts vary as those of as many single draws."""
    rows = spark.createDataFrame([(0.0, 0.0, 0), (1.0, 1.0, 1)], "a double, b double, y int").crossJoin(spark.range(5000).select(F.lit(1).alias("_"))).drop("_")
    roots = [t[0] for t in nodes(spark, fit(rows, num_trees=40, max_depth=1)).values()]
    drawn = np.array([r.impurityStats for r in roots])
    assert np.abs(drawn - 5000).max() < 6 * 5000 ** 0.5 and len(set(drawn[:, 0])) > 30
    assert 0.6 < drawn.std() / 5000 ** 0.5 < 1.5
    assert [r.rawCount for r in roots] == list(drawn.sum(axis=1))


def test_every_split_is_the_best_of_its_drawn_rows(spark):
    """One tree tries all features at each node: its splits and counts are those found by trying every threshold on the same draws."""
    rows = table(spark).withColumn("y", F.when(F.col("a") + F.col("b") % 7 > 20, 1 - F.col("y")).otherwise(F.col("y")))
    counted, cuts = FO.count_cells(rows, SPEC.features, SPEC.label)
    cells = counted.orderBy("b0", "b1", "label").collect()
    drawn = np.random.default_rng([3, 0, 0]).poisson([c.n for c in cells])
    bins, y = np.array([(c.b0, c.b1) for c in cells]), np.array([c.label for c in cells])
    tree = nodes(spark, fit(rows, num_trees=1, min_instances_per_node=5))[0]

    def gini(inside):
        n = np.array([drawn[inside & (y == k)].sum() for k in (0, 1)], float)
        return n, 1 - ((n / max(n.sum(), 1)) ** 2).sum()

    def gain(inside, f, cut):
        (t, gt), (l, gl), (r, gr) = gini(inside), gini(inside & (bins[:, f] <= cut)), gini(inside & (bins[:, f] > cut))
        return gt - l.sum() / t.sum() * gl - r.sum() / t.sum() * gr if min(l.sum(), r.sum()) >= 5 else 0.0

    def check(node, inside):
        found = tree[node]
        assert list(found.impurityStats) == list(gini(inside)[0]) and found.rawCount == drawn[inside].sum() and abs(found.impurity - gini(inside)[1]) < 1e-9
        if found.leftChild < 0:
            return 1
        f, cut = found.split.featureIndex, cuts[found.split.featureIndex].index(found.split.leftCategoriesOrThreshold[0])
        best = max(gain(inside, i, c) for i in (0, 1) for c in range(len(cuts[i])))
        assert abs(gain(inside, f, cut) - best) < 1e-9 and abs(found.gain - best) < 1e-9
        return check(found.leftChild, inside & (bins[:, f] <= cut)) + check(found.rightChild, inside & (bins[:, f] > cut))

    assert check(0, np.ones(len(cells), bool)) >= 4


def test_leaves_hold_enough_rows_and_differ_in_class(spark):
    forest = nodes(spark, fit(table(spark), num_trees=6, min_instances_per_node=30, weighting="balanced"))
    assert len(forest) == 6
    for tree in forest.values():
        inner = [n for n in tree.values() if n.leftChild >= 0]
        assert inner and sorted(tree) == list(range(len(tree)))
        for n in inner:
            two = tree[n.leftChild], tree[n.rightChild]
            assert min(c.rawCount for c in two) >= 30 and sum(c.rawCount for c in two) == n.rawCount
            assert any(c.leftChild >= 0 for c in two) or two[0].prediction != two[1].prediction


def test_blocks_of_cells_are_summed(spark, monkeypatch):
    monkeypatch.setattr(FO, "BLOCK_CELLS", 40)
    rows = table(spark)
    cells, _ = MD.fit_input(rows, SPEC)
    assert cells.select("block").distinct().count() > 5
    root = nodes(spark, fit(rows, num_trees=1))[0][0]
    assert abs(root.rawCount - 600) < 6 * 600 ** 0.5
    left = [fit(r, num_trees=3).toDebugString.split("\n", 1)[1] for r in (rows.repartition(5), rows.coalesce(1).orderBy(F.desc("b")))]
    assert left[0] == left[1]


def test_scores_are_close_to_those_of_spark_ml(spark):
    rows = table(spark, n=4000)
    own = MD.ModelScorer(MD.train_forest(rows, SPEC, num_trees=40, **SETTINGS))
    theirs = MD.RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=40, maxDepth=4, seed=3).fit(MD.assembler_for(SPEC).transform(rows)).copy()
    theirs = MD.ModelScorer(MD.PipelineModel(stages=[MD.assembler_for(SPEC), theirs]))
    both = theirs.score(own.score(rows).withColumnRenamed(MD.PROBABILITY, "own"))
    gap = both.select(F.avg(F.abs(F.col("own") - F.col(MD.PROBABILITY))).alias("d"), F.avg("own").alias("own"), F.avg(MD.PROBABILITY).alias("theirs")).first()
    assert gap.d < 0.05 and abs(gap.own - gap.theirs) < 0.02


def test_depth_zero_is_a_leaf(spark):
    tree = nodes(spark, fit(table(spark), num_trees=2, max_depth=0))[0]
    assert list(tree) == [0] and tree[0].leftChild == -1 and tree[0].rawCount > 0


@pytest.mark.parametrize("bad", [(None, 1.0, 0), (float("nan"), 1.0, 0), (1.0, 1.0, 2), (1.0, 1.0, None)])
def test_a_fit_refuses_what_it_can_not_use(spark, bad):
    rows = spark.createDataFrame([(0.0, 0.0, 0), (1.0, 2.0, 1), bad], "a double, b double, y int")
    with pytest.raises(Exception, match="neither null nor NaN"):
        MD.train_forest(rows, SPEC, counts={0: 2, 1: 1}, validate=False, num_trees=1)
