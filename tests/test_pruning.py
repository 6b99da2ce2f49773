"""Pruned trees against all subtrees, and balance inside folds by counting."""

import itertools
import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from donorflow.operators import models, pruning


def grown(seed, depth):
    r = random.Random(seed)

    def grow(d):
        if d == 0 or r.random() < 0.2:
            return pruning.Branch()
        return pruning.Branch(children=[grow(d - 1), grow(d - 1)])

    root = grow(depth)
    leaves = root.leaves()
    for i, x in enumerate(leaves):
        x.leaf = i
    return root, {i: np.array([r.randint(0, 30), r.randint(0, 30)], float) for i in range(len(leaves))}


def subtrees(x):
    """All ways to cut a tree: the nodes that become leaves."""
    own = [[x]]
    if x.children:
        own += [sum(parts, []) for parts in itertools.product(*[subtrees(c) for c in x.children])]
    return own


@pytest.mark.parametrize("seed", range(12))
def test_pruned_tree_is_the_cheapest_subtree(seed):
    root, leaves = grown(seed, 3)
    values = [0.0, 0.003, 0.01, 0.04, 0.1, 0.3, 2.0]
    scores = pruning.pruned_scores(root, leaves, values)
    for v, got in zip(values, scores, strict=True):
        cost = lambda cut: sum(x.risk() for x in cut) + v * (root.risk() or 1.0) * len(cut)
        best = min(subtrees(root), key=lambda cut: (round(cost(cut), 9), len(cut)))
        want = np.zeros(len(leaves))
        for x in best:
            for leaf in x.leaves():
                want[leaf.leaf] = x.counts[1] / x.counts.sum() if x.counts.sum() else 0.5
        assert np.allclose(got, want)


def rows(spark, count=900):
    r = random.Random(4)
    data = []
    for i in range(count):
        x, z = r.random(), r.random()
        data.append((i, i // 3, x, z, (r.random() < (0.6 if x > 0.7 else 0.1))))
    return spark.createDataFrame(data, "don_id long, donor long, x double, z double, Hb_deferral boolean")


def test_leaves_are_numbered_as_spark_does(spark):
    df = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(models.numeric_label(rows(spark)))
    model = DecisionTreeClassifier(labelCol="label_index", maxDepth=4, leafCol="leaf", seed=1).fit(df)
    root = pruning.branches(model)
    counts = pruning.counted(root, model.transform(df))
    assert len(root.leaves()) == (model.numNodes + 1) // 2 and sum(c.sum() for c in counts.values()) == 900
    for leaf, p in model.transform(df).select("leaf", F.col("probability").alias("p")).distinct().collect():
        assert abs(counts[int(leaf)][1] / counts[int(leaf)].sum() - p[1]) < 1e-12


def test_classes_are_equal_in_every_training_fold(spark):
    df = models.numeric_label(rows(spark))
    placed, sizes = models.folded_balance(df, "label_index", "donor", "don_id", 5, 3)
    assert sum(sizes.values()) == 900
    for fold in range(5):
        train = models.balanced_without(placed, sizes, fold, "label_index")
        counts = {r["label_index"]: r["count"] for r in train.groupBy("label_index").count().collect()}
        assert counts[0.0] == counts[1.0] and not train.filter(F.col("fold") == fold).count()
        copies = [r["count"] for r in train.filter("label_index = 1").groupBy("don_id").count().collect()]
        assert max(copies) - min(copies) <= 1
        held = placed.filter(F.col("fold") == fold).select("donor").distinct()
        assert not train.join(held, "donor", "left_semi").count()


def test_chosen_complexity(spark):
    """One real split and noise: the chosen tree keeps the split and beats an unpruned one on new rows."""
    model, table = models.pruned_tree(rows(spark), ["x", "z"], folds=3, repeats=1, values=[0.0001, 0.02, 0.5, 5.0])
    assert sum(r["chosen"] for r in table) == 1 and table[-1]["auroc"] == 0.5
    found = model.predict(rows(spark)).groupBy("score").agg(F.min("x"), F.max("x")).orderBy("score").collect()
    assert 2 <= len(found) <= 8 and abs(found[-1][1] - 0.7) < 0.05


def test_grid_prefers_the_deeper_tree(spark):
    table, best = models.grid_search_cv(rows(spark), ["x", "z"], DecisionTreeClassifier(seed=1), {"maxDepth": [0, 2]}, folds=3, repeats=1)
    assert best == {"maxDepth": 2} and {r.maxDepth: r.auroc for r in table.collect()}["0"] == 0.5
