"""Pruning paths against a search over all subtrees."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from siftward.models import pruning
from siftward.models.pruning import Tree, weakest_links
from siftward.models.staged import prefix_accuracies


def random_tree(seed, depth=4):
    draw = random.Random(seed)
    left, right, stats = [], [], []

    def grow(rows, level):
        node = len(left)
        left.append(-1), right.append(-1), stats.append((sum(rows), len(rows)))
        if level < depth and len(rows) > 2 and draw.random() < 0.85:
            k = draw.randrange(1, len(rows))
            left[node] = grow(rows[:k], level + 1)
            right[node] = grow(rows[k:], level + 1)
        return node

    grow([draw.random() < 0.4 for _ in range(40)], 0)
    p = np.array([s / n for s, n in stats])
    n = np.array([float(n) for _, n in stats])
    return Tree(np.array(left), np.array(right), n, 2 * p * (1 - p), (p > 0.5).astype(float))


def subtrees(tree, node=0):
    """Leaves of every subtree with this root."""
    out = [(node,)]
    if tree.left[node] >= 0:
        out += [a + b for a in subtrees(tree, tree.left[node]) for b in subtrees(tree, tree.right[node])]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_path_is_the_best_of_all_subtrees(seed):
    tree = random_tree(seed)
    found = weakest_links(tree)
    every = [(sum(tree.cost[x] for x in leaves), leaves) for leaves in subtrees(tree)]
    strengths = [s for s, _, _ in found.path]
    assert strengths == sorted(set(strengths)) and found.path[-1][1] == 1
    between = [(a + b) / 2 for a, b in zip(strengths, [*strengths[1:], strengths[-1] + 1])]
    for strength, (_, n_leaves, cost) in zip(between, found.path):
        least = min(c + strength * len(leaves) for c, leaves in every)
        best = [(len(leaves), leaves, c) for c, leaves in every if c + strength * len(leaves) < least + 1e-12]
        n, leaves, c = min(best)
        assert (n_leaves, tuple(sorted(found.leaves(strength)))) == (n, tuple(sorted(leaves)))
        assert cost == pytest.approx(c)


@pytest.fixture(scope="module")
def fitted(spark):
    draw = random.Random(4)
    rows = []
    for i in range(600):
        x = [float(i % 3), float(i % 7), draw.random()]
        rows.append((float(draw.random() < 0.2 + 0.4 * (x[0] == 0) + 0.2 * (x[2] > 0.6)), Vectors.dense(x)))
    frame = spark.createDataFrame(rows, ["label", "features"]).repartition(3).cache()
    return frame, DecisionTreeClassifier(maxDepth=8, minInstancesPerNode=5, seed=1).fit(frame)


@pytest.mark.parametrize("least_split", [0, 20])
def test_strengths_judged_together_equal_pruned_models(fitted, spark, least_split):
    rows, model = fitted
    found = pruning.pruning_of(model, least_split)
    strengths = [0.0, 0.001, 0.003, 0.01, 0.02, 0.1]
    got = {r["strength"]: (r["n_rows"], r["n_right"]) for r in pruning.accuracies(model, found, rows, strengths).collect()}
    sizes = []
    for strength in strengths:
        small = pruning.pruned_model(model, found, strength)
        right = small.transform(rows).where(F.col("label") == F.col("prediction")).count()
        assert got[strength] == (600, right)
        sizes.append(small.numNodes)
        assert (small.numNodes + 1) // 2 == len(found.leaves(strength))
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1] == 1


def test_node_table_states_the_tree(fitted):
    rows, model = fitted
    nodes = pruning.node_table(model).orderBy("id").collect()
    assert len(nodes) == model.numNodes and nodes[0]["n_rows"] == 600
    p = rows.where("label = 1").count() / 600
    assert nodes[0]["impurity"] == pytest.approx(2 * p * (1 - p))
    path = pruning.path_rows(rows.sparkSession, pruning.pruning_of(model)).orderBy("step").collect()
    assert path[-1]["n_leaves"] == 1 and path[-1]["cost"] == pytest.approx(2 * p * (1 - p))


def test_prefixes_equal_fits_of_fewer_rounds(fitted):
    rows, _ = fitted
    stage = GBTClassifier(maxDepth=3, stepSize=0.2, seed=3)
    got = {r["rounds"]: (r["n_rows"], r["n_right"]) for r in prefix_accuracies(stage.setParams(maxIter=6).fit(rows), rows).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    for rounds in (1, 3, 6):
        model = stage.setParams(maxIter=rounds).fit(rows)
        assert got[rounds] == (600, model.transform(rows).where("label = prediction").count())
