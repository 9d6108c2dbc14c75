"""Trees grown by tasks that hold the whole table."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from siftward.models import dealt, train as training
from siftward.models.train import Budget, Settings
from siftward.queries import QUERIES, model_queries


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    listed = []
    for i in range(160):
        label = int(i % 3 == 0)
        x = [draw.gauss(1.5 * label, 1), draw.randrange(5), draw.gauss(0, 1), draw.randrange(20)]
        listed.append((f"p{i}", float(label), Vectors.dense(x)))
    return spark.createDataFrame(listed, ["pkg_name", "label", "features"]).repartition(3).cache()


def test_first_split_is_the_best_of_all():
    draw = np.random.default_rng(2)
    bins, labels = draw.integers(0, 6, (80, 3)).astype(np.uint8), draw.integers(0, 2, 80).astype(float)
    weight = draw.poisson(1.0, 80).astype(float)
    found = dealt.grow(bins, np.arange(80), np.zeros(80, int), weight, labels, 1, 1, 5)

    def impurity(mask):
        w = weight[mask].sum()
        p = (weight * labels)[mask].sum() / w
        return w * 2 * p * (1 - p)

    every = {}
    for f in range(3):
        for c in range(5):
            left = bins[:, f] <= c
            if weight[left].sum() >= 5 and weight[~left].sum() >= 5:
                every[f, c] = impurity(np.full(80, True)) - impurity(left) - impurity(~left)
    best = max(every, key=every.get)
    assert (found.feature[0], found.cut[0]) == best
    assert 2 * found.gains.sum() == pytest.approx(every[best])
    left = bins[:, best[0]] <= best[1]
    assert found.value[1] == pytest.approx((weight * labels)[left].sum() / weight[left].sum())


def test_trees_grown_together_are_those_grown_alone():
    draw = np.random.default_rng(4)
    bins, labels = draw.integers(0, 9, (60, 4)).astype(np.uint8), draw.integers(0, 2, 60).astype(float)
    weight = draw.poisson(1.0, (3, 60)).astype(float)
    tree, row = np.nonzero(weight)
    together = dealt.grow(bins, row, tree, weight[tree, row], labels[row], 3, 30, 1)
    alone = [dealt.grow(bins, np.arange(60), np.zeros(60, int), w, labels, 1, 30, 1) for w in weight]
    assert len(together.feature) == sum(len(t.feature) for t in alone)
    assert together.votes(bins).tolist() == pytest.approx(sum(t.votes(bins) for t in alone).tolist())
    # All rows of a tree are told where no two are alike in all features.
    _, at = np.unique(bins, axis=0, return_inverse=True)
    pure = np.array([len(set(labels[at == k])) == 1 for k in at])
    assert ((alone[0].votes(bins) == labels) | ~pure | (weight[0] == 0)).all()


def test_boosting_is_that_of_spark(spark, rows):
    # Of few values, so that both cut alike.
    few = rows.withColumn("features", F.col("features")).where("label is not null")
    shared = dealt.shared_rows(few)
    values, labels, _ = dealt.read_rows(shared)
    values = np.round(values * 2) / 2
    listed = [(f"p{k}", float(y), Vectors.dense(x)) for k, (x, y) in enumerate(zip(values.tolist(), labels))]
    frame = spark.createDataFrame(listed, ["pkg_name", "label", "features"])
    model = training._boosting().setParams(maxIter=6, maxDepth=3, stepSize=0.2).fit(frame)
    said = {r["pkg_name"]: r["m"] for r in model.transform(frame).select("pkg_name", vector_to_array("boosting_raw")[1].alias("m")).collect()}
    bins = dealt.binned(values, dealt.cuts_of(values))
    margin = sum(t.votes(bins) for t in dealt.boosted(bins, labels, 6, 0.2, 3))
    assert margin.tolist() == pytest.approx([said[f"p{k}"] for k in range(len(labels))], rel=1e-6)


def test_many_trees_are_dealt_out(spark, rows, tmp_path, monkeypatch):
    """A large forest needs no pass of Spark over the rows for every level of its nodes."""
    fitted = []
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, frame: fitted.append(self))
    (stage,) = training.classifier_stages("random_forest", 160, Settings(forest_trees=60))
    model = stage.fit(rows)
    assert not fitted and isinstance(model, dealt.DealtForestModel) and model.trees == 60
    blocks = list(dealt._blocks(model.files))
    assert sum(b.n for b in blocks) == 60 and len(blocks) > 1
    got = {r["pkg_name"]: r for r in model.transform(rows).collect()}
    assert len(got) == 160
    bins = {r["pkg_name"]: dealt.binned(r["features"].toArray()[None], [np.array(c) for c in model.cuts])[0] for r in rows.collect()}
    for name in ("p0", "p1", "p77"):
        votes = 0.0
        for b in blocks:
            for node in range(b.n):
                while b.feature[node] >= 0:
                    node = b.left[node] + int(bins[name][b.feature[node]] > b.cut[node])
                votes += b.value[node]
        row = got[name]
        assert row["random_forest_raw"].toArray().tolist() == pytest.approx([60 - votes, votes])
        assert row["random_forest_probability"][1] == pytest.approx(votes / 60)
        assert row["random_forest_prediction"] == float(votes > 30)
    assert sum(r["random_forest_prediction"] == r["label"] for r in got.values()) > 150
    assert model.featureImportances.toArray().sum() == pytest.approx(1.0)
    # The rows' layout does not matter, and the model is saved and read again.
    again = stage.fit(rows.repartition(7))
    PipelineModel([model]).write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    for other in (again, loaded):
        assert {r["pkg_name"]: r["random_forest_raw"] for r in other.transform(rows).collect()} == {
            n: r["random_forest_raw"] for n, r in got.items()
        }


def test_rows_that_no_task_can_hold(rows, monkeypatch):
    monkeypatch.setattr(dealt, "CELLS", 639)
    assert dealt.shared_rows(rows) is None
    monkeypatch.setattr(dealt, "CELLS", 640)
    assert dealt.shared_rows(rows)
    assert dealt.shared_rows(rows.withColumn("label", F.lit(2.0))) is None
    assert dealt.shared_rows(rows.limit(0)) is None


def test_searches_without_room_in_a_task(rows, monkeypatch):
    budget = Budget(
        tree_strengths=(0.0,), tree_folds=2, forest_widths=(1, 3), forest_trees=4, forest_folds=2, boosting_draws=1,
        boosting_rounds=(2, 3), boosting_folds=2,
    )
    near = [training.tune_forest(rows, budget), training.tune_boosting(rows, budget)]
    monkeypatch.setattr(dealt, "CELLS", 0)
    far = [training.tune_forest(rows, budget), training.tune_boosting(rows, budget)]
    for a, b in zip(near, far):
        assert len(a.scores) == len(b.scores) and all(0.4 < s <= 1 for s in a.scores + b.scores)
    assert near[1].settings == far[1].settings


def test_tuned_comparison_searches_all(spark, monkeypatch):
    """Every setting, fold, tree and round of the full search."""
    budgets = []
    whole = model_queries.compare_models
    small = Budget(tree_folds=2, forest_widths=(2,), forest_trees=2, forest_folds=2, boosting_draws=1, boosting_rounds=(2, 2), boosting_folds=2)

    def compared(train, test, names, budget):
        budgets.append(budget)
        return whole(train, test, names, budget=small)

    monkeypatch.setattr(model_queries, "compare_models", compared)
    assert QUERIES["tuned_comparison"](spark, "/root/testdata/sf0.001").count() == 3
    (asked,) = budgets
    assert asked == Budget() and len(asked.forest_widths) * asked.forest_folds * asked.forest_trees == 45_000
    assert asked.boosting_draws * asked.boosting_folds == 250 and asked.boosting_rounds == (50, 299)
    assert len(asked.tree_strengths) * asked.tree_folds == 2010
