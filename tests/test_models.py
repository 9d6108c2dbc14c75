"""Split, encoding, training and evaluation."""

import math
import random
from collections import Counter

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import functions as F

from siftward.models import forest, train as training
from siftward.models.encode import category_table, encoder, feature_places, split_columns
from siftward.models.calibrate import CalibratedSVC
from siftward.models.evaluate import classification_report, roc_auc, roc_points
from siftward.models.split import in_folds, stratified_split
from siftward.models.train import Budget, Settings
from siftward.plans.training import train_and_judge

SMALL = Settings(forest_trees=5, boosting_rounds=3, max_iterations=30)


@pytest.fixture(scope="module")
def features(spark):
    draw = random.Random(6)
    rows = []
    for i in range(300):
        spam = int(i % 4 == 0)
        host = draw.choice(["github", "gitlab", "unknown"]) if not spam else "unknown"
        rows.append((f"p{i}", host, draw.gauss(2.0 * spam, 1.0), draw.randrange(10), bool(i % 2), spam))
    return spark.createDataFrame(
        rows, "pkg_name string, cat_repo_host string, x double, n int, has_it boolean, is_spam int"
    ).cache()


def test_split_is_exact_and_stable(features):
    first = {r["pkg_name"]: r["is_test"] for r in stratified_split(features, "pkg_name").collect()}
    again = {r["pkg_name"]: r["is_test"] for r in stratified_split(features.repartition(7), "pkg_name").collect()}
    assert first == again and len(first) == 300
    labels = {r["pkg_name"]: r["is_spam"] for r in features.collect()}
    assert Counter(labels[n] for n, t in first.items() if t) == {0: 45, 1: 15}
    other = stratified_split(features, "pkg_name", seed=7).filter("is_test").count()
    assert other == 60


def test_split_keeps_rows_without_label(spark):
    frame = spark.createDataFrame([("a", None), ("b", 1), ("c", 1)], "pkg_name string, is_spam int")
    assert stratified_split(frame, "pkg_name").count() == 3


def test_encoding(features):
    texts, numbers = split_columns(features)
    assert (texts, numbers) == (["cat_repo_host"], ["x", "n", "has_it"])
    table = category_table(features, texts).orderBy("number").collect()
    assert [(r["value"], r["number"]) for r in table] == [("github", 0), ("gitlab", 1), ("unknown", 2)]
    assert sum(r["n"] for r in table) == 300
    encoding = encoder(features)
    assert [r["feature"] for r in feature_places(encoding).orderBy("place").collect()] == [
        "cat_repo_host_gitlab", "cat_repo_host_unknown", "x", "n", "has_it",
    ]
    rows = [r["features"].toArray() for r in encoding.transform(features).collect()]
    for i in range(5):
        values = [r[i] for r in rows]
        mean = sum(values) / 300
        # Entries of categories stay sparse; numbers are moved to mean 0.
        assert min(values) == 0 if i < 2 else mean == pytest.approx(0.0, abs=1e-9)
        assert math.sqrt(sum((v - mean) ** 2 for v in values) / 300) == pytest.approx(1.0)


def test_unseen_category_and_constant(spark, features):
    plain = encoder(features.withColumn("same", F.lit(3)), scale=False)
    unseen = spark.createDataFrame(
        [("z", "new'host", 1.0, 2, True, 0, 3)],
        "pkg_name string, cat_repo_host string, x double, n int, has_it boolean, is_spam int, same int",
    )
    assert plain.transform(unseen).first()["features"].toArray().tolist() == [0, 0, 1, 2, 1, 3]
    scaled = encoder(features.withColumn("same", F.lit(3))).transform(unseen)
    assert scaled.first()["features"].toArray()[-1] == 0.0


def test_many_categories(spark, tmp_path):
    """More categories than any list in a plan or on the driver could hold; most rows share one."""
    n = 200_000
    rows = spark.range(0, 2 * n, numPartitions=4).select(
        F.concat(F.lit("p"), "id").alias("pkg_name"),
        F.when(F.col("id") < n, F.format_string("v%06d", "id")).otherwise("v000007").alias("kind"),
        F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id") % 4).cast("double").alias("x"),
        ((F.col("id") % 10 == 0) | (F.col("id") == 5)).cast("int").alias("is_spam"),
    )
    encoding = encoder(rows)
    indexer = encoding.stages[0]
    assert indexer.sizes == [n] and feature_places(encoding).count() == n
    encoding.write().save(str(tmp_path / "encoding"))
    encoded = PipelineModel.load(str(tmp_path / "encoding")).transform(rows)
    some = {r["pkg_name"]: r["features"] for r in encoded.where("pkg_name in ('p0', 'p5', 'p300000')").collect()}
    assert all(isinstance(v, SparseVector) and v.size == n for v in some.values())
    # The first category has no entry.
    assert [i for i in some["p0"].indices if i < n - 1] == []
    assert [i for i in some["p5"].indices if i < n - 1] == [4] and [i for i in some["p300000"].indices if i < n - 1] == [6]
    labelled = encoded.withColumn("label", F.col("is_spam").cast("double"))
    model = LogisticRegression(maxIter=2, regParam=1e-3).fit(labelled)
    assert model.transform(labelled).agg(F.count("prediction")).first()[0] == 2 * n


def test_ensemble(features, spark, tmp_path):
    model, scored, report = train_and_judge(features, settings=SMALL)
    rows = scored.collect()
    assert len(rows) == 60
    for row in rows:
        assert 0.0 <= row["prediction_score"] <= 1.0
        assert row["prediction"] == float(row["prediction_score"] > 0.5)
        each = [row[f"{v}_probability"][1] for v in training.VOTERS]
        assert row["prediction_score"] == pytest.approx(sum(each) / 4)
    by_class = {r["class"]: r for r in report.collect()}
    assert by_class["0"]["support"] == 45 and by_class["1"]["support"] == 15
    assert by_class["weighted avg"]["recall"] > 0.7
    model.write().save(str(tmp_path / "model"))
    loaded = training.ensemble_scores(PipelineModel.load(str(tmp_path / "model")), features.limit(5))
    direct = training.ensemble_scores(model, features.limit(5))
    assert [r["prediction_score"] for r in loaded.collect()] == pytest.approx(
        [r["prediction_score"] for r in direct.collect()]
    )


def test_comparison_and_importances(features):
    train, test = training.split_features(features)
    rows = training.compare_models(train, test, settings=SMALL).collect()
    assert [r["model"] for r in rows] == [*training.VOTERS, "boosting"]
    for row in rows:
        assert all(0.0 <= row[m] <= 1.0 for m in training.MEASURES)
        assert row["test_auc"] > 0.6
    top = training.feature_importances(train, top=3, settings=SMALL).collect()
    assert len(top) == 3 and top[0]["importance"] >= top[1]["importance"]
    with pytest.raises(ValueError):
        training.classifier_stages("oracle", 1)


def test_forest_in_parts(features, spark, tmp_path, monkeypatch):
    """Only some trees are fitted or asked at once; votes and importances are those of all trees."""
    train, test = training.split_features(features)
    encoding = encoder(train.drop("label"))
    rows = encoding.transform(train).cache()
    (stage,) = training.classifier_stages("random_forest", rows.count(), SMALL)
    assert isinstance(stage.fit(rows), RandomForestClassificationModel)
    monkeypatch.setattr(forest, "PART_NODES", 150)
    fitted = []
    fit = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, frame: fitted.append(fit(self, frame)) or fitted[-1])
    model = stage.fit(rows)
    assert len(fitted) == len(model.paths) > 1 and sum(m.getNumTrees for m in fitted) == 5
    assert all(m.totalNumNodes <= 150 or m.getNumTrees == 1 for m in fitted)
    assert len({t.toDebugString for m in fitted for t in m.trees}) > 1
    asked = encoding.transform(test)
    got = {r["pkg_name"]: r for r in model.transform(asked).collect()}
    assert len(got) == test.count() == 60
    votes = Counter()
    for m in fitted:
        for r in m.transform(asked).collect():
            votes[r["pkg_name"], 0] += r["random_forest_raw"][0]
            votes[r["pkg_name"], 1] += r["random_forest_raw"][1]
    for name, row in got.items():
        assert row["random_forest_raw"].toArray().tolist() == pytest.approx([votes[name, 0], votes[name, 1]])
        assert row["random_forest_probability"][1] == pytest.approx(votes[name, 1] / 5)
        assert row["random_forest_prediction"] == float(votes[name, 1] > votes[name, 0])
    each = [t.featureImportances.toArray() for m in fitted for t in m.trees]
    assert model.featureImportances.toArray().tolist() == pytest.approx((sum(each) / 5).tolist())
    # As a stage among others it is saved and read again.
    whole = training.train_ensemble(train, SMALL)
    whole.write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert any(isinstance(s, forest.PartedForestModel) for s in loaded.stages)
    scores = [{r["pkg_name"]: r["prediction_score"] for r in training.ensemble_scores(m, test).collect()} for m in (whole, loaded)]
    assert scores[0] == pytest.approx(scores[1]) and len(scores[0]) == 60
    assert training.feature_importances(train, settings=SMALL).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_tasks_of_training(spark, monkeypatch):
    """Each task adds up all nodes by itself, so tasks do not become more with the parts of the table."""
    monkeypatch.setattr(training, "ROWS_PER_TASK", 10)
    cores = spark.sparkContext.defaultParallelism

    def tasks(n, parts):
        with training.stored(spark.range(0, n, 1, parts)) as (rows, count):
            assert count == rows.count() == n
            return rows.rdd.getNumPartitions()

    assert tasks(1000, 40) == tasks(1000, 1) == cores and tasks(5, 40) == 1
    monkeypatch.setattr(training, "MOST_ROWS", 100)
    assert tasks(1000, 40) == 11


def test_tuning(features):
    train, _ = training.split_features(features)
    encoded = encoder(train.drop("label")).transform(train).cache()
    budget = Budget(
        tree_strengths=(0.0, 0.05), tree_folds=2, forest_widths=(1, 3), forest_trees=3, forest_folds=2,
        boosting_draws=2, boosting_rounds=(2, 3), boosting_folds=2,
    )
    search = training.tune_tree(encoded, budget)
    strength, score = training.best_setting(search)
    assert strength["strength"] in budget.tree_strengths and 0.5 < score <= 1 and score == max(search.scores)
    width, _ = training.best_setting(training.tune_forest(encoded, budget))
    assert width["featureSubsetStrategy"] in ("1", "3")
    draw, _ = training.best_setting(training.tune_boosting(encoded, budget))
    assert draw["maxIter"] in (2, 3) and 0.01 <= draw["stepSize"] <= 0.21 and 2 <= draw["maxDepth"] <= 4
    _, test = training.split_features(features)
    tuned = training.compare_models(
        train, test, ("decision_tree", "random_forest", "boosting"), SMALL, budget
    ).collect()
    assert len(tuned) == 3 and all(r["test_auc"] >= 0.5 for r in tuned)
    assert len(Budget().tree_strengths) == 201 and len(Budget().forest_widths) == 18


def svm_rows(spark, n, noise, seed):
    """Few rows for many features, so that a machine is far surer of its own rows than of others."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        label = i % 3 == 0
        x = [draw.gauss(1.2 * label, 1.0)] + [draw.gauss(0, 1) for _ in range(noise)]
        rows.append((f"p{seed}-{i}", float(label), Vectors.dense(x)))
    return spark.createDataFrame(rows, ["pkg_name", "label", "features"])


def log_loss(rows, column):
    p = F.greatest(F.least(vector_to_array(column)[1], F.lit(1 - 1e-12)), F.lit(1e-12))
    return rows.agg(F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]


def test_calibrated_margins_beat_those_of_training_rows(spark):
    train, test = svm_rows(spark, 90, 40, 1).cache(), svm_rows(spark, 400, 40, 2).cache()
    machine = LinearSVC(
        rawPredictionCol="svm_raw", predictionCol="svm_prediction", regParam=1 / 90, maxIter=200, standardization=False
    )
    model = CalibratedSVC(machine).fit(train)
    judged = model.transform(test)
    own = machine.fit(train)
    curve = LogisticRegression(
        featuresCol="svm_raw", regParam=1 / 90, standardization=False, probabilityCol="old", rawPredictionCol="r", predictionCol="q"
    ).fit(own.transform(train))
    assert log_loss(judged, "svm_probability") < log_loss(curve.transform(own.transform(test)), "old") - 0.02
    p = vector_to_array("svm_probability")
    odd = judged.where((F.abs(p[0] + p[1] - 1) > 1e-9) | ((p[1] > p[0]) != (F.col("svm_curve") > 0.5))).count()
    assert odd == 0


def test_curve_equals_newton_steps(spark):
    train = svm_rows(spark, 120, 3, 5).cache()
    machine = LinearSVC(rawPredictionCol="svm_raw", predictionCol="svm_prediction", regParam=0.01, maxIter=100)
    model = CalibratedSVC(machine, folds=4).fit(train)
    marked = in_folds(train, "pkg_name", 4)
    pairs = []
    for fold in range(4):
        fitted = machine.fit(marked.where(F.col("fold") != fold)).transform(marked.where(F.col("fold") == fold))
        pairs += [(r["label"], r["svm_raw"][1]) for r in fitted.collect()]
    n_pos = sum(y == 1 for y, _ in pairs)
    high, low = (n_pos + 1) / (n_pos + 2), 1 / (len(pairs) - n_pos + 2)
    slope = offset = 0.0
    for _ in range(60):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for y, m in pairs:
            p = 1 / (1 + math.exp(-(slope * m + offset)))
            t, w = (high if y == 1 else low), p * (1 - p)
            g0, g1 = g0 + (p - t) * m, g1 + (p - t)
            h00, h01, h11 = h00 + w * m * m, h01 + w * m, h11 + w
        det = h00 * h11 - h01 * h01
        slope, offset = slope - (h11 * g0 - h01 * g1) / det, offset - (h00 * g1 - h01 * g0) / det
    curve = model.stages[2]
    assert curve.coefficients[0] == pytest.approx(slope, rel=1e-5) and curve.intercept == pytest.approx(offset, abs=1e-5)


def test_class_in_one_fold_only(spark):
    rows = [(f"p{i}", float(i == 0), Vectors.dense([float(i == 0), float(i % 3)])) for i in range(12)]
    train = spark.createDataFrame(rows, ["pkg_name", "label", "features"])
    machine = LinearSVC(rawPredictionCol="svm_raw", predictionCol="svm_prediction", maxIter=20)
    assert CalibratedSVC(machine).fit(train).transform(train).count() == 12


def test_report_and_roc(spark):
    draw = random.Random(8)
    rows = [(draw.randrange(2), draw.randrange(20) / 20) for _ in range(200)]
    frame = spark.createDataFrame(rows, "label int, score double").withColumn(
        "prediction", (F.col("score") > 0.5).cast("int")
    )
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    area = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    points = roc_points(frame)
    assert roc_auc(points).first()["auc"] == pytest.approx(area)
    for r in points.collect():
        assert r["tpr"] == pytest.approx(sum(s >= r["threshold"] for s in pos) / len(pos))
        assert r["fpr"] == pytest.approx(sum(s >= r["threshold"] for s in neg) / len(neg))
    report = {r["class"]: r for r in classification_report(frame).collect()}
    hits = sum(s > 0.5 for s in pos)
    claimed = hits + sum(s > 0.5 for s in neg)
    assert report["1"]["precision"] == pytest.approx(hits / claimed)
    assert report["1"]["recall"] == pytest.approx(hits / len(pos))
    assert report["macro avg"]["support"] == 200


def test_report_without_hits(spark):
    frame = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    report = {r["class"]: r for r in classification_report(frame).collect()}
    assert report["1"]["precision"] == 0.0 and report["1"]["f1"] == 0.0
