"""Classifiers, their vote, their tuning and their comparison."""

import random
from collections import defaultdict
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from siftward.models.calibrate import CalibratedSVC
from siftward.models.dealt import boosting_scores, forest_scores, shared_rows
from siftward.models.encode import encoder, feature_places
from siftward.models.evaluate import accuracy, recall, roc_auc, roc_points
from siftward.models.forest import ForestInParts
from siftward.models.pruning import accuracies, pruned_model, pruning_of
from siftward.models.split import in_folds, stratified_split
from siftward.models.staged import prefix_accuracies
from siftward.session import cut_lineage

SEED = 42
VOTERS = ("decision_tree", "log_reg", "random_forest", "svm")
MEASURES = ("train_accuracy", "test_accuracy", "train_recall", "test_recall", "test_auc")


# --- fixed values: sizes of the models and ranges of the searches ----------------


@dataclass(frozen=True)
class Settings:
    """Sizes of the models; the defaults are those of the full training.

    Trees have no depth limit there; 30 is the most Spark allows.
    """

    forest_trees: int = 200
    tree_depth: int = 30
    forest_depth: int = 30
    boosting_rounds: int = 100
    boosting_depth: int = 3
    boosting_step: float = 0.1
    max_iterations: int = 1000
    logistic_tolerance: float = 1e-4
    svm_tolerance: float = 1e-3
    voters: Sequence[str] = field(default=VOTERS)


def _outputs(name: str) -> dict[str, str]:
    return {
        "rawPredictionCol": f"{name}_raw",
        "predictionCol": f"{name}_prediction",
    }


def classifier_stages(name: str, n_rows: int, settings: Settings = Settings()) -> list:
    """Unfitted stages of one classifier, ending in ``<name>_probability``."""
    probability = {"probabilityCol": f"{name}_probability"}
    common = _outputs(name)
    # A penalty of 1 per fit, which Spark wants per row.
    penalty = 1.0 / max(n_rows, 1)
    if name == "log_reg":
        return [
            LogisticRegression(
                maxIter=settings.max_iterations, tol=settings.logistic_tolerance,
                regParam=penalty, standardization=False, **common, **probability,
            )
        ]
    if name == "svm":
        machine = LinearSVC(
            maxIter=settings.max_iterations, tol=settings.svm_tolerance,
            regParam=penalty, standardization=False, **common,
        )
        return [CalibratedSVC(machine, seed=SEED)]
    if name == "decision_tree":
        return [
            DecisionTreeClassifier(
                maxDepth=settings.tree_depth, seed=SEED, cacheNodeIds=True, **common,
                **probability,
            )
        ]
    if name == "random_forest":
        forest = RandomForestClassifier(
            numTrees=settings.forest_trees, maxDepth=settings.forest_depth, seed=SEED,
            cacheNodeIds=True, **common, **probability,
        )
        return [ForestInParts(forest, n_rows)]
    if name == "boosting":
        return [
            _boosting().setParams(
                maxIter=settings.boosting_rounds, maxDepth=settings.boosting_depth,
                stepSize=settings.boosting_step,
            )
        ]
    raise ValueError(f"unknown classifier: {name}")


def _boosting() -> GBTClassifier:
    stage = GBTClassifier(seed=SEED, predictionCol="boosting_prediction")
    return stage.setRawPredictionCol("boosting_raw").setProbabilityCol("boosting_probability")


def spam_probability(name: str) -> Column:
    return vector_to_array(F.col(f"{name}_probability"))[1]


def soft_vote(predicted: DataFrame, voters: Sequence[str] = VOTERS) -> DataFrame:
    """Mean probability of the voters; an even vote goes to class 0."""
    mean = sum((spam_probability(v) for v in voters), F.lit(0.0)) / len(voters)
    return predicted.withColumn("prediction_score", mean).withColumn(
        "prediction", (F.col("prediction_score") > 0.5).cast("double")
    )


def split_features(
    features: DataFrame, key: str = "pkg_name", test_share: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, both with a numeric ``label``.

    Averaged labels count as their whole part, so a package is spam if all its labels say so. Rows without a
    label cannot be learnt from or judged and are left out. The marked rows are stored, since
    training reads them again and again.
    """
    whole = features.filter("is_spam is not null").withColumn("is_spam", F.col("is_spam").cast("int"))
    marked = cut_lineage(
        stratified_split(whole, key, "is_spam", test_share, SEED).withColumn(
            "label", F.col("is_spam").cast("double")
        )
    )
    return (
        marked.filter("is_test = false").drop("is_test"),
        marked.filter("is_test").drop("is_test"),
    )


def _labelled(train: DataFrame) -> DataFrame:
    return train.drop("label", "key")


# Every iteration runs one task per partition, which should be worth its start. Each adds up all nodes of a level on its own, so
# more tasks than cores cost as much again; they come where a task would have more rows than the most.
ROWS_PER_TASK = 1000
MOST_ROWS = 200_000


@contextmanager
def stored(rows: DataFrame):
    """Rows kept in memory, in partitions of a fair size, with their number."""
    kept = rows.persist()
    try:
        n_rows = kept.count()
        have = kept.rdd.getNumPartitions()
        cores = rows.sparkSession.sparkContext.defaultParallelism
        tasks = max(min(cores, n_rows // ROWS_PER_TASK + 1), n_rows // MOST_ROWS + 1)
        yield kept.coalesce(tasks) if tasks <= have else kept.repartition(tasks), n_rows
    finally:
        kept.unpersist()


def train_ensemble(train: DataFrame, settings: Settings = Settings()) -> PipelineModel:
    """Encoding and all voters, fitted in one go on training rows."""
    encoding = encoder(_labelled(train))
    with stored(encoding.transform(train)) as (rows, n_rows):
        # None needs what another says, and to ask a large forest takes as many jobs as it has parts.
        fitted = [s.fit(rows) for v in settings.voters for s in classifier_stages(v, n_rows, settings)]
    # A classifier of several stages is a pipeline within; models are kept as one list of stages.
    flat = [s for f in fitted for s in (f.stages if isinstance(f, PipelineModel) else [f])]
    return PipelineModel([*encoding.stages, *flat])


def ensemble_scores(
    model: PipelineModel, rows: DataFrame, voters: Sequence[str] = VOTERS
) -> DataFrame:
    return soft_vote(model.transform(rows), voters)


# --- tuning ----------------------------------------------------------------


@dataclass(frozen=True)
class Budget:
    """How much to search; the defaults are those of the full search."""

    tree_strengths: Sequence[float] = tuple(i * 0.1 / 200 for i in range(201))
    tree_folds: int = 10
    tree_least_split: int = 20
    forest_widths: Sequence[int] = tuple(range(1, 19))
    forest_trees: int = 500
    forest_folds: int = 5
    boosting_draws: int = 50
    boosting_rounds: tuple[int, int] = (50, 299)
    boosting_steps: tuple[float, float] = (0.01, 0.21)
    boosting_depths: tuple[int, int] = (2, 4)
    boosting_folds: int = 5
    parallelism: int = 4


@dataclass(frozen=True)
class Search:
    """The settings tried, the mean accuracy of each over the folds, and the best one's model of all rows."""

    settings: list[dict]
    scores: list[float]
    bestModel: Model

    @property
    def best(self) -> int:
        """The first of the highest scores."""
        return max(range(len(self.scores)), key=self.scores.__getitem__)


def _search(stage, grid: list, folds: int, parallelism: int) -> CrossValidator:
    judge = MulticlassClassificationEvaluator(
        predictionCol=stage.getPredictionCol(), metricName="accuracy"
    )
    return CrossValidator(
        estimator=stage, estimatorParamMaps=grid, evaluator=judge, numFolds=folds,
        seed=SEED, parallelism=parallelism,
    )


def _searched(stage, grid: list, rows: DataFrame, folds: int, parallelism: int) -> Search:
    fitted = _search(stage, grid, folds, parallelism).fit(rows)
    settings = [{p.name: v for p, v in s.items()} for s in fitted.getEstimatorParamMaps()]
    return Search(settings, list(fitted.avgMetrics), fitted.bestModel)


def tune_tree(encoded: DataFrame, budget: Budget = Budget(), key: str = "pkg_name") -> Search:
    """Search for the strength of cost-complexity pruning: one fit a fold judges all strengths."""
    tree = DecisionTreeClassifier(
        maxDepth=30, minInstancesPerNode=5, seed=SEED, probabilityCol="decision_tree_probability",
        **_outputs("decision_tree"),
    )
    folded = in_folds(encoded, key, budget.tree_folds, SEED)

    def judged(fold: int) -> list:
        model = tree.fit(folded.where(F.col("fold") != fold))
        pruning = pruning_of(model, budget.tree_least_split)
        held = folded.where(F.col("fold") == fold)
        return accuracies(model, pruning, held, budget.tree_strengths).collect()

    shares = defaultdict(list)
    with ThreadPool(budget.parallelism) as pool:
        for rows in pool.map(judged, range(budget.tree_folds)):
            for row in rows:
                # A fold without rows judges nothing.
                if row["n_rows"]:
                    shares[row["strength"]].append(row["n_right"] / row["n_rows"])
    scores = [sum(shares[s]) / len(shares[s]) for s in map(float, budget.tree_strengths)]
    found = Search([{"strength": float(s)} for s in budget.tree_strengths], scores, None)
    whole = tree.fit(encoded)
    best = pruned_model(
        whole, pruning_of(whole, budget.tree_least_split), found.settings[found.best]["strength"]
    )
    return Search(found.settings, scores, best)


def tune_forest(encoded: DataFrame, budget: Budget = Budget(), key: str = "pkg_name") -> Search:
    """Search for how many features a split may look at.

    Where a task can hold the rows, every fit of a width and fold is a task of its own.
    """
    forest = RandomForestClassifier(
        numTrees=budget.forest_trees, maxDepth=30, minInstancesPerNode=5, seed=SEED,
        probabilityCol="random_forest_probability", **_outputs("random_forest"),
    )
    widths = [str(w) for w in budget.forest_widths]
    shared = shared_rows(encoded, budget.forest_folds, key, SEED)
    if not shared:
        grid = ParamGridBuilder().addGrid(forest.featureSubsetStrategy, widths).build()
        return _searched(forest, grid, encoded, budget.forest_folds, budget.parallelism)
    shares = defaultdict(list)
    for number, _, n_rows, n_right in forest_scores(
        shared, widths, forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode(), budget.forest_folds, SEED
    ):
        shares[number].append(n_right / n_rows)
    settings = [{"featureSubsetStrategy": w} for w in widths]
    scores = [sum(shares[k]) / len(shares[k]) if shares[k] else 0.0 for k in range(len(widths))]
    found = Search(settings, scores, None)
    best = forest.copy({forest.featureSubsetStrategy: widths[found.best]})
    return Search(settings, scores, ForestInParts(best, encoded.count()).fit(encoded))


def tune_boosting(encoded: DataFrame, budget: Budget = Budget(), key: str = "pkg_name") -> Search:
    """Random search over step and depth, with every number of rounds up to the drawn one; refitted on all rows.

    One fit a draw and fold judges all its numbers of rounds; folds are fitted side by side, each by a task of its own where
    a task can hold the rows.
    """
    draw = random.Random(SEED)
    draws = [
        (
            draw.randint(*budget.boosting_rounds),
            draw.uniform(*budget.boosting_steps),
            draw.randint(*budget.boosting_depths),
        )
        for _ in range(budget.boosting_draws)
    ]
    least = budget.boosting_rounds[0]
    shared = shared_rows(encoded, budget.boosting_folds, key, SEED)
    folded = in_folds(encoded, key, budget.boosting_folds, SEED)

    def judged(task: tuple[int, int]) -> list[tuple[int, int, float]]:
        number, fold = task
        rounds, step, depth = draws[number]
        stage = _boosting().setParams(maxIter=rounds, stepSize=step, maxDepth=depth)
        model = stage.fit(folded.where(F.col("fold") != fold))
        held = prefix_accuracies(model, folded.where(F.col("fold") == fold))
        found = held.where(F.col("rounds") >= least).collect()
        return [(number, r["rounds"], r["n_right"] / r["n_rows"]) for r in found]

    shares = defaultdict(list)
    if shared:
        for number, rounds, n_rows, n_right in boosting_scores(shared, draws, least, budget.boosting_folds):
            shares[number, rounds].append(n_right / n_rows)
    else:
        tasks = [(d, f) for d in range(len(draws)) for f in range(budget.boosting_folds)]
        with ThreadPool(budget.parallelism) as pool:
            for rows in pool.imap(judged, tasks):
                for number, rounds, share in rows:
                    shares[number, rounds].append(share)
    settings = [{"maxIter": m, "stepSize": draws[d][1], "maxDepth": draws[d][2]} for d, m in sorted(shares)]
    scores = [sum(shares[k]) / len(shares[k]) for k in sorted(shares)]
    found = Search(settings, scores, None)
    return Search(settings, scores, _boosting().setParams(**settings[found.best]).fit(encoded))


def best_setting(search: Search) -> tuple[dict, float]:
    """Parameters with the highest mean score, and that score."""
    return search.settings[search.best], search.scores[search.best]


SEARCHES = {
    "decision_tree": tune_tree,
    "random_forest": tune_forest,
    "boosting": tune_boosting,
}

# --- comparison --------------------------------------------------------------


def compare_models(
    train: DataFrame, test: DataFrame, names: Sequence[str] = (*VOTERS, "boosting"),
    settings: Settings = Settings(), budget: Budget | None = None,
) -> DataFrame:
    """Accuracy, recall and area per model, each on its own predictions.

    With a budget, tree, forest and boosting are the best of a search.
    """
    encoding = encoder(_labelled(train))
    rows = []
    with (
        stored(encoding.transform(train)) as (fitting, n_rows),
        stored(encoding.transform(test)) as (held_out, _),
    ):
        for name in names:
            if budget and name in SEARCHES:
                model = PipelineModel([SEARCHES[name](fitting, budget).bestModel])
            else:
                model = Pipeline(stages=classifier_stages(name, n_rows, settings)).fit(fitting)
            rows.append((name, *_measures(model, fitting, held_out, name)))
    types = ", ".join(f"{m} double" for m in MEASURES)
    return train.sparkSession.createDataFrame(rows, f"model string, {types}").select(
        "model", *(F.round(m, 3).alias(m) for m in MEASURES)
    )


def _measures(model: PipelineModel, train: DataFrame, test: DataFrame, name: str) -> tuple:
    said = f"{name}_prediction"
    seen = model.transform(train).agg(
        accuracy(prediction=said).alias("a"), recall(prediction=said).alias("r")
    ).first()
    unseen = model.transform(test)
    held = unseen.agg(
        accuracy(prediction=said).alias("a"), recall(prediction=said).alias("r")
    ).first()
    scored = unseen.select("label", spam_probability(name).alias("score"))
    area = roc_auc(roc_points(scored)).first()["auc"]
    return seen["a"], held["a"], seen["r"], held["r"], area


def feature_importances(
    train: DataFrame, top: int = 15, settings: Settings = Settings()
) -> DataFrame:
    """The features a forest relies on most, with their share."""
    encoding = encoder(_labelled(train))
    with stored(encoding.transform(train)) as (rows, n_rows):
        (forest,) = classifier_stages("random_forest", n_rows, settings)
        model = forest.fit(rows)
    shares = enumerate(model.featureImportances.toArray().tolist())
    frame = train.sparkSession.createDataFrame(list(shares), "place int, importance double")
    named = feature_places(encoding).join(frame, "place").select("feature", "importance")
    return named.orderBy(F.desc("importance"), "feature").limit(top)
