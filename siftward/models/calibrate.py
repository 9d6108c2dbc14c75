"""A linear support vector machine whose margins become probabilities by Platt's curve.

The curve is fitted on margins of rows the machine did not learn from: the rows are cut into folds, and each fold is scored by a
machine fitted on the others. Its targets are smoothed, (n + 1) / (n + 2) for class 1 and 1 / (n + 2) for class 0 with
n rows of the class, and maximum likelihood is found by Newton steps (iteratively reweighted least squares).
The machine itself is fitted on all rows.
"""

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from siftward.models.split import in_folds
from siftward.session import cut_lineage

FOLDS = 5


def smoothed(label: str, n_pos: Column, n_neg: Column) -> Column:
    """Target of a row, given how many rows the classes have."""
    return F.when(F.col(label) == 1, (n_pos + 1) / (n_pos + 2)).otherwise(F.lit(1.0) / (n_neg + 2))


def platt_targets(rows: DataFrame, key: str, folds: int = FOLDS, seed: int = 42, label: str = "label") -> DataFrame:
    """Rows with their ``fold`` and ``target``."""
    counts = rows.select(
        F.struct(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ).scalar()
    known = in_folds(rows, key, folds, seed).withColumn("_counts", counts)
    return known.withColumn("target", smoothed(label, F.col("_counts.pos"), F.col("_counts.neg"))).drop("_counts")


class CalibratedSVC(Estimator):
    """Estimator of ``<name>_prediction``, ``<name>_raw`` and ``<name>_probability``, with plain Spark stages when fitted.

    Where all rows of a class are in one fold, the others cannot teach it; that fold is scored by the machine fitted on all rows.
    """

    def __init__(self, svc: LinearSVC, name: str = "svm", key: str = "pkg_name", folds: int = FOLDS, seed: int = 42):
        super().__init__()
        self.svc, self.name, self.key, self.folds, self.seed = svc, name, key, folds, seed

    def _fit(self, rows: DataFrame) -> PipelineModel:
        raw = self.svc.getRawPredictionCol()
        sliced = VectorSlicer(inputCol=raw, outputCol=f"{self.name}_margin", indices=[1])
        machine = self.svc.fit(rows)
        marked = in_folds(rows, self.key, self.folds, self.seed)
        counts = {(r["fold"], r["label"]): r["count"] for r in marked.groupBy("fold", "label").count().collect()}

        def unseen(fold: int) -> DataFrame:
            taught = {label for (other, label) in counts if other != fold}
            model = self.svc.fit(marked.where(F.col("fold") != fold)) if len(taught) > 1 else machine
            return model.transform(marked.where(F.col("fold") == fold))

        with ThreadPool(self.folds) as pool:
            margins = reduce(DataFrame.union, pool.map(unseen, range(self.folds)))
        targets = platt_targets(sliced.transform(margins).drop("fold"), self.key, self.folds, self.seed)
        stored = cut_lineage(targets.select("label", "target", f"{self.name}_margin"))
        curve = GeneralizedLinearRegression(
            family="binomial", link="logit", labelCol="target", featuresCol=f"{self.name}_margin",
            predictionCol=f"{self.name}_curve", maxIter=50, tol=1e-9,
        ).fit(stored)
        other = SQLTransformer(statement=f"SELECT *, 1 - {self.name}_curve AS {self.name}_other FROM __THIS__")
        both = VectorAssembler(inputCols=[f"{self.name}_other", f"{self.name}_curve"], outputCol=f"{self.name}_probability")
        return PipelineModel([machine, sliced, curve, other, both])
