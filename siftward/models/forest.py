"""A random forest that is fitted, kept and asked in parts of bounded size.

Spark grows all trees of a fit in the driver's memory, and a model's trees stay there as long as the model does. Trees whose
features hardly tell the label have nearly as many nodes as rows, so a forest of hundreds is many times its input. Here a part
has as many trees as ``PART_NODES`` allows; it is stored in the shared folder and given up before the next is fitted. A forest
that fits in one part is Spark's own model. Many trees of rows that a task can hold are grown by tasks (``dealt``).
"""

import random
from functools import reduce
from uuid import uuid4

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftward.models.dealt import dealt_forest, shared_rows
from siftward.session import cut_lineage, shared_folder

#: Nodes that are in the driver at once, about half a KB each while they are fitted.
PART_NODES = 500_000
#: Trees that are worth being dealt out.
MANY_TREES = 20


class ForestInParts(Estimator):
    """Fits the trees of ``forest``: dealt out to tasks if they are many and a task can hold the rows, otherwise part by part.

    A tree has fewer nodes than twice its rows; that bounds the first part, the trees fitted so far the next ones.
    """

    def __init__(self, forest: RandomForestClassifier, n_rows: int):
        super().__init__()
        self.forest, self.n_rows = forest, n_rows

    def _fit(self, rows: DataFrame) -> Model:
        columns = [self.forest.getOrDefault(f"{c}Col") for c in ("features", "rawPrediction", "probability", "prediction")]
        if self.forest.getNumTrees() >= MANY_TREES and (shared := shared_rows(rows)):
            forest = self.forest
            return dealt_forest(
                shared, self.n_rows, forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode(),
                forest.getFeatureSubsetStrategy(), forest.getSeed(), columns,
            )
        missing, most = self.forest.getNumTrees(), max(1, 2 * self.n_rows)
        if missing * most <= PART_NODES:
            return self.forest.fit(rows)
        seeds = random.Random(self.forest.getSeed())
        folder = f"{shared_folder(rows.sparkSession)}/siftward/forest-{uuid4().hex}"
        paths, total, seen = [], 0.0, 1
        while missing:
            trees = min(missing, max(1, PART_NODES // most))
            # Parts of one seed would be the same trees.
            drawn = {self.forest.numTrees: trees, self.forest.seed: seeds.randrange(1 << 31)}
            model = self.forest.copy(drawn).fit(rows)
            nodes = [tree.numNodes for tree in model.trees]
            # Every tree that splits weighs the same.
            total = total + sum(n > 1 for n in nodes) * model.featureImportances.toArray()
            classes = model.numClasses
            paths.append(f"{folder}/part-{len(paths)}")
            model.write().save(paths[-1])
            del model
            missing -= trees
            seen = max(seen, *nodes)
            most = seen
        place = np.flatnonzero(total)
        shares = Vectors.sparse(len(total), place.tolist(), (total[place] / total.sum()).tolist())
        return PartedForestModel(paths, classes, columns, shares)


class PartedForestModel(Model, MLReadable, MLWritable):
    """The parts' votes added up, as Spark adds up those of trees.

    Rows are stored and each part is asked in a job of its own, so that no two parts are in the driver together.
    """

    def __init__(
        self, paths: list[str] = (), classes: int = 2, columns: list[str] = (), shares: SparseVector | None = None
    ):
        super().__init__()
        self.paths, self.classes, self.columns, self.featureImportances = list(paths), classes, list(columns), shares

    def _transform(self, rows: DataFrame) -> DataFrame:
        features, raw, probability, prediction = self.columns
        kept = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
        asked = kept.select("_row", features)

        def votes(number: int) -> DataFrame:
            said = RandomForestClassificationModel.load(self.paths[number]).transform(asked)
            return cut_lineage(said.select("_row", F.lit(number).alias("part"), vector_to_array(raw).alias("votes")))

        every = reduce(DataFrame.union, [votes(k) for k in range(len(self.paths))])
        # One entry for each part, added up in their order.
        listed = F.sort_array(F.collect_list(F.struct("part", "votes")))
        each = every.groupBy("_row").agg(listed.alias("_votes"))

        def voted(label: int) -> Column:
            return F.aggregate("_votes", F.lit(0.0), lambda all_, x: all_ + x["votes"][label])

        sums = each.select("_row", F.array(*map(voted, range(self.classes))).alias("_sums"))
        whole = F.aggregate("_sums", F.lit(0.0), lambda all_, x: all_ + x)
        shares = F.transform("_sums", lambda x: x / whole)
        most = F.array_position("_sums", F.array_max("_sums")) - 1
        found = sums.select(
            "_row", array_to_vector("_sums").alias(raw), array_to_vector(shares).alias(probability),
            most.cast("double").alias(prediction),
        )
        return kept.join(found, "_row").drop("_row")

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, stage: PartedForestModel):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        stage, shares = self.stage, self.stage.featureImportances
        learnt = {
            "parts": len(stage.paths), "classes": stage.classes, "columns": stage.columns,
            "shares": [shares.size, shares.indices.tolist(), shares.values.tolist()],
        }
        DefaultParamsWriter.saveMetadata(stage, path, self.sparkSession, extraMetadata={"learnt": learnt})
        for k, part in enumerate(stage.paths):
            RandomForestClassificationModel.load(part).write().save(f"{path}/part-{k}")


class _ForestReader(MLReader):
    def load(self, path: str) -> PartedForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, SparkSession.active())
        learnt = metadata["learnt"]
        paths = [f"{path}/part-{k}" for k in range(learnt["parts"])]
        stage = PartedForestModel(paths, learnt["classes"], learnt["columns"], Vectors.sparse(*learnt["shares"]))
        stage._resetUid(metadata["uid"])
        return stage
