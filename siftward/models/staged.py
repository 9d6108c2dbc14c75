"""All prefixes of a boosted model judged at once: the first so many rounds of one fit are the fit of so many rounds."""

from uuid import uuid4

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftward.session import shared_folder


def leaf_values(model: GBTClassificationModel) -> list[list[float]]:
    """What each leaf of each tree adds to the margin, leaves in depth-first order. As large as the model."""
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/siftward/boosted-{uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").where("leftChild < 0")
    found: list[list[float]] = [[] for _ in model.treeWeights]
    for row in nodes.select("treeID", "id", "prediction").orderBy("treeID", "id").collect():
        found[row["treeID"]].append(row["prediction"] * model.treeWeights[row["treeID"]])
    return found


def margins(leaves: Column, values: list[list[float]]) -> Column:
    """Margin after each round, from the leaf a row ends in in each tree."""
    table = F.array(*(F.array(*(F.lit(v) for v in tree)) for tree in values))
    added = F.transform(leaves, lambda leaf, tree: table[tree][leaf.cast("int")])
    begun = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))

    def add(done: Column, value: Column) -> Column:
        total = done["sum"] + value
        return F.struct(total.alias("sum"), F.concat(done["all"], F.array(total)).alias("all"))

    return F.aggregate(added, begun, add, lambda x: x["all"])


def prefix_accuracies(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """``rounds`` (from 1), ``n_rows`` and ``n_right`` of rows with ``label``, for every prefix of the model, in one pass."""
    values = leaf_values(model)
    ended = model.setLeafCol("_leaves").transform(rows)
    after = margins(vector_to_array("_leaves"), values)
    right = F.transform(after, lambda m: ((m > 0) == (F.col("label") == 1)).cast("long"))
    each = ended.select(F.posexplode(right).alias("at", "is_right"))
    return each.groupBy((F.col("at") + 1).alias("rounds")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("is_right").alias("n_right")
    )
