"""How good predictions are."""

from pyspark.sql import Column, DataFrame, functions as F

from siftward.operators.skew import running_totals
from siftward.session import cut_lineage


def accuracy(label: str = "label", prediction: str = "prediction") -> Column:
    return F.avg((F.col(label) == F.col(prediction)).cast("double"))


def recall(label: str = "label", prediction: str = "prediction") -> Column:
    """Share of class 1 that is found; 0 when there is none."""
    hits = F.count_if((F.col(label) == 1) & (F.col(prediction) == 1))
    return F.coalesce(F.try_divide(hits, F.count_if(F.col(label) == 1)), F.lit(0.0))


def classification_report(
    rows: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class, with both averages.

    One grouping of the rows; the rest works on one row per pair of classes.
    """
    pairs = rows.groupBy(
        F.col(label).cast("long").alias("actual"), F.col(prediction).cast("long").alias("said")
    ).agg(F.count("*").alias("n"))
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("class"), F.col("n").alias("support"),
                         F.lit(0).cast("long").alias("claimed")),
                F.struct(F.col("said").alias("class"), F.lit(0).cast("long").alias("support"),
                         F.col("n").alias("claimed")),
            )
        ).alias("side"),
        F.when(F.col("actual") == F.col("said"), F.col("n")).otherwise(0).alias("hits"),
    )
    per_class = sides.groupBy("side.class").agg(
        F.sum("side.support").alias("support"),
        F.sum("side.claimed").alias("claimed"),
        # Both sides of a pair carry its hits.
        (F.sum("hits") / 2).alias("hits"),
    )

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    scored = per_class.select(
        F.col("class").cast("string").alias("class"),
        ratio(F.col("hits"), F.col("claimed")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("claimed") + F.col("support")).alias("f1"),
        "support",
    )
    measures = ["precision", "recall", "f1"]
    total = F.sum("support").alias("support")
    macro = scored.agg(*(F.avg(m).alias(m) for m in measures), total)
    weighted = scored.agg(
        *((F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in measures),
        total,
    )
    return (
        scored.unionByName(macro.withColumn("class", F.lit("macro avg")))
        .unionByName(weighted.withColumn("class", F.lit("weighted avg")))
    )


def roc_points(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One point per distinct score: counts and rates at or above it."""
    positive = F.col(label) == 1
    points = rows.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_neg")
    )
    points = cut_lineage(points)
    totals = running_totals(points, "threshold", {"n_pos": "true_pos", "n_neg": "false_pos"})
    everything = points.select(
        F.struct(F.sum("n_pos").alias("pos"), F.sum("n_neg").alias("neg"))
    ).scalar()
    return totals.withColumn("_all", everything).select(
        "threshold",
        "n_pos",
        "n_neg",
        "true_pos",
        "false_pos",
        F.try_divide("true_pos", F.col("_all.pos")).alias("tpr"),
        F.try_divide("false_pos", F.col("_all.neg")).alias("fpr"),
    )


def roc_auc(points: DataFrame) -> DataFrame:
    """Area under the curve: pairs in the right order, ties count half."""
    ordered = F.sum(F.col("n_neg") * (F.col("true_pos") - F.col("n_pos") / 2))
    pairs = F.sum("n_pos") * F.sum("n_neg")
    return points.agg(F.try_divide(ordered, pairs.cast("double")).alias("auc"))
