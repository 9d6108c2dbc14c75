"""Label tables and lists of names."""

from pyspark.sql import DataFrame, functions as F

from siftward.functions.cleaning import is_legit


def label_per_package(labels: DataFrame) -> DataFrame:
    """One row per package; contradicting labels are averaged."""
    return (
        labels.filter("package_name is not null")
        .groupBy(F.col("package_name").alias("pkg_name"))
        .agg(F.avg("is_spam").alias("is_spam"))
    )


def with_legit_mask(frame: DataFrame, label: str = "is_spam") -> DataFrame:
    """Add ``is_legit``; without a label column every row counts as legit."""
    mask = is_legit(label) if label in frame.columns else F.lit(True)
    return frame.withColumn("is_legit", mask)


def name_sample(spam: DataFrame, good: DataFrame) -> DataFrame:
    """Names of both lists one after the other, repeats kept."""
    return spam.select("package_name").unionByName(good.select("package_name"))


def not_listed(table: DataFrame, name: str, listed: DataFrame, column: str) -> DataFrame:
    """Rows whose name is not on a list; a null on the list excludes nothing."""
    names = listed.select(F.col(column).alias(name)).filter(F.col(name).isNotNull())
    return table.join(names, name, "left_anti")
