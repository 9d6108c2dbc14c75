"""What all releases of a package say together."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siftward.operators.releases import RELEASE_ORDER, newest_rows

LATEST_FIELDS = (
    "version", "upload_time", "summary", "description", "home_page",
    "project_urls", "download_url", "license", "classifiers", "requires_dist",
)


def distinct_values(column: str) -> Column:
    return F.array_sort(F.collect_set(column))


def distinct_elements(rows: DataFrame, column: str, target: str) -> DataFrame:
    """Per package the distinct elements of all lists, made distinct one by one before they are gathered."""
    pairs = rows.select("name", F.explode(column).alias("_e")).filter("_e is not null").distinct()
    return pairs.groupBy("name").agg(F.array_sort(F.collect_list("_e")).alias(target))


def joined_values(column: str, separator: str) -> Column:
    """Distinct values in one text, null when there is no value."""
    values = F.collect_set(column)
    return F.when(F.size(values) > 0, F.array_join(F.array_sort(values), separator))


def package_profile(
    dist: DataFrame, order: Sequence[str] = RELEASE_ORDER, narrow: DataFrame | None = None
) -> DataFrame:
    """Newest release and distinct values of each package; ``narrow`` are the uploads without texts, where they are stored.

    The newest rows, which alone bring their texts, and the values, which are short, are aggregated apart.
    Elements of lists are gathered in an aggregation of their own, so that a cell is as long as
    its distinct elements and never holds whole lists.
    """
    short = dist if narrow is None else narrow
    classifiers = distinct_elements(short, "classifiers", "distinct_classifiers")
    latest = newest_rows(dist, LATEST_FIELDS, order, narrow)
    profile = short.groupBy("name").agg(
        joined_values("license", ", ").alias("licenses"),
        distinct_values("author_email").alias("distinct_authors"),
        distinct_values("maintainer_email").alias("distinct_maintainers"),
        distinct_values("keywords").alias("distinct_keywords"),
    )
    none = F.array().cast(dist.schema["classifiers"].dataType)
    for part in (profile, classifiers):
        # Each package has a row of the first, and not always one of the second.
        keyed = part.withColumnRenamed("name", "_name")
        latest = latest.join(keyed, F.col("name").eqNullSafe(F.col("_name")), "left").drop("_name")
    return latest.withColumn("distinct_classifiers", F.coalesce("distinct_classifiers", none))
