"""Versions, uploads and the rhythm between them."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from siftward.functions.moments import age_days, hour_bucket, weekday
from siftward.operators.scope import fits_broadcast
from siftward.session import cut_lineage

# Newest first by upload time; the rest only settles ties.
RELEASE_ORDER = ("upload_time", "version")


def newest(fields: Sequence[Column | str], order: Sequence[str] = RELEASE_ORDER) -> Column:
    """Aggregate: the fields of the newest row, nulls of that row included.

    The maximum of one struct keeps a single row per group on each side of the
    shuffle. Fields follow the order columns, so equal rows give equal results.
    """
    ranks = [F.col(c).alias(f"_rank{i}") for i, c in enumerate(order)]
    return F.max(F.struct(*ranks, *fields))


def newest_dated(dist: DataFrame, order: Sequence[str] = RELEASE_ORDER, narrow: DataFrame | None = None) -> DataFrame:
    """Rows with the highest first order column of their package: the newest one, and those that tie with it in it.

    Only names and that one column are aggregated, by hash. As a predicate (which a semi join is not) the test goes below
    the joins that bring in texts, so texts meet these few rows instead of being sorted for all.
    ``narrow`` are the same uploads with names and that column, where they are stored.
    """
    tops = cut_lineage(
        (dist if narrow is None else narrow).select(F.col("name").alias("_name"), F.col(order[0]).alias("_first"))
        .groupBy("_name")
        .agg(F.max("_first").alias("_top"))
    )
    if fits_broadcast(tops.select("_name")):
        tops = F.broadcast(tops)
    same = F.col("_name").eqNullSafe(F.col("_dist.name").outer()) & F.col("_top").eqNullSafe(
        F.col(f"_dist.{order[0]}").outer()
    )
    return dist.alias("_dist").where(tops.where(same).exists())


def newest_rows(
    dist: DataFrame, fields: Sequence[str], order: Sequence[str] = RELEASE_ORDER, narrow: DataFrame | None = None
) -> DataFrame:
    """``name`` and ``latest``, the newest row of each package as ``newest`` gives it."""
    return newest_dated(dist, order, narrow).groupBy("name").agg(newest(fields, order).alias("latest"))


#: What the features need of every upload; texts are needed of the newest ones only.
NARROW = (
    "name", "version", "upload_time", "has_signature", "license", "author_email", "maintainer_email", "keywords",
    "classifiers", "requires_dist",
)


def narrow_uploads(dist: DataFrame, order: Sequence[str] = RELEASE_ORDER) -> DataFrame:
    """The uploads without their texts, stored: what ``dist`` is made of is joined and shuffled once for all that read it."""
    return cut_lineage(dist.select(*NARROW, *(c for c in order[:1] if c not in NARROW)))


def latest_release(
    dist: DataFrame, fields: Sequence[str], order: Sequence[str] = RELEASE_ORDER
) -> DataFrame:
    """The newest row of each package."""
    picked = newest_rows(dist, fields, order)
    return picked.select("name", *(F.col("latest")[f].alias(f) for f in fields))


def version_files(dist: DataFrame) -> DataFrame:
    """One row per version: its files, signature and upload span."""
    return dist.groupBy("name", "version").agg(
        F.count("*").alias("n_files"),
        F.count("upload_time").alias("n_dated"),
        F.coalesce(F.bool_or("has_signature"), F.lit(False)).alias("is_signed"),
        F.min("upload_time").alias("first_upload"),
        F.max("upload_time").alias("last_upload"),
    )


def release_profile(files: DataFrame) -> DataFrame:
    """Versions per package, from the rows of ``version_files``."""
    named = F.col("version").isNotNull()
    return files.groupBy("name").agg(
        F.count_if(named).alias("version_count"),
        F.count_if(named & F.col("is_signed")).alias("signed_version_count"),
        F.count_if(named & (F.col("n_dated") > 0)).alias("n_versions"),
        F.min("first_upload").alias("first_upload"),
        F.max("last_upload").alias("last_upload"),
        F.array_sort(
            F.collect_list(F.when(named, F.struct("version", "n_files")))
        ).alias("version_files"),
    )


def versions_text(version_files: Column | str) -> Column:
    """Every file's version in one text, repeats kept; null without versions."""
    repeated = F.flatten(
        F.transform(
            version_files, lambda v: F.array_repeat(v["version"], v["n_files"].cast("int"))
        )
    )
    return F.when(F.size(repeated) > 0, F.array_join(repeated, ","))


def files_of(version_files: Column | str, version: Column) -> Column:
    """How many files one version has; null if the version is unknown."""
    matching = F.filter(version_files, lambda v: v["version"] == version)
    return F.get(matching, F.lit(0))["n_files"]


def distributions_of_latest(
    dist: DataFrame, order: Sequence[str] = RELEASE_ORDER
) -> DataFrame:
    """Files uploaded for the newest version of each package."""
    current = latest_release(dist, ["version"], order)
    files = version_files(dist).select("name", "version", "n_files")
    return current.join(files, ["name", "version"]).select(
        F.col("name").alias("pkg_name"),
        F.col("version").alias("latest_version"),
        F.col("n_files").alias("n_distributions"),
    )


def upload_days(dist: DataFrame) -> DataFrame:
    """How many uploads each package has on a day."""
    return (
        dist.filter(F.col("upload_time").isNotNull())
        .groupBy("name", F.to_date("upload_time").alias("day"))
        .agg(F.count("*").alias("n"))
    )


def median_gap(dist: DataFrame) -> DataFrame:
    """Lower median of the calendar days between consecutive uploads."""
    return median_gap_of_days(upload_days(dist))


def median_gap_of_days(days: DataFrame) -> DataFrame:
    """The same from the counts of ``upload_days``.

    Uploads on one day are zero days apart, so a day with n uploads adds n - 1
    zeros and one step from the day before. Counting per day first bounds the
    window of a package by the calendar instead of by its uploads.
    """
    by_day = Window.partitionBy("name").orderBy("day")
    steps = days.select(
        "name",
        F.datediff("day", F.lag("day").over(by_day)).cast("long").alias("step"),
        (F.col("n") - 1).alias("zeros"),
    )
    # Each day gives up to two weighted gaps: its step once, and its zeros.
    gaps = steps.select(
        "name",
        F.explode(
            F.array(
                F.struct(F.col("step").alias("gap"), F.lit(1).cast("long").alias("weight")),
                F.struct(F.lit(0).cast("long").alias("gap"), F.col("zeros").alias("weight")),
            )
        ).alias("g"),
    ).select("name", "g.gap", "g.weight").filter("gap is not null and weight > 0")
    upto = Window.partitionBy("name").orderBy("gap")
    everything = Window.partitionBy("name")
    ranked = gaps.select(
        "name",
        "gap",
        F.sum("weight").over(upto).alias("reached"),
        F.sum("weight").over(everything).alias("total"),
    )
    middle = F.min(F.when(F.col("reached") * 2 >= F.col("total"), F.col("gap")))
    return ranked.groupBy("name").agg(middle.alias("t_median_release_gap_days"))


def timing_features(as_of: datetime) -> dict[str, Column]:
    """Age, count and timing, over the columns of ``release_profile``."""
    return {
        "t_age_first_release_days": age_days("first_upload", as_of),
        "t_age_last_release_days": age_days("last_upload", as_of),
        "n_versions": F.col("n_versions").cast("long"),
        "has_single_release": F.col("n_versions") == 1,
        "t_time_of_day_bucket": hour_bucket("last_upload"),
        "cat_weekday_of_last_release": weekday("last_upload"),
    }


def release_features(profile: DataFrame, as_of: datetime) -> DataFrame:
    """Timing of each package; one without any dated upload is left out."""
    return profile.filter(F.col("last_upload").isNotNull()).select(
        F.col("name").alias("pkg_name"),
        *(column.alias(name) for name, column in timing_features(as_of).items()),
    )
