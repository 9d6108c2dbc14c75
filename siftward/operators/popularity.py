"""Downloads and dependents of packages."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from siftward.functions.common import instant, text_list
from siftward.functions.requirements import required_name
from siftward.operators.scope import Scope


def downloads_since(downloads: DataFrame, moment: datetime) -> DataFrame:
    """Part of the log from a moment on; the bound reaches the scan."""
    return downloads.filter(
        F.col("timestamp") >= instant(moment, downloads.schema["timestamp"].dataType)
    )


def download_counts(downloads: DataFrame, as_of: datetime) -> DataFrame:
    """Downloads of the last 30 calendar days and of the last 7 times 24 hours."""
    today = datetime(as_of.year, as_of.month, as_of.day)
    recent = downloads_since(downloads, today - timedelta(days=30))
    dtype = downloads.schema["timestamp"].dataType
    last_week = F.col("timestamp") >= instant(as_of - timedelta(days=7), dtype)
    return recent.groupBy(F.col("file.project").alias("pkg_name")).agg(
        F.count_if(last_week).alias("n_downloads_7d"),
        F.count("*").alias("n_downloads_30d"),
    )


def downloads_in_30_days(downloads: DataFrame, as_of: datetime) -> DataFrame:
    """Downloads of the last 30 times 24 hours, for the miners."""
    recent = downloads_since(downloads, as_of - timedelta(days=30))
    return recent.groupBy(F.col("file.project").alias("name")).agg(
        F.count("*").alias("download_count")
    )


def requirement_pairs(dist: DataFrame) -> DataFrame:
    """Which package requires which name in any release, each pair once."""
    required = F.array_distinct(F.transform(text_list("requires_dist"), required_name))
    return (
        dist.select(F.col("name").alias("dependent"), F.explode(required).alias("pkg_name"))
        .filter("pkg_name is not null")
        .distinct()
    )


def dependent_counts(dist: DataFrame, dependents: Scope | None = None) -> DataFrame:
    """How many packages require each name in any release.

    ``dependents`` limits who counts as a dependent; ``dist`` has been through
    its early step. Pairs are made distinct on
    both columns before counting, so a name everyone requires stays spread out.
    """
    return counted_dependents(requirement_pairs(dist), dependents)


def counted_dependents(pairs: DataFrame, dependents: Scope | None = None) -> DataFrame:
    """The same from the pairs of ``requirement_pairs``."""
    if dependents is not None:
        pairs = dependents.late(pairs, "dependent")
    return pairs.groupBy("pkg_name").agg(F.count("dependent").alias("n_dependents_est"))
