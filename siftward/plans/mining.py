"""Finding more packages to label."""

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from siftward import config
from siftward.functions.common import instant
from siftward.operators.labels import not_listed
from siftward.operators.popularity import downloads_in_30_days
from siftward.operators.releases import RELEASE_ORDER, latest_release
from siftward.operators.scope import Scope
from siftward.session import cut_lineage

# --- fixed values ---------------------------------------------------------
MID_DOWNLOADS = (100, 1000)
MID_DOWNLOAD_PACKAGES = 5000
OLD_AFTER_DAYS = 365
BENIGN_DOWNLOADS_BELOW = 10
BENIGN_VERSIONS_ABOVE = 15
BENIGN_PACKAGES = 500


def mid_download_packages(
    dist: DataFrame,
    downloads: DataFrame,
    as_of: datetime,
    order: Sequence[str] = RELEASE_ORDER,
    between: tuple[int, int] = MID_DOWNLOADS,
    limit: int = MID_DOWNLOAD_PACKAGES,
) -> DataFrame:
    """Packages in the middle of the download range that rest for a year."""
    counts = downloads_in_30_days(downloads, as_of)
    # The log is read once; what is left of it limits the releases to read.
    middle = cut_lineage(counts.filter(F.col("download_count").between(*between)))
    listed = Scope(middle.select("name").filter("name is not null")).early(dist)
    current = latest_release(
        listed, ["version", "upload_time", "summary", "home_page"], order
    )
    year_ago = instant(
        as_of - timedelta(days=OLD_AFTER_DAYS), dist.schema["upload_time"].dataType
    )
    return (
        current.filter(F.col("upload_time") < year_ago)
        .join(middle, "name")
        .select("name", "version", "download_count", "upload_time", "summary", "home_page")
        .orderBy(F.desc("download_count"), "name")
        .limit(limit)
    )


def mine_benign(
    dist: DataFrame,
    downloads: DataFrame,
    labels: DataFrame,
    as_of: datetime,
    limit: int = BENIGN_PACKAGES,
) -> DataFrame:
    """Unlabelled packages with many versions that hardly anyone downloads."""
    versions = dist.groupBy("name").agg(F.count_distinct("version").alias("n_versions"))
    long_lived = versions.filter(F.col("n_versions") > BENIGN_VERSIONS_ABOVE)
    counted = long_lived.join(downloads_in_30_days(downloads, as_of), "name", "left")
    quiet = counted.filter(
        F.coalesce("download_count", F.lit(0)) < BENIGN_DOWNLOADS_BELOW
    )
    return (
        not_listed(quiet, "name", labels, "package_name")
        .orderBy("name")
        .limit(limit)
        .select(F.col("name").alias("package_name"), F.lit(0).cast("long").alias("is_spam"))
    )


def mine_long_names(
    dist: DataFrame,
    as_of: datetime,
    order: Sequence[str] = RELEASE_ORDER,
    longer_than: int = config.LONG_NAME,
) -> DataFrame:
    """Packages with very long names and a release within a year, for review."""
    year_ago = instant(
        as_of - timedelta(days=OLD_AFTER_DAYS), dist.schema["upload_time"].dataType
    )
    recent = dist.filter(
        (F.length("name") > longer_than) & (F.col("upload_time") > year_ago)
    )
    current = latest_release(recent, ["version", "summary", "author", "upload_time"], order)
    return (
        current.select(
            F.col("name").alias("package_name"),
            F.lit(1).cast("long").alias("is_spam"),
            "version",
            "summary",
            F.length("name").cast("long").alias("name_length"),
            "author",
            "upload_time",
        )
        .distinct()
        .orderBy(F.desc("name_length"), "package_name")
    )


def as_labels(mined: DataFrame) -> DataFrame:
    """The two columns of mined packages that enter the label table."""
    return mined.select("package_name", "is_spam")


def known_spam_names(
    listing: DataFrame,
    manifests: DataFrame,
    excluded: Sequence[str] = tuple(config.COMPROMISED_NOT_SPAM),
) -> DataFrame:
    """Names from an archive listing and from manifests, in order, without repeats."""
    names = listing.select("package_name").union(manifests.select("package_name")).distinct()
    kept = names.filter(~F.col("package_name").isin(*excluded)) if excluded else names
    return kept.orderBy("package_name")
