"""The wide feature row per package, and the narrower reports beside it."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from siftward import config
from siftward.functions.links import license_features, link_features, link_surface
from siftward.functions.names import name_features
from siftward.functions.people import list_length, owner_features
from siftward.functions.requirements import requirement_features
from siftward.functions.risk import rule_features
from siftward.functions.text import text_features
from siftward.operators.labels import label_per_package
from siftward.operators.metadata import package_profile
from siftward.operators.popularity import dependent_counts, download_counts
from siftward.operators.releases import (
    RELEASE_ORDER,
    files_of,
    latest_release,
    median_gap,
    narrow_uploads,
    release_features,
    release_profile,
    timing_features,
    version_files,
    versions_text,
)
from siftward.operators.scope import Scope, distinct_names

LINK_FIELDS = (
    "version", "upload_time", "home_page", "project_urls", "download_url", "license",
    "classifiers",
)


def feature_rows(
    dist: DataFrame,
    downloads: DataFrame,
    names: DataFrame | None,
    as_of: datetime,
    order: Sequence[str] = RELEASE_ORDER,
    dependents_scope: str = "listed",
) -> DataFrame:
    """Feature row of every listed package, without a label.

    ``names`` has one column, ``name``, without repeats; without it all
    packages are listed. ``dependents_scope`` says whose requirements count:
    those of ``listed`` packages or of ``all``.
    """
    scope = Scope(names) if names is not None else None
    listed = scope.early(dist) if scope else dist
    # Read six times: stored without texts, so that whatever the uploads are joined from is shuffled once.
    narrow = narrow_uploads(listed, order)
    if dependents_scope == "all":
        dependents = dependent_counts(narrow if listed is dist else dist)
    else:
        dependents = dependent_counts(narrow, scope)
    # The log is the largest table: a short list drops other packages before any shuffle.
    log = scope.early(downloads, "file.project") if scope else downloads
    return wide_rows(
        package_profile(listed, order, narrow), version_files(narrow), median_gap(narrow), dependents, log, scope, as_of
    )


def wide_rows(
    profile: DataFrame,
    files: DataFrame,
    gaps: DataFrame,
    dependents: DataFrame,
    log: DataFrame,
    scope: Scope | None,
    as_of: datetime,
) -> DataFrame:
    """Feature rows from what is known of each package and version; the log has been through the scope's early step."""
    # A package without any dated upload has no row.
    dated = release_profile(files).filter(F.col("last_upload").isNotNull()).select(
        "name",
        "first_upload",
        "last_upload",
        "version_files",
        *_named(timing_features(as_of)),
    )
    profile = profile.join(dated, "name").join(gaps, "name", "left")
    if scope:
        profile = scope.late(profile)
    surface = link_surface("latest.home_page", "latest.project_urls", "latest.download_url")
    described = profile.select(
        "*",
        F.col("name").alias("pkg_name"),
        *_named(name_features("name")),
        *_named(text_features("latest.summary", "latest.description")),
        *_named(link_features("latest.home_page", surface)),
        *_named(license_features("latest.license", "latest.classifiers")),
        *_named(owner_features("distinct_authors", "distinct_maintainers")),
        *_named(requirement_features("latest.requires_dist")),
        files_of("version_files", F.col("latest.version")).alias("n_distributions"),
        versions_text("version_files").alias("versions"),
        F.col("first_upload").alias("t_first_release"),
        F.col("last_upload").alias("t_last_release"),
        F.col("latest.summary").alias("latest_summary"),
        F.col("latest.description").alias("latest_description"),
        F.col("latest.project_urls").alias("latest_project_urls"),
        F.col("latest.requires_dist").alias("latest_dependencies"),
    )
    rules = rule_features("has_repo_url", "n_desc_len", "has_suspicious_kw")
    return (
        described.join(download_counts(log, as_of), "pkg_name", "left")
        .join(dependents, "pkg_name", "left")
        .withColumns(rules)
        .select(*config.FEATURE_COLUMNS)
    )


def feature_table(
    dist: DataFrame,
    downloads: DataFrame,
    labels: DataFrame,
    as_of: datetime,
    order: Sequence[str] = RELEASE_ORDER,
    dependents_scope: str = "listed",
) -> DataFrame:
    """Feature row and label of every labelled package."""
    label = label_per_package(labels)
    names = label.select(F.col("pkg_name").alias("name"))
    rows = feature_rows(dist, downloads, names, as_of, order, dependents_scope)
    return rows.join(label, "pkg_name").select(*config.FEATURE_COLUMNS, "is_spam")


def feature_row(
    dist: DataFrame,
    downloads: DataFrame,
    name: str,
    as_of: datetime,
    order: Sequence[str] = RELEASE_ORDER,
) -> DataFrame:
    """Feature row of one package; the name reaches both scans as a filter."""
    releases = dist.filter(F.col("name") == name)
    log = downloads.filter(F.col("file.project") == name)
    return feature_rows(releases, log, None, as_of, order)


def package_metadata(
    dist: DataFrame, sample: DataFrame, order: Sequence[str] = RELEASE_ORDER
) -> DataFrame:
    """Metadata summary of every package in a sample of names."""
    scope = Scope(distinct_names(sample))
    listed = scope.early(dist)
    narrow = narrow_uploads(listed, order)
    releases = release_profile(version_files(narrow))
    whole = scope.late(package_profile(listed, order, narrow).join(releases, "name"))
    return whole.select(
        "name",
        "licenses",
        "version_count",
        "signed_version_count",
        "last_upload",
        "first_upload",
        F.col("latest.summary").alias("latest_summary"),
        F.col("latest.description").alias("latest_description"),
        "distinct_authors",
        "distinct_maintainers",
        "distinct_keywords",
        "distinct_classifiers",
        F.col("latest.project_urls").alias("latest_project_urls"),
        list_length("latest.requires_dist").alias("latest_dependency_count"),
        F.col("latest.requires_dist").alias("latest_dependencies"),
    )


def link_table(
    dist: DataFrame, sample: DataFrame, order: Sequence[str] = RELEASE_ORDER
) -> DataFrame:
    """Links and licence flag of the newest release of each sampled package."""
    scope = Scope(distinct_names(sample))
    listed = scope.early(dist)
    current = scope.late(latest_release(listed, LINK_FIELDS, order))
    surface = link_surface("home_page", "project_urls", "download_url")
    return current.select(
        "name",
        "version",
        "upload_time",
        *_named(link_features("home_page", surface)),
        license_features("license", "classifiers")["has_license"].alias("has_license"),
    )


def release_table(dist: DataFrame, sample: DataFrame, as_of: datetime) -> DataFrame:
    """Release features of each sampled package, in order of name."""
    scope = Scope(distinct_names(sample))
    listed = scope.early(dist)
    profile = scope.late(release_profile(version_files(listed)))
    return release_features(profile, as_of).orderBy("pkg_name")


def _named(columns: dict) -> list:
    return [column.alias(name) for name, column in columns.items()]
