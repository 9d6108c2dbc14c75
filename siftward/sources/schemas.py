"""Declared schemas; nothing is inferred from data."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from siftward import config


def _fields(dtype, *names):
    return [StructField(name, dtype) for name in names]


DISTRIBUTION_METADATA = StructType(
    _fields(
        StringType(),
        "name", "version", "summary", "description", "author", "author_email",
        "maintainer_email", "license", "keywords", "home_page", "download_url",
    )
    + _fields(ArrayType(StringType()), "classifiers", "project_urls", "requires_dist")
    + _fields(TimestampType(), "upload_time")
    + _fields(BooleanType(), "has_signature")
)

FILE_DOWNLOADS = StructType(
    _fields(TimestampType(), "timestamp")
    + [StructField("file", StructType(_fields(StringType(), "project")))]
)

LABELS = StructType(_fields(StringType(), "package_name") + _fields(LongType(), "is_spam"))

# Types of an exported feature row, where every scalar may arrive as text.
TEXT_FEATURES = [
    "pkg_name", "cat_name_case", "t_time_of_day_bucket", "cat_weekday_of_last_release",
    "cat_repo_host", "cat_license_family", "licenses", "versions", "latest_summary",
    "latest_description", "t_time_of_day",
]
COUNT_FEATURES = [
    "n_name_len", "n_summary_len", "n_desc_len", "n_desc_lines", "n_urls_in_desc",
    "t_age_first_release_days", "t_age_last_release_days", "n_versions", "n_maintainers",
    "n_classifiers", "n_distributions", "n_requires", "n_lev_dist_to_top1",
    "n_lev_dist_to_alias", "n_latest_project_urls", "rule_no_repo_low_desc_len",
    "rule_suspicious_name_and_dep", "has_dependency_to_top_brand",
    "has_dependency_lev_close_to_brand", "is_spam",
]
BOOLEAN_FEATURES = [
    "has_digit_in_name", "has_dash_or_underscore", "has_code_block_in_desc",
    "has_suspicious_kw", "has_single_release",
]
NUMBER_FEATURES = [
    "pct_non_ascii_desc", "pct_free_email_domains", "t_median_release_gap_days",
    "n_downloads_7d", "n_downloads_30d", "n_dependents_est",
    "sim_tfidf_to_legit_centroid", "dist_embed_to_legit_desc",
    "n_pkgs_by_maintainers_30d", "n_low_download_pkgs_by_maintainers",
    "min_dep_lev_to_brand",
]
MOMENT_FEATURES = ["t_first_release", "t_last_release"]

# An export of raw feature rows, before any repair.
RAW_FEATURES = StructType(_fields(StringType(), *config.FEATURE_COLUMNS, "is_spam"))

FINISHED_FEATURES = StructType(
    _fields(StringType(), "pkg_name", "cat_name_case", "cat_weekday_of_last_release",
            "cat_repo_host", "cat_license_family", "t_time_of_day")
    + _fields(LongType(), *COUNT_FEATURES)
    + _fields(BooleanType(), *BOOLEAN_FEATURES)
    + _fields(DoubleType(), *NUMBER_FEATURES, *config.FLAG_COLUMNS)
)
