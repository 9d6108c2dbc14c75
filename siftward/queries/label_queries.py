"""Queries that mine and clean labels and exported rows."""

from pyspark.sql import functions as F

from siftward import config
from siftward.functions.cleaning import is_legit
from siftward.functions.moments import hour_bucket, time_of_day
from siftward.operators.labels import label_per_package, name_sample, not_listed
from siftward.operators.releases import latest_release
from siftward.plans.mining import (
    known_spam_names,
    mid_download_packages,
    mine_benign,
    mine_long_names,
)
from siftward.plans.offline import drop_raw, fill_missing
from siftward.queries.registry import joined, query
from siftward.queries.tables import DOWNLOADS_AS_OF, ORDER, RELEASES_AS_OF
from siftward.sources.readers import names_in_listing, names_in_manifests, repaired


# Packages of the given tables have some 66 downloads each.
MIDDLE_HERE = (60, 70)


@query(
    "mid_downloads",
    f"""WITH counts AS (SELECT file.project AS name, count(*) AS download_count FROM downloads
        WHERE timestamp >= TIMESTAMP '{DOWNLOADS_AS_OF}' - INTERVAL 30 DAY GROUP BY ALL)
    SELECT n.name, n.version, c.download_count, n.upload_time, n.summary, n.home_page
    FROM newest n JOIN counts c ON c.name = n.name
    WHERE c.download_count BETWEEN {MIDDLE_HERE[0]} AND {MIDDLE_HERE[1]}
      AND n.upload_time < TIMESTAMP '{DOWNLOADS_AS_OF}' - INTERVAL 365 DAY
    ORDER BY c.download_count DESC, n.name LIMIT 5000""",
    ("downloads", "newest"),
)
def _(t):
    return mid_download_packages(t.dist, t.downloads, DOWNLOADS_AS_OF, ORDER, MIDDLE_HERE)


@query(
    "mine_benign",
    f"""SELECT name AS package_name, 0::BIGINT AS is_spam
    FROM (SELECT name FROM dist GROUP BY name HAVING count(DISTINCT version) > 15)
    WHERE name NOT IN (SELECT package_name FROM ground_truth)
      AND name NOT IN (SELECT file.project FROM downloads
        WHERE timestamp >= TIMESTAMP '{DOWNLOADS_AS_OF}' - INTERVAL 30 DAY
        GROUP BY ALL HAVING count(*) >= 10)
    ORDER BY name LIMIT 500""",
    ("ground_truth", "downloads"),
)
def _(t):
    return mine_benign(t.dist, t.downloads, t.ground_truth, DOWNLOADS_AS_OF)


# Names in the given tables are shorter than those the miner looks for.
LONG_HERE = 13


@query(
    "mine_long_names",
    f"""SELECT name AS package_name, 1::BIGINT AS is_spam, version, summary,
      length(name) AS name_length, author, upload_time
    FROM newest WHERE length(name) > {LONG_HERE}
      AND upload_time > TIMESTAMP '{RELEASES_AS_OF}' - INTERVAL 365 DAY
    ORDER BY name_length DESC, package_name""",
    ("newest",),
)
def _(t):
    return mine_long_names(t.dist, RELEASES_AS_OF, ORDER, LONG_HERE)


@query(
    "label_union",
    """SELECT s.package_name, count(d.name) AS n_files
    FROM sample s LEFT JOIN dist d ON d.name = s.package_name GROUP BY s.package_name""",
    ("sample", "dist"),
)
def _(t):
    sample = name_sample(t.spam_names, t.good_names)
    files = t.dist.groupBy(F.col("name").alias("package_name")).agg(F.count("*").alias("n_files"))
    return (
        sample.distinct()
        .join(files, "package_name", "left")
        .select("package_name", F.coalesce("n_files", F.lit(0)).alias("n_files"))
    )


@query(
    "label_average",
    """SELECT source AS pkg_name, avg(toxic) AS is_spam
    FROM labels JOIN documents USING (doc_id) GROUP BY source""",
)
def _(t):
    labels = t.labels.join(t.documents, "doc_id")
    return label_per_package(
        labels.select(F.col("source").alias("package_name"), F.col("toxic").alias("is_spam"))
    )


@query(
    "unlabelled_packages",
    """SELECT name FROM (SELECT DISTINCT name FROM dist)
    WHERE name NOT IN (SELECT package_name FROM ground_truth)""",
    ("ground_truth",),
)
def _(t):
    return not_listed(t.dist.select("name").distinct(), "name", t.ground_truth, "package_name")


# Archive entries of every kind that the listing rules tell apart.
ENTRY = """CASE p_partkey % 7 WHEN 0 THEN 'registry-main/' || name || '/'
  WHEN 1 THEN 'registry-main/registry-notes-1.0.tar.gz' WHEN 2 THEN 'other/' || name || '-1.0.tar.gz'
  WHEN 3 THEN 'registry-main/' || name || '/' || name || '-0.1b.tar.gz'
  ELSE 'registry-main/' || name || '/' || name || '-1.' || p_partkey || '.tar.gz' END"""
MANIFEST = """'{"' || name || '": null, "' || CASE WHEN p_partkey % 2 = 0 THEN 'num2words'
  ELSE 'ultralytics' END || '": ["1.0"], "' || p_brand || '": ["2"]}'"""


@query(
    "known_spam",
    """SELECT DISTINCT package_name FROM (
      SELECT name AS package_name FROM part_names WHERE p_partkey % 7 > 3
      UNION ALL SELECT name FROM part_names UNION ALL SELECT p_brand FROM part)
    ORDER BY package_name""",
    ("part_names",),
)
def _(t):
    parts = t.part_names.join(t.part, "p_partkey")
    listing = names_in_listing(parts.select(F.expr(ENTRY).alias("entry")), "entry", "registry")
    manifests = names_in_manifests(parts.select(F.expr(MANIFEST).alias("document")), "document")
    return known_spam_names(listing, manifests)


@query(
    "archive_listing",
    """SELECT DISTINCT name AS package_name FROM part_names WHERE p_partkey % 7 > 3""",
    ("part_names",),
)
def _(t):
    entries = t.part_names.select(F.expr(ENTRY).alias("entry"))
    return names_in_listing(entries, "entry", "registry").distinct()


LABEL_TEXT = """CASE WHEN doc_id % 5 = 0 THEN 'invalid' WHEN doc_id % 5 = 1 THEN NULL
    WHEN doc_id % 5 = 2 THEN toxic || '.0' ELSE CAST(toxic AS STRING) END"""


@query(
    "legit_mask",
    f"""SELECT doc_id, coalesce(TRY_CAST(t AS DOUBLE) = 0, FALSE) AS is_legit
    FROM (SELECT doc_id, {LABEL_TEXT} AS t FROM labels)""",
)
def _(t):
    texts = t.labels.select("doc_id", F.expr(LABEL_TEXT).alias("is_spam"))
    return texts.select("doc_id", is_legit("is_spam").alias("is_legit"))


@query(
    "time_bucket",
    """SELECT event_id, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning'
      WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS t_time_of_day,
      CASE event_type WHEN 'click' THEN 'evening' ELSE 'unknown' END AS odd_time
    FROM events""",
)
def _(t):
    odd = F.when(F.col("event_type") == "click", "EVENING after night").when(
        F.col("event_type") == "view", "noon"
    )
    return t.events.select(
        "event_id",
        time_of_day(hour_bucket("ts")).alias("t_time_of_day"),
        time_of_day(odd).alias("odd_time"),
    )


ROW = ["pkg_name", *config.NUMERIC_FILLS, "cat_license_family", "versions", "latest_summary"]
FILL_INPUT = """name AS pkg_name,
    CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'invalid'
      ELSE CAST(p_partkey AS STRING) END AS t_median_release_gap_days,
    CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey END AS n_downloads_7d,
    CASE WHEN p_partkey % 5 = 0 THEN 'nan' ELSE p_partkey || '.5' END AS n_downloads_30d,
    CAST(NULL AS DOUBLE) AS n_dependents_est,
    CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_partkey % 30 AS DOUBLE) END AS min_dep_lev_to_brand,
    CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'other_or_unknown' ELSE 'MIT' END AS cat_license_family,
    version AS versions, summary AS latest_summary"""


@query(
    "null_fill",
    f"""SELECT pkg_name,
      coalesce(TRY_CAST(t_median_release_gap_days AS DOUBLE), 0) AS t_median_release_gap_days,
      coalesce(CAST(n_downloads_7d AS DOUBLE), 0) AS n_downloads_7d,
      CASE WHEN n_downloads_30d = 'nan' THEN 0 ELSE CAST(n_downloads_30d AS DOUBLE) END AS n_downloads_30d,
      0.0::DOUBLE AS n_dependents_est,
      coalesce(min_dep_lev_to_brand, 20) AS min_dep_lev_to_brand,
      CASE cat_license_family WHEN 'MIT' THEN 'MIT' ELSE 'unknown' END AS cat_license_family
    FROM (SELECT {FILL_INPUT} FROM newest)""",
    ("newest",),
)
def _(t):
    rows = latest_release(t.dist, ["p_partkey", "version", "summary"], ORDER)
    frame = rows.selectExpr(*_expressions(FILL_INPUT))
    return fill_missing(drop_raw(frame))


def _expressions(text: str) -> list[str]:
    """Top-level parts of a select list."""
    parts, depth = [""], 0
    for mark in text:
        depth += (mark == "(") - (mark == ")")
        if mark == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += mark
    return parts


@query(
    "prune_columns",
    "SELECT name AS pkg_name, author FROM newest",
    ("newest",),
)
def _(t):
    rows = latest_release(t.dist, ["author", "version", "summary", "description"], ORDER)
    return drop_raw(
        rows.withColumnsRenamed(
            {
                "name": "pkg_name",
                "version": "versions",
                "summary": "latest_summary",
                "description": "latest_description",
            }
        )
    )


@query(
    "typed_load",
    r"""SELECT name AS pkg_name,
      replace(replace(description, chr(10), ' '), chr(13), '') AS latest_description,
      CAST(length(name) AS BIGINT) AS n_name_len,
      CAST(p_partkey % 2 AS DOUBLE) AS has_homepage,
      CASE p_partkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE END AS has_license,
      p_partkey % 2 = 0 AS has_single_release,
      CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN name || '|b, c' WHEN 2 THEN name
        ELSE name || '|x' END AS distinct_authors
    FROM newest""",
    ("newest",),
)
def _(t):
    rows = latest_release(t.dist, ["p_partkey", "description"], ORDER)
    key = F.col("p_partkey")
    raw = rows.select(
        F.col("name").alias("pkg_name"),
        F.col("description").alias("latest_description"),
        F.length("name").cast("string").alias("n_name_len"),
        (key % 2).cast("string").alias("has_homepage"),
        F.when(key % 3 == 0, "True").when(key % 3 == 1, "false").alias("has_license"),
        F.when(key % 2 == 0, "true").otherwise("false").alias("has_single_release"),
        F.when(key % 4 == 1, F.concat(F.lit("['"), "name", F.lit("', 'b, c']")))
        .when(key % 4 == 2, F.col("name"))
        .when(key % 4 == 3, F.concat(F.lit('["'), "name", F.lit('", "x"]')))
        .alias("distinct_authors"),
    )
    return repaired(raw).withColumns(joined("distinct_authors"))
