"""Queries over packages and their releases."""

from pyspark.sql import functions as F

from siftward.functions.distance import name_distance_features, nearest_within
from siftward.functions.links import license_features, link_features, link_surface
from siftward.functions.names import name_features
from siftward.functions.people import owner_features
from siftward.functions.requirements import brand_features, requirement_features
from siftward.functions.risk import rule_features
from siftward.functions.text import text_features
from siftward.operators.labels import name_sample
from siftward.operators.metadata import distinct_values
from siftward.operators.nearest import nearest_known
from siftward.operators.popularity import dependent_counts, download_counts
from siftward.operators.releases import (
    distributions_of_latest,
    latest_release,
    median_gap,
    release_features,
    release_profile,
    version_files,
)
from siftward.plans.features import (
    feature_row,
    feature_table,
    link_table,
    package_metadata,
    release_table,
)
from siftward import config
from siftward.queries.registry import joined, query
from siftward.queries.tables import DOWNLOADS_AS_OF, ORDER, RELEASES_AS_OF


def columns(features: dict) -> list:
    return [column.alias(name) for name, column in features.items()]


NAME_COLUMNS = r"""
 length(name) AS n_name_len,
 regexp_matches(name, '[0-9]') AS has_digit_in_name,
 regexp_matches(name, '[-_]') AS has_dash_or_underscore,
 CASE WHEN name = lower(name) THEN 'lower'
      WHEN regexp_matches(name, '^[a-z]+([A-Z][a-z0-9]*)+$') THEN 'camel'
      ELSE 'mixed' END AS cat_name_case"""


@query(
    "name_features",
    f"SELECT name AS pkg_name, {NAME_COLUMNS} FROM (SELECT DISTINCT name FROM dist)",
    ("dist",),
)
def _(t):
    names = t.dist.select("name").distinct()
    return names.select(F.col("name").alias("pkg_name"), *columns(name_features("name")))


def sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_nearest(name, known):
    return f"list_min([levenshtein(lower({name}), k) FOR k IN {sql_list(known)}])"


@query(
    "name_lev",
    f"""SELECT name AS pkg_name,
      {sql_nearest('name', config.TOP_PACKAGES)} AS n_lev_dist_to_top1,
      {sql_nearest('name', config.BRAND_ALIASES)} AS n_lev_dist_to_alias,
      {sql_nearest('name', config.BRAND_PACKAGES)} AS brand_distance,
      {sql_nearest('name', config.BRAND_PACKAGES)} <= 8 AS brand_is_close
    FROM part_names""",
    ("part_names",),
)
def _(t):
    near = nearest_within("name", config.BRAND_PACKAGES, 8)
    return t.part_names.select(
        F.col("name").alias("pkg_name"),
        *columns(name_distance_features("name")),
        near["distance"].alias("brand_distance"),
        near["is_close"].alias("brand_is_close"),
    )


@query(
    "nearest_names",
    """WITH n AS (SELECT DISTINCT lower(name) AS name FROM part_names)
    SELECT a.name, b.nearest, b.distance FROM n a LEFT JOIN (
      SELECT x.name, y.name AS nearest, levenshtein(x.name, y.name) AS distance FROM n x JOIN n y
        ON x.name <> y.name AND abs(length(x.name) - length(y.name)) <= 3 AND levenshtein(x.name, y.name) <= 3
      QUALIFY row_number() OVER (PARTITION BY x.name ORDER BY distance, y.name) = 1) b USING (name)""",
    ("part_names",),
)
def _(t):
    return nearest_known(t.part_names, t.part_names, 3, itself=False)


def sql_set(column):
    return f"""coalesce(array_to_string(list_sort(list(DISTINCT {column})
        FILTER ({column} IS NOT NULL)), '|'), '')"""


@query(
    "metadata_per_package",
    f"""WITH kept AS (SELECT d.* FROM dist d JOIN sample s ON s.package_name = d.name),
    classes AS (SELECT name, array_to_string(list_sort(list(DISTINCT c)), '|') AS distinct_classifiers
        FROM (SELECT name, unnest(classifiers) AS c FROM kept) GROUP BY name)
    SELECT k.name,
      string_agg(DISTINCT k.license, ', ' ORDER BY k.license) AS licenses,
      count(DISTINCT k.version) AS version_count,
      count(DISTINCT k.version) FILTER (k.has_signature) AS signed_version_count,
      max(k.upload_time) AS last_upload,
      min(k.upload_time) AS first_upload,
      any_value(n.summary) AS latest_summary,
      any_value(n.description) AS latest_description,
      {sql_set('k.author_email')} AS distinct_authors,
      {sql_set('k.maintainer_email')} AS distinct_maintainers,
      {sql_set('k.keywords')} AS distinct_keywords,
      coalesce(any_value(c.distinct_classifiers), '') AS distinct_classifiers,
      coalesce(any_value(array_to_string(n.project_urls, '|')), '') AS latest_project_urls,
      coalesce(any_value(len(n.requires_dist)), 0) AS latest_dependency_count,
      coalesce(any_value(array_to_string(n.requires_dist, '|')), '') AS latest_dependencies
    FROM kept k JOIN newest n ON n.name = k.name LEFT JOIN classes c ON c.name = k.name
    GROUP BY k.name""",
    ("sample", "newest"),
)
def _(t):
    sample = name_sample(t.spam_names, t.good_names)
    return package_metadata(t.dist, sample, ORDER).withColumns(
        joined(
            "distinct_authors", "distinct_maintainers", "distinct_keywords",
            "distinct_classifiers", "latest_project_urls", "latest_dependencies",
        )
    )


def sql_text(summary, description):
    s, d = f"coalesce({summary}, '')", f"coalesce({description}, '')"
    words = " OR ".join(f"contains(lower({d}), '{w}')" for w in config.SUSPICIOUS_WORDS)
    return rf"""
      length({s}) AS n_summary_len,
      length({d}) AS n_desc_len,
      CAST(len(string_split({d}, chr(10))) AS BIGINT) AS n_desc_lines,
      regexp_matches({d}, '```|::[\t\n\f\r ]*\n') AS has_code_block_in_desc,
      CAST(len(regexp_extract_all(lower({d}), 'https?://[^\t\n\f\r )]+')) AS BIGINT) AS n_urls_in_desc,
      ({words}) AS has_suspicious_kw,
      (strlen({d}) - length({d})) / greatest(strlen({d}), 1) AS pct_non_ascii_desc"""


@query(
    "text_features",
    f"SELECT doc_id, {sql_text('split_part(text, chr(10), 1)', 'text')} FROM documents",
)
def _(t):
    summary = F.split_part("text", F.lit("\n"), F.lit(1))
    return t.documents.select("doc_id", *columns(text_features(summary, "text")))


@query(
    "text_features_latest",
    f"SELECT name AS pkg_name, {sql_text('summary', 'description')} FROM newest",
    ("newest",),
)
def _(t):
    rows = latest_release(t.dist, ["summary", "description"], ORDER)
    return rows.select(
        F.col("name").alias("pkg_name"), *columns(text_features("summary", "description"))
    )


def sql_release(source, as_of):
    """Release features of a table with name, version, upload_time."""
    return f"""
    WITH steps AS (SELECT name, date_diff('day', CAST(lag(upload_time) OVER
          (PARTITION BY name ORDER BY upload_time) AS DATE), CAST(upload_time AS DATE)) AS gap
        FROM {source} WHERE upload_time IS NOT NULL),
    medians AS (SELECT name, quantile_disc(gap, 0.5) AS gap FROM steps
        WHERE gap IS NOT NULL GROUP BY name),
    spans AS (SELECT name, min(upload_time) AS a, max(upload_time) AS z,
          count(DISTINCT version) AS n FROM {source} WHERE upload_time IS NOT NULL GROUP BY name)
    SELECT s.name AS pkg_name,
      date_diff('day', CAST(a AS DATE), DATE '{as_of:%Y-%m-%d}') AS t_age_first_release_days,
      date_diff('day', CAST(z AS DATE), DATE '{as_of:%Y-%m-%d}') AS t_age_last_release_days,
      n AS n_versions, n = 1 AS has_single_release,
      CASE WHEN hour(z) < 6 THEN 'night_00_05' WHEN hour(z) < 12 THEN 'morning_06_11'
           WHEN hour(z) < 18 THEN 'afternoon_12_17' ELSE 'evening_18_23' END AS t_time_of_day_bucket,
      dayname(z) AS cat_weekday_of_last_release,
      CAST(m.gap AS BIGINT) AS t_median_release_gap_days
    FROM spans s LEFT JOIN medians m ON m.name = s.name"""


def release_rows(dist, as_of):
    timing = release_features(release_profile(version_files(dist)), as_of)
    gaps = median_gap(dist).withColumnRenamed("name", "pkg_name")
    return timing.join(gaps, "pkg_name", "left")


@query("release_features", sql_release("dist", RELEASES_AS_OF), ("dist",))
def _(t):
    return release_rows(t.dist, RELEASES_AS_OF)


@query(
    "release_features_events",
    sql_release(
        "(SELECT CAST(user_id AS VARCHAR) AS name, event_type AS version, ts AS upload_time FROM events)",
        DOWNLOADS_AS_OF,
    ),
)
def _(t):
    uploads = t.events.select(
        F.col("user_id").cast("string").alias("name"),
        F.col("event_type").alias("version"),
        F.col("ts").alias("upload_time"),
        F.lit(None).cast("boolean").alias("has_signature"),
    )
    return release_rows(uploads, DOWNLOADS_AS_OF)


@query(
    "release_table",
    "SELECT * EXCLUDE (t_median_release_gap_days) FROM ("
    + sql_release("(SELECT * FROM dist WHERE name IN (SELECT package_name FROM sample))", RELEASES_AS_OF)
    + ") ORDER BY pkg_name",
    ("sample",),
)
def _(t):
    return release_table(t.dist, name_sample(t.spam_names, t.good_names), RELEASES_AS_OF)


@query(
    "latest_release",
    "SELECT name, version, upload_time, summary, home_page, license FROM newest",
    ("newest",),
)
def _(t):
    return latest_release(
        t.dist, ["version", "upload_time", "summary", "home_page", "license"], ORDER
    )


SURFACE = """lower(coalesce(home_page, '') || ' ' ||
      coalesce(array_to_string(project_urls, ','), '') || ' ' || coalesce(download_url, ''))"""


def sql_flag(condition):
    return f"CAST(coalesce({condition}, FALSE) AS BIGINT)"


def sql_links(u):
    ladder = " ".join(f"WHEN contains({u}, '{d}') THEN '{h}'" for d, h in config.REPO_HOSTS)
    hosts = " OR ".join(f"contains({u}, '{d}')" for d, _ in config.REPO_HOSTS)
    trackers = " OR ".join(f"contains({u}, '{w}')" for w in config.ISSUE_TRACKERS)
    return rf"""
      {sql_flag("regexp_matches(lower(home_page), 'https?://')")} AS has_homepage,
      {sql_flag(hosts)} AS has_repo_url,
      CASE {ladder} ELSE 'unknown' END AS cat_repo_host,
      {sql_flag(trackers)} AS has_issue_tracker,
      {sql_flag(f"regexp_matches({u}, '(readthedocs|(^|[ ])https?://docs[.]|/docs(/|$))')")} AS has_docs_url"""


HAS_LICENSE = r"""CAST(coalesce(trim(license) <> '', FALSE) OR coalesce(regexp_matches(lower(
      array_to_string(classifiers, ' | ')), '\blicense\s*::'), FALSE) AS BIGINT) AS has_license"""


@query(
    "link_features",
    f"SELECT name AS pkg_name, {sql_links('u')} FROM (SELECT *, {SURFACE} AS u FROM newest)",
    ("newest",),
)
def _(t):
    rows = latest_release(t.dist, ["home_page", "project_urls", "download_url"], ORDER)
    surface = link_surface("home_page", "project_urls", "download_url")
    return rows.select(F.col("name").alias("pkg_name"), *columns(link_features("home_page", surface)))


@query(
    "link_table",
    f"""SELECT name, version, upload_time, {sql_links('u')}, {HAS_LICENSE}
    FROM (SELECT *, {SURFACE} AS u FROM newest) JOIN sample ON package_name = name""",
    ("newest", "sample"),
)
def _(t):
    return link_table(t.dist, name_sample(t.spam_names, t.good_names), ORDER)


def sql_license(license, classifiers):
    said = f"lower(coalesce(array_to_string({classifiers}, ' | '), '') || ' ' || coalesce({license}, ''))"
    return rf"""
      CAST(coalesce(trim({license}) <> '', FALSE) OR coalesce(regexp_matches(lower(
          array_to_string({classifiers}, ' | ')), '\blicense\s*::'), FALSE) AS BIGINT) AS has_license,
      CASE WHEN regexp_matches({said}, 'mit license') THEN 'MIT'
           WHEN regexp_matches({said}, 'gpl|gnu general public license') THEN 'GPL'
           WHEN regexp_matches({said}, 'apache license') THEN 'Apache'
           WHEN regexp_matches({said}, 'bsd license') THEN 'BSD'
           ELSE 'other_or_unknown' END AS cat_license_family,
      coalesce(len({classifiers}), 0) AS n_classifiers,
      {sql_flag(f"len(list_filter({classifiers}, lambda c: contains(c, 'Programming Language :: Python'))) > 0")}
        AS has_prog_lang_classifier,
      {sql_flag(f"len(list_filter({classifiers}, lambda c: contains(c, 'Typing ::'))) > 0")}
        AS has_typing_classifier"""


@query(
    "license_features",
    f"SELECT name AS pkg_name, {sql_license('license', 'classifiers')} FROM newest",
    ("newest",),
)
def _(t):
    rows = latest_release(t.dist, ["license", "classifiers"], ORDER)
    return rows.select(
        F.col("name").alias("pkg_name"), *columns(license_features("license", "classifiers"))
    )


@query(
    "license_features_documents",
    f"SELECT doc_id, {sql_license('text', 'lines')} FROM "
    "(SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents)",
)
def _(t):
    lines = t.documents.select("doc_id", "text", F.split("text", "\n").alias("lines"))
    return lines.select("doc_id", *columns(license_features("text", "lines")))


OWNER_COLUMNS = r"""
      CAST(len(e) AS BIGINT) AS n_maintainers,
      CASE WHEN len(e) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(e, lambda x: regexp_matches(x,
        '@(gmail|outlook|yahoo|hotmail|protonmail)[.]com$'))) / len(e) END AS pct_free_email_domains,
      CAST(len(list_filter(e, lambda x: regexp_matches(x,
        '@(mailinator|10minutemail|guerrillamail)[.]com'))) > 0 AS BIGINT) AS has_disposable_email,
      CAST(len(a) = 0 AS BIGINT) AS has_missing_author"""

OWNER_LISTS = """SELECT name, a, list_concat(a, m) AS e FROM (SELECT name,
        coalesce(list(DISTINCT author_email) FILTER (author_email IS NOT NULL), []) AS a,
        coalesce(list(DISTINCT maintainer_email) FILTER (maintainer_email IS NOT NULL), []) AS m
        FROM dist GROUP BY name)"""


@query(
    "maintainer_features",
    f"SELECT name AS pkg_name, {OWNER_COLUMNS} FROM ({OWNER_LISTS})",
    ("dist",),
)
def _(t):
    owners = t.dist.groupBy("name").agg(
        distinct_values("author_email").alias("authors"),
        distinct_values("maintainer_email").alias("maintainers"),
    )
    return owners.select(
        F.col("name").alias("pkg_name"), *columns(owner_features("authors", "maintainers"))
    )


REQUIREMENT_COLUMNS = r"""
      coalesce(len(requires_dist), 0) AS n_requires,
      CAST(coalesce(len(list_filter(requires_dist, lambda r: regexp_matches(lower(r), 'extra\s*=='))), 0) > 0
        AS BIGINT) AS has_extras"""


@query(
    "dependency_flags",
    f"SELECT name AS pkg_name, {REQUIREMENT_COLUMNS} FROM newest",
    ("newest",),
)
def _(t):
    rows = latest_release(t.dist, ["requires_dist"], ORDER)
    return rows.select(F.col("name").alias("pkg_name"), *columns(requirement_features("requires_dist")))


BRAND_COLUMNS = f"""
      CAST(coalesce(bool_or(list_contains({sql_list(config.BRAND_PACKAGES)}, lower(b))), FALSE) AS BIGINT)
        AS has_dependency_to_top_brand,
      CAST(min({sql_nearest('b', config.BRAND_PACKAGES + config.BRAND_ALIASES)}) AS DOUBLE)
        AS min_dep_lev_to_brand,
      CAST(coalesce(min({sql_nearest('b', config.BRAND_PACKAGES + config.BRAND_ALIASES)}) <= 2, FALSE) AS BIGINT)
        AS has_dependency_lev_close_to_brand"""

BASE_NAMES = r"""SELECT name, nullif(trim(regexp_extract(trim(split_part(r, ';', 1)), '^[^<>=!~ ]*')), '') AS b
        FROM (SELECT name, unnest(CASE WHEN len(requires_dist) > 0 THEN requires_dist ELSE [NULL] END) AS r
              FROM newest)"""


@query(
    "dependency_brand",
    f"SELECT name AS pkg_name, {BRAND_COLUMNS} FROM ({BASE_NAMES}) GROUP BY name",
    ("newest",),
)
def _(t):
    rows = latest_release(t.dist, ["requires_dist"], ORDER)
    return rows.select(F.col("name").alias("pkg_name"), *columns(brand_features("requires_dist")))


def sql_dependents(source):
    return f"""SELECT required AS pkg_name, count(DISTINCT name) AS n_dependents_est FROM (
        SELECT name, nullif(regexp_extract(unnest(requires_dist), '^[A-Za-z0-9_.-]+'), '') AS required
        FROM {source}) WHERE required IS NOT NULL GROUP BY required"""


@query("dependents_est", sql_dependents("dist"), ("dist",))
def _(t):
    return dependent_counts(t.dist)


DOWNLOAD_COUNTS = f"""SELECT file.project AS pkg_name,
      count(*) FILTER (timestamp >= TIMESTAMP '{DOWNLOADS_AS_OF}' - INTERVAL 7 DAY) AS n_downloads_7d,
      count(*) AS n_downloads_30d
    FROM downloads
    WHERE CAST(timestamp AS DATE) >= DATE '{DOWNLOADS_AS_OF:%Y-%m-%d}' - INTERVAL 30 DAY
    GROUP BY ALL"""


@query("downloads_windows", DOWNLOAD_COUNTS, ("downloads",))
def _(t):
    return download_counts(t.downloads, DOWNLOADS_AS_OF)


LATEST_FILES = """SELECT n.name AS pkg_name, n.version AS latest_version, count(*) AS n_distributions
    FROM newest n JOIN dist d ON d.name = n.name AND d.version = n.version
    GROUP BY n.name, n.version"""


@query("distributions_latest", LATEST_FILES, ("newest",))
def _(t):
    return distributions_of_latest(t.dist, ORDER)


RULES = """
      CAST(has_repo_url = 0 AND n_desc_len < 200 AS BIGINT) AS rule_no_repo_low_desc_len,
      CAST(has_suspicious_kw AS BIGINT) AS rule_suspicious_name_and_dep"""


@query(
    "rules",
    f"""SELECT name AS pkg_name, {RULES} FROM (SELECT name,
       {sql_text('summary', 'description')}, {sql_links('u')}
       FROM (SELECT *, {SURFACE} AS u FROM newest))""",
    ("newest",),
)
def _(t):
    rows = latest_release(
        t.dist, ["summary", "description", "home_page", "project_urls", "download_url"], ORDER
    )
    surface = link_surface("home_page", "project_urls", "download_url")
    inputs = rows.select(
        F.col("name").alias("pkg_name"),
        *columns(text_features("summary", "description")),
        *columns(link_features("home_page", surface)),
    )
    rules = rule_features("has_repo_url", "n_desc_len", "has_suspicious_kw")
    return inputs.select("pkg_name", *columns(rules))


FEATURE_LISTS = (
    "latest_project_urls", "distinct_authors", "distinct_maintainers", "distinct_keywords",
    "distinct_classifiers", "latest_dependencies",
)


def sql_features(source, label, dependents="kept"):
    """The wide feature row over ``kept`` rows of dist; requirements count in ``dependents``."""
    return f"""WITH kept AS ({source}),
    release_rows AS ({sql_release('kept', DOWNLOADS_AS_OF)}),
    newest_kept AS (SELECT *, {SURFACE} AS u FROM kept QUALIFY row_number() OVER (PARTITION BY name
        ORDER BY upload_time DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC,
        l_extendedprice DESC) = 1),
    latest_rows AS (SELECT name, version AS latest_version, summary AS latest_summary,
        description AS latest_description, {NAME_COLUMNS}, {sql_text('summary', 'description')},
        {sql_links('u')}, {sql_license('license', 'classifiers')}, {REQUIREMENT_COLUMNS},
        coalesce(array_to_string(project_urls, '|'), '') AS latest_project_urls,
        coalesce(array_to_string(requires_dist, '|'), '') AS latest_dependencies
        FROM newest_kept),
    owners AS (SELECT name, {OWNER_COLUMNS} FROM ({OWNER_LISTS.replace('FROM dist', 'FROM kept')})),
    classes AS (SELECT name, array_to_string(list_sort(list(DISTINCT c)), '|') AS distinct_classifiers
        FROM (SELECT name, unnest(classifiers) AS c FROM kept) GROUP BY name),
    summary_rows AS (SELECT name,
        string_agg(DISTINCT license, ', ' ORDER BY license) AS licenses,
        string_agg(version, ',' ORDER BY version) AS versions,
        min(upload_time) AS t_first_release, max(upload_time) AS t_last_release,
        {sql_set('author_email')} AS distinct_authors,
        {sql_set('maintainer_email')} AS distinct_maintainers,
        {sql_set('keywords')} AS distinct_keywords
        FROM kept GROUP BY name),
    files AS (SELECT k.name, count(*) AS n_distributions FROM kept k JOIN latest_rows l
        ON l.name = k.name AND l.latest_version = k.version GROUP BY k.name),
    popularity AS ({DOWNLOAD_COUNTS}),
    dependents AS ({sql_dependents(dependents)})
    SELECT r.*, l.* EXCLUDE (name, latest_version), o.* EXCLUDE (name), s.* EXCLUDE (name),
      coalesce(c.distinct_classifiers, '') AS distinct_classifiers, f.n_distributions,
      p.n_downloads_7d, p.n_downloads_30d, d.n_dependents_est, {RULES}{label}
    FROM release_rows r JOIN latest_rows l ON l.name = r.pkg_name
    JOIN owners o ON o.name = r.pkg_name JOIN summary_rows s ON s.name = r.pkg_name
    LEFT JOIN classes c ON c.name = r.pkg_name LEFT JOIN files f ON f.name = r.pkg_name
    LEFT JOIN popularity p ON p.pkg_name = r.pkg_name
    LEFT JOIN dependents d ON d.pkg_name = r.pkg_name
    """


@query(
    "feature_table",
    sql_features(
        "SELECT * FROM dist WHERE name IN (SELECT package_name FROM ground_truth)",
        ", CAST(g.is_spam AS DOUBLE) AS is_spam",
    )
    + "JOIN ground_truth g ON g.package_name = r.pkg_name",
    ("ground_truth", "downloads"),
)
def _(t):
    rows = feature_table(t.dist, t.downloads, t.ground_truth, DOWNLOADS_AS_OF, ORDER)
    return rows.withColumns(joined(*FEATURE_LISTS))




@query(
    "feature_one",
    sql_features("SELECT * FROM dist WHERE name = (SELECT min(name) FROM part_names WHERE p_partkey = 40)", ""),
    ("dist", "downloads"),
)
def _(t):
    name = t.part_names.filter("p_partkey = 40").first()["name"]
    rows = feature_row(t.dist, t.downloads, name, DOWNLOADS_AS_OF, ORDER)
    return rows.withColumns(joined(*FEATURE_LISTS))
