"""Reference values shared by the features.

Everything in this module is a fixed value: results depend on these lists,
patterns and thresholds being exactly as they are.
"""

# --- fixed values: reference names ---------------------------------------
TOP_PACKAGES = [
    "requests", "numpy", "pandas", "flask", "django", "scipy", "pytest",
    "matplotlib", "scikit-learn",
]
BRAND_ALIASES = [
    "google", "microsoft", "amazon", "facebook", "meta", "apple", "paypal",
    "stripe", "github", "gitlab",
]
BRAND_PACKAGES = [
    "django", "flask", "requests", "tensorflow", "torch", "boto3", "azure",
    "google-cloud-storage", "stripe",
]
COMPROMISED_NOT_SPAM = ["num2words", "ultralytics"]

# --- fixed values: thresholds --------------------------------------------
CLOSE_DISTANCE = 2
LOW_DOWNLOADS_30D = 50
RECENT_RELEASE_DAYS = 30
SHORT_DESCRIPTION = 200
LONG_NAME = 40
VOCABULARY_SIZE = 5000
VERDICT_THRESHOLD = 0.8
RISK_TIERS = [(0.2, "Low"), (0.5, "Moderate"), (0.8, "High")]
TOP_RISK_TIER = "Critical"
NO_RISK_TIER = "Unknown"

# --- fixed values: words and patterns ------------------------------------
SUSPICIOUS_WORDS = [
    "bitcoin", "mining", "keylogger", "crack", "hack tool", "stealer",
    "remote control",
]
CAMEL_CASE = "^[a-z]+([A-Z][a-z0-9]*)+\\z"
CODE_BLOCK = "```|::[\\t\\n\\f\\r ]*\\n"
URL = "https?://[^\\t\\n\\f\\r )]+"
HOME_PAGE = "https?://"
REPO_HOSTS = [
    ("github.com", "github"),
    ("gitlab.com", "gitlab"),
    ("bitbucket.org", "bitbucket"),
    ("codeberg.org", "codeberg"),
    ("sourceforge.net", "sourceforge"),
    ("gitee.com", "gitee"),
]
ISSUE_TRACKERS = [
    "/issues", "/pulls", "/merge_requests", "youtrack", "bugzilla", "jira",
]
DOCS = "readthedocs|(^|[\\t\\n\\f\\r ])https?://docs\\.|/docs(/|\\z)"
LICENSE_CLASSIFIER = "(^|[^a-z0-9_])license[\\t\\n\\f\\r ]*::"
LICENSE_FAMILIES = [
    ("MIT", ["mit license"]),
    ("GPL", ["gnu general public license", "gpl"]),
    ("Apache", ["apache license"]),
    ("BSD", ["bsd license"]),
]
NO_LICENSE_FAMILY = "other_or_unknown"
LANGUAGE_CLASSIFIER = "Programming Language :: Python"
TYPING_CLASSIFIER = "Typing ::"
FREE_MAIL = "@(gmail\\.com|outlook\\.com|yahoo\\.com|hotmail\\.com|protonmail\\.com)\\z"
DISPOSABLE_MAIL = "@(mailinator\\.com|10minutemail\\.com|guerrillamail\\.com)"
EXTRA_MARKER = "extra[\\t\\n\\f\\r ]*=="
REQUIRED_NAME = "^([A-Za-z0-9_.-]+)"
ARCHIVE_NAME = "^(.+)-[0-9]+(\\.[0-9]+)*\\.tar\\.gz$"
TIME_BUCKETS = [
    (5, "night_00_05"),
    (11, "morning_06_11"),
    (17, "afternoon_12_17"),
    (23, "evening_18_23"),
]
TIMES_OF_DAY = ["evening", "morning", "night", "afternoon"]

# English stop words; pass another list to use it instead.
STOP_WORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself it its itself they them their theirs themselves what
    which who whom this that these those am is are was were be been being have has had
    having do does did doing a an the and but if or because as until while of at by for
    with about against between into through during before after above below to from up
    down in out on off over under again further then once here there when where why how
    all any both each few more most other some such no nor not only own same so than too
    very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd
    you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
    you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't
    didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
    how's let's ought that's there's what's when's where's who's why's would
""".split()

# --- fixed values: columns -----------------------------------------------
NUMERIC_FILLS = {
    "t_median_release_gap_days": 0.0,
    "n_downloads_7d": 0.0,
    "n_downloads_30d": 0.0,
    "n_dependents_est": 0.0,
    "min_dep_lev_to_brand": 20.0,
}
LIST_COLUMNS = [
    "distinct_authors", "distinct_maintainers", "distinct_keywords",
    "distinct_classifiers", "latest_project_urls", "latest_dependencies",
]
FLAG_COLUMNS = [
    "has_homepage", "has_repo_url", "has_issue_tracker", "has_docs_url",
    "has_license", "has_prog_lang_classifier", "has_typing_classifier",
    "has_extras", "has_missing_author", "has_disposable_email",
]
RAW_COLUMNS = [
    "latest_description", "latest_summary", "licenses",
    "latest_dependencies", "distinct_classifiers", "distinct_keywords",
    "distinct_maintainers", "distinct_authors", "latest_project_urls",
    "t_last_release", "t_first_release", "t_time_of_day_bucket", "versions",
]
OFFLINE_FEATURES = [
    "n_lev_dist_to_top1", "n_lev_dist_to_alias",
    "sim_tfidf_to_legit_centroid", "dist_embed_to_legit_desc",
    "n_pkgs_by_maintainers_30d", "n_low_download_pkgs_by_maintainers",
    "n_latest_project_urls", "has_dependency_to_top_brand",
    "min_dep_lev_to_brand", "has_dependency_lev_close_to_brand",
    "t_time_of_day",
]

# Order in which the wide feature row is delivered.
FEATURE_COLUMNS = [
    "pkg_name",
    "n_name_len", "has_digit_in_name", "has_dash_or_underscore", "cat_name_case",
    "n_summary_len", "n_desc_len", "n_desc_lines", "has_code_block_in_desc",
    "n_urls_in_desc", "has_suspicious_kw", "pct_non_ascii_desc",
    "t_age_first_release_days", "t_age_last_release_days", "n_versions",
    "t_median_release_gap_days", "has_single_release", "t_time_of_day_bucket",
    "cat_weekday_of_last_release",
    "n_maintainers", "pct_free_email_domains", "has_disposable_email",
    "has_missing_author",
    "has_homepage", "has_repo_url", "cat_repo_host", "has_issue_tracker",
    "has_docs_url",
    "has_license", "cat_license_family", "n_classifiers",
    "has_prog_lang_classifier", "has_typing_classifier",
    "n_distributions",
    "n_requires", "has_extras",
    "n_downloads_7d", "n_downloads_30d", "n_dependents_est",
    "rule_no_repo_low_desc_len", "rule_suspicious_name_and_dep",
    "licenses", "versions", "t_first_release", "t_last_release",
    "latest_summary", "latest_description", "latest_project_urls",
    "distinct_authors", "distinct_maintainers", "distinct_keywords",
    "distinct_classifiers", "latest_dependencies",
]
