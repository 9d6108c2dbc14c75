"""Column expressions at their boundaries."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftward import config
from siftward.functions import cleaning, distance, links, moments, names, people, requirements
from siftward.functions import risk, text


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_name_case(evaluate):
    values = ["requests", "my-pkg", "fooBar", "fooBar9Baz", "FooBar", "foo_Bar", "a1B", None]
    expected = ["lower", "lower", "camel", "camel", "mixed", "mixed", "mixed", "mixed"]
    assert evaluate(names.name_case, values) == expected


@pytest.mark.parametrize(
    "feature, expected",
    [
        ("n_name_len", [2, 4, 3, 1]),
        ("has_digit_in_name", [True, False, False, False]),
        ("has_dash_or_underscore", [False, False, True, False]),
    ],
)
def test_name_features(evaluate, feature, expected):
    values = ["a1", "abcd", "a-b", "é"]
    assert evaluate(lambda c: names.name_features(c)[feature], values) == expected


def test_text_shape(evaluate):
    values = [None, "", "a", "a\n", "a\nb\n\nc"]
    assert evaluate(text.text_length, values) == [0, 0, 1, 2, 6]
    assert evaluate(text.line_count, values) == [1, 1, 1, 2, 4]


def test_code_block(evaluate):
    values = ["```x```", "usage::\n  x", "usage:: \t\n x", "usage:: x", "``x``", None]
    assert evaluate(text.has_code_block, values) == [True, True, True, False, False, False]


def test_url_count(evaluate):
    values = ["see HTTP://a.b and (https://c.d/e) https://", "none", None, "https://a https://b"]
    assert evaluate(text.url_count, values) == [2, 0, 0, 2]


def test_suspicious_words(evaluate):
    values = ["A BitCoin miner", "data mining", "hack  tool", "hack tool", None, "cracker"]
    assert evaluate(text.has_suspicious_word, values) == [True, True, False, True, False, True]


def test_non_ascii_share(evaluate):
    assert evaluate(text.non_ascii_share, ["abc", "é", "a中", None, ""]) == [
        0.0, 0.5, 0.5, 0.0, 0.0,
    ]


def test_hour_bucket_edges(evaluate):
    hours = [0, 5, 6, 11, 12, 17, 18, 23]
    values = [datetime(2024, 1, 1, h, 59, 59) for h in hours] + [None]
    quarters = ["night_00_05", "morning_06_11", "afternoon_12_17", "evening_18_23"]
    expected = [q for q in quarters for _ in range(2)] + ["evening_18_23"]
    assert evaluate(moments.hour_bucket, values, "timestamp") == expected


def test_time_of_day_order(evaluate):
    values = ["evening_18_23", "NIGHT_00_05", "evening night", "morning night", "afternoon", "noon",
              None, "123"]
    assert evaluate(moments.time_of_day, values) == [
        "evening", "night", "evening", "morning", "afternoon", "unknown", "unknown", "unknown",
    ]


def test_weekday_and_age(evaluate):
    values = [datetime(2024, 1, 1, 23, 59), None]
    assert evaluate(moments.weekday, values, "timestamp") == ["Monday", None]
    as_of = datetime(2024, 1, 2, 0, 1)
    # Calendar days, not spans of 24 hours.
    assert evaluate(lambda c: moments.age_days(c, as_of), values, "timestamp") == [1, None]


def test_repo_host_first_match(evaluate):
    values = ["https://gitlab.com/x https://github.com/y", "https://codeberg.org", "githubXcom", ""]
    assert evaluate(links.repo_host, values) == ["github", "codeberg", "unknown", "unknown"]


def test_link_flags(spark):
    rows = [
        ("HTTPS://Docs.Example.org", ["Tracker, https://github.com/a/b/issues"], None),
        ("docs.example.org", None, "https://x.org/docs"),
        (None, [], "https://x.org/docsify"),
    ]
    frame = spark.createDataFrame(rows, "home string, urls array<string>, download string")
    surface = frame.withColumn("surface", links.link_surface("home", "urls", "download"))
    out = surface.select(
        *(c.alias(n) for n, c in links.link_features("home", "surface").items())
    ).collect()
    assert [r["has_homepage"] for r in out] == [1, 0, 0]
    assert [r["has_repo_url"] for r in out] == [1, 0, 0]
    assert [r["has_issue_tracker"] for r in out] == [1, 0, 0]
    assert [r["has_docs_url"] for r in out] == [1, 1, 0]


def test_license(spark):
    rows = [
        ("MIT License", None),
        ("  ", ["License :: OSI Approved :: BSD License"]),
        (None, ["Topic :: Sublicense :: X", "Programming Language :: Python"]),
        ("LGPL", ["typing :: typed"]),
        (None, None),
    ]
    frame = spark.createDataFrame(rows, "license string, classifiers array<string>")
    out = frame.select(
        *(c.alias(n) for n, c in links.license_features("license", "classifiers").items())
    ).collect()
    assert [r["has_license"] for r in out] == [1, 1, 0, 1, 0]
    assert [r["cat_license_family"] for r in out] == [
        "MIT", "BSD", "other_or_unknown", "GPL", "other_or_unknown",
    ]
    assert [r["n_classifiers"] for r in out] == [0, 1, 2, 1, 0]
    assert [r["has_prog_lang_classifier"] for r in out] == [0, 0, 1, 0, 0]
    assert [r["has_typing_classifier"] for r in out] == [0, 0, 0, 0, 0]


def test_owner_features(spark):
    rows = [
        (["a@gmail.com", "b@corp.org"], ["a@gmail.com"]),
        ([], ["x@mailinator.com.evil"]),
        (None, None),
        (["a@gmail.com.au"], None),
    ]
    frame = spark.createDataFrame(rows, "a array<string>, m array<string>")
    out = frame.select(*(c.alias(n) for n, c in people.owner_features("a", "m").items())).collect()
    assert [r["n_maintainers"] for r in out] == [3, 1, 0, 1]
    assert [round(r["pct_free_email_domains"], 3) for r in out] == [0.667, 0.0, 0.0, 0.0]
    assert [r["has_disposable_email"] for r in out] == [0, 1, 0, 0]
    assert [r["has_missing_author"] for r in out] == [0, 1, 1, 0]


def test_requirement_names(evaluate):
    values = ["requests>=2.0", "google-cloud-storage==1.0; python_version<'3.10'", " a ~=1", "a[b]>1",
              "", ";x", "\tdjango <2", None]
    assert evaluate(requirements.base_name, values) == [
        "requests", "google-cloud-storage", "a", "a[b]", "", "", "django", None,
    ]
    assert evaluate(requirements.required_name, values) == [
        "requests", "google-cloud-storage", None, "a", None, None, None, None,
    ]


def test_brand_features(spark):
    rows = [
        (["djnago>=3.0"],), (["requests[security]>=2.0"],), ([],), (["", "  "],), (None,),
        (["Django"],), ([None, "numpy"],),
    ]
    frame = spark.createDataFrame(rows, "deps array<string>")
    out = frame.select(*(c.alias(n) for n, c in requirements.brand_features("deps").items())).collect()
    brands = config.BRAND_PACKAGES + config.BRAND_ALIASES
    nearest = [min(edit_distance(n, b) for b in brands) for n in ("requests[security]", "numpy")]
    assert [r["min_dep_lev_to_brand"] for r in out] == [2.0, nearest[0], None, None, None, 0.0, nearest[1]]
    assert [r["has_dependency_lev_close_to_brand"] for r in out] == [1, 0, 0, 0, 0, 1, 0]
    assert [r["has_dependency_to_top_brand"] for r in out] == [0, 0, 0, 0, 0, 1, 0]


def test_extras(evaluate):
    values = [["a; EXTRA == 'x'"], ["extra"], [], None]
    run = lambda f: evaluate(lambda c: requirements.requirement_features(c)[f], values, "array<string>")
    assert run("has_extras") == [1, 0, 0, 0]
    assert run("n_requires") == [1, 1, 0, 0]


def test_known_distances(evaluate):
    values = ["tree-sitter-css", "requests-mock", "Requests", "", None]
    to_top = evaluate(lambda c: distance.nearest_distance(c, config.TOP_PACKAGES), values)
    to_alias = evaluate(lambda c: distance.nearest_distance(c, config.BRAND_ALIASES), values)
    assert to_top == [11, 5, 0, 5, 5]
    assert to_alias[:2] == [12, 10]


def test_distances_by_hand(evaluate):
    values = ["", "a", "étude", "numpyy", "Scikit-Learn", "x" * 500, "malware-pkg"]
    got = evaluate(lambda c: distance.nearest_distance(c, config.TOP_PACKAGES), values)
    assert got == [min(edit_distance(v.lower(), k) for k in config.TOP_PACKAGES) for v in values]


def test_distance_without_names(evaluate):
    assert evaluate(lambda c: distance.nearest_distance(c, []), ["a"]) == [float("inf")]
    within = evaluate(lambda c: distance.nearest_within(c, ["abc"], 1), ["abd", "xyz"])
    assert [(w["distance"], w["is_close"]) for w in within] == [(1, True), (3, False)]


def test_risk(evaluate):
    values = [None, 0.0, 0.19, 0.2, 0.5, 0.79, 0.8, 1.0]
    assert evaluate(risk.risk_tier, values, "double") == [
        "Unknown", "Low", "Low", "Moderate", "High", "High", "Critical", "Critical",
    ]
    assert evaluate(risk.verdict, values, "double") == ["SAFE"] * 7 + ["DANGEROUS"]


def test_rules(spark):
    rows = [(0, 199, True), (0, 200, False), (1, 0, None)]
    frame = spark.createDataFrame(rows, "repo long, len long, kw boolean")
    out = frame.select(*(c.alias(n) for n, c in risk.rule_features("repo", "len", "kw").items())).collect()
    assert [tuple(r) for r in out] == [(1, 1), (0, 0), (0, 0)]


def test_one_line(evaluate):
    assert evaluate(cleaning.one_line, ["a\r\nb\nc", None, ""]) == ["a b c", None, ""]


def test_parsed_list(evaluate):
    values = ["['a', 'b, c']", '["a", null]', "[]", "['a', None]", "plain text", None, "'x'", "123",
              "[broken", "['NoneSuch']"]
    assert evaluate(cleaning.parsed_list, values) == [
        ["a", "b, c"], ["a", None], [], ["a", None], ["plain text"], [], ["x"], ["123"],
        ["[broken"], ["NoneSuch"],
    ]


def test_as_flag(evaluate):
    values = ["true", "False", "TRUE", "1", "0.0", None, "maybe"]
    assert evaluate(cleaning.as_flag, values) == [1.0, 0.0, 1.0, 1.0, 0.0, None, None]


def test_legit(evaluate):
    values = ["0", "1", "invalid", None, "0.0", "nan"]
    assert evaluate(cleaning.is_legit, values) == [True, False, False, False, True, False]


def test_number_and_family(evaluate):
    assert evaluate(cleaning.as_number, ["1.5", "bad", "nan", None]) == [1.5, None, None, None]
    assert evaluate(cleaning.known_family, ["MIT", "other_or_unknown", None]) == [
        "MIT", "unknown", "unknown",
    ]


def test_let_evaluates_lists(evaluate):
    from siftward.functions.common import let

    got = evaluate(lambda c: let(F.upper(c), lambda v: F.concat(v, v)), ["a", None])
    assert got == ["AA", None]
