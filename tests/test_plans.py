"""Whole jobs on small registries."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftward import config
from siftward.models.train import Settings, ensemble_scores, split_features, train_ensemble
from siftward.operators import scope as scoping
from siftward.plans.features import (
    feature_row,
    feature_table,
    link_table,
    package_metadata,
    release_table,
)
from siftward.plans.mining import as_labels, mid_download_packages, mine_benign, mine_long_names
from siftward.plans.offline import (
    TextModels,
    drop_raw,
    enrich,
    fill_missing,
    finish_features,
    run_features,
)
from siftward.plans.scan import (
    download_rows,
    numeric_values,
    offline_values,
    scan_features,
    scan_packages,
)
from siftward.plans.training import train_and_save
from siftward.session import cut_lineage
from siftward.sources.readers import read_latest_stages
from siftward.sources.schemas import DISTRIBUTION_METADATA
from siftward.sources.writers import write_features

AS_OF = datetime(2024, 3, 1, 12)


def release(name, version, when, **fields):
    row = {f.name: None for f in DISTRIBUTION_METADATA.fields}
    return row | {"name": name, "version": version, "upload_time": when} | fields


@pytest.fixture(scope="module")
def dist(spark):
    day = datetime(2024, 2, 1, 8)
    rows = [
        release("good", "1.0", day, summary="old", author_email="a@gmail.com", license="MIT License",
                requires_dist=["django>=3", "flsk"], classifiers=["Typing :: Typed"], has_signature=True),
        release("good", "1.1", day + timedelta(days=3), summary="A tool", description="A python tool\nmore",
                author_email="b@corp.org", home_page="https://good.org", requires_dist=["requests; extra == 'x'"],
                project_urls=["Source, https://github.com/g/g"], classifiers=["Programming Language :: Python"]),
        release("good", "1.1", day + timedelta(days=3, hours=1), summary="A tool", description="A python tool\nmore",
                author_email="b@corp.org", home_page="https://good.org", requires_dist=["requests; extra == 'x'"],
                project_urls=["Source, https://github.com/g/g"], classifiers=["Programming Language :: Python"]),
        release("evil", "0.1", day, description="free bitcoin", requires_dist=["good", "good[x]"]),
        release("undated", "0.1", None, description="never released"),
        release("other", "2.0", day, description="something else", requires_dist=["good"]),
        release("x" * 41, "1", day),
    ]
    rows += [release("busy", f"{i}.0", day + timedelta(days=i)) for i in range(16)]
    return spark.createDataFrame([tuple(r[f.name] for f in DISTRIBUTION_METADATA.fields) for r in rows],
                                 DISTRIBUTION_METADATA).cache()


@pytest.fixture(scope="module")
def downloads(spark):
    times = [("good", AS_OF - timedelta(hours=h)) for h in (1, 24 * 7, 24 * 7 + 1, 24 * 29)]
    times += [("evil", AS_OF - timedelta(days=40)), ("other", AS_OF)]
    return spark.createDataFrame([(t, (n,)) for n, t in times], "timestamp timestamp, file struct<project:string>").cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [("good", 0), ("good", 0), ("evil", 1), ("undated", 1), ("absent", 0), ("evil", 0)]
    return spark.createDataFrame(rows, "package_name string, is_spam long").cache()


def test_feature_table(dist, downloads, labels):
    table = feature_table(dist, downloads, labels, AS_OF)
    assert table.columns == [*config.FEATURE_COLUMNS, "is_spam"]
    assert len(table.columns) == 54
    rows = {r["pkg_name"]: r for r in table.collect()}
    # Without a dated upload there is no row; a repeated label makes no more rows.
    assert sorted(rows) == ["evil", "good"]
    good = rows["good"]
    expected = {
        "n_versions": 2, "n_distributions": 2, "versions": "1.0,1.1,1.1", "latest_summary": "A tool",
        "t_median_release_gap_days": 0, "t_age_first_release_days": 29, "t_age_last_release_days": 26,
        "n_maintainers": 2, "pct_free_email_domains": 0.5, "has_missing_author": 0, "has_repo_url": 1,
        "cat_repo_host": "github", "has_homepage": 1, "has_license": 0, "licenses": "MIT License",
        "cat_license_family": "other_or_unknown", "n_requires": 1, "has_extras": 1, "n_desc_lines": 2,
        "n_downloads_7d": 2, "n_downloads_30d": 4, "n_dependents_est": 1, "is_spam": 0.0,
        "t_time_of_day_bucket": "morning_06_11", "cat_weekday_of_last_release": "Sunday",
        "distinct_classifiers": ["Programming Language :: Python", "Typing :: Typed"],
        "latest_dependencies": ["requests; extra == 'x'"], "rule_no_repo_low_desc_len": 0,
    }
    assert {k: good[k] for k in expected} == expected
    evil = rows["evil"]
    assert (evil["is_spam"], evil["has_missing_author"], evil["rule_suspicious_name_and_dep"]) == (0.5, 1, 1)
    assert (evil["n_downloads_30d"], evil["n_dependents_est"], evil["has_single_release"]) == (None, None, True)
    assert evil["rule_no_repo_low_desc_len"] == 1


def same(left, right):
    return sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def test_long_label_lists(dist, downloads, labels, monkeypatch):
    short = feature_table(dist, downloads, labels, AS_OF)
    meta = package_metadata(dist, labels)
    monkeypatch.setattr(scoping, "fits_broadcast", lambda names: False)
    assert same(short, feature_table(dist, downloads, labels, AS_OF))
    assert same(meta, package_metadata(dist, labels))


def test_dependents_of_all(dist, downloads, labels):
    rows = feature_table(dist, downloads, labels, AS_OF, dependents_scope="all").collect()
    assert {r["pkg_name"]: r["n_dependents_est"] for r in rows} == {"good": 2, "evil": None}


def test_one_package(dist, downloads, labels):
    table = feature_table(dist, downloads, labels, AS_OF).filter("pkg_name = 'good'")
    one = feature_row(dist, downloads, "good", AS_OF)
    # Alone, a package has no dependents but itself.
    assert same(table.drop("is_spam", "n_dependents_est"), one.drop("n_dependents_est"))
    assert feature_row(dist, downloads, "absent", AS_OF).count() == 0


def test_reports(dist, labels):
    links = {r["name"]: r for r in link_table(dist, labels).collect()}
    assert sorted(links) == ["evil", "good", "undated"]
    assert links["good"]["version"] == "1.1" and links["good"]["has_repo_url"] == 1
    releases = release_table(dist, labels, AS_OF).collect()
    assert [r["pkg_name"] for r in releases] == ["evil", "good"]
    meta = {r["name"]: r for r in package_metadata(dist, labels).collect()}
    assert meta["good"]["signed_version_count"] == 1 and meta["good"]["latest_dependency_count"] == 1
    assert meta["undated"]["distinct_authors"] == [] and meta["undated"]["licenses"] is None


def test_miners(spark, dist, downloads, labels):
    benign = mine_benign(dist, downloads, labels, AS_OF)
    assert [tuple(r) for r in benign.collect()] == [("busy", 0)]
    with_null = labels.union(spark.createDataFrame([(None, 1)], labels.schema))
    assert mine_benign(dist, downloads, with_null, AS_OF).count() == 1
    assert mine_benign(dist, downloads, spark.createDataFrame([("busy", 1)], labels.schema), AS_OF).count() == 0
    long = mine_long_names(dist, AS_OF)
    assert [(r["package_name"], r["name_length"]) for r in long.collect()] == [("x" * 41, 41)]
    assert as_labels(long).columns == ["package_name", "is_spam"]
    assert mine_long_names(dist, AS_OF + timedelta(days=400)).count() == 0
    middle = mid_download_packages(dist, downloads, AS_OF, between=(1, 3))
    assert middle.count() == 0
    later = AS_OF + timedelta(days=366)
    log = downloads.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 366 DAYS"))
    rows = mid_download_packages(dist, log, later, between=(1, 4)).collect()
    assert [(r["name"], r["download_count"]) for r in rows] == [("good", 4), ("other", 1)]


@pytest.fixture(scope="module")
def raw(dist, downloads, labels, spark):
    names = dist.select(F.col("name").alias("package_name"), F.lit(0).cast("long").alias("is_spam")).distinct()
    marked = names.withColumn("is_spam", F.when(F.col("package_name") == "evil", 1).otherwise(0).cast("long"))
    return feature_table(dist, downloads, marked, AS_OF).cache()


def test_offline(raw, spark, tmp_path):
    finished = finish_features(raw)
    assert not set(config.RAW_COLUMNS) & set(finished.columns)
    assert set(config.OFFLINE_FEATURES) <= set(finished.columns)
    rows = {r["pkg_name"]: r for r in finished.collect()}
    assert len(rows) == raw.count()
    assert rows["evil"]["t_time_of_day"] == "morning" and rows["evil"]["cat_license_family"] == "unknown"
    assert rows["busy"]["dist_embed_to_legit_desc"] == 1.0 and rows["busy"]["min_dep_lev_to_brand"] == 20.0
    assert rows["good"]["has_dependency_to_top_brand"] == 1 and rows["good"]["n_latest_project_urls"] == 1
    assert rows["good"]["n_low_download_pkgs_by_maintainers"] == 2.0
    # File to file gives the same rows.
    write_features(raw, str(tmp_path / "raw"))
    run_features(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    for line in lines:
        for column, value in rows[line["pkg_name"]].asDict().items():
            got = line[column]
            assert got == (pytest.approx(value) if isinstance(value, float) else value) or float(got) == value, column


def test_saved_texts_score_alike(raw, spark, tmp_path):
    texts = TextModels.fit(raw)
    together = {r["pkg_name"]: r for r in enrich(raw, texts).collect()}
    texts.save(str(tmp_path))
    loaded = TextModels.load(spark, str(tmp_path))
    alone = enrich(raw.filter("pkg_name = 'good'"), loaded, owners=raw).first()
    for c in ("sim_tfidf_to_legit_centroid", "dist_embed_to_legit_desc", "n_low_download_pkgs_by_maintainers"):
        assert alone[c] == pytest.approx(together["good"][c])


def test_no_good_packages(raw):
    spam = raw.withColumn("is_spam", F.lit(1.0))
    assert finish_features(spam).count() == raw.count()
    unlabelled = raw.drop("is_spam")
    assert "is_spam" not in finish_features(unlabelled).columns


def test_scan(dist, downloads, raw, spark):
    texts = TextModels.fit(raw)
    finished = enrich(raw, texts, distance=texts.own_distance()).cache()
    wide = finished.unionByName(finished.withColumn("pkg_name", F.concat("pkg_name", F.lit("2"))))
    model = train_ensemble(
        wide.withColumn("label", F.col("is_spam").cast("double")), Settings(forest_trees=3, max_iterations=10)
    )
    names = spark.createDataFrame([("good",), ("absent",)], "name string")
    rows = scan_packages(dist, downloads, names, AS_OF, texts, model, owners=raw).collect()
    assert [r["package"] for r in rows] == ["good"]
    (row,) = rows
    assert 0.0 <= row["prediction"] <= 1.0 and row["verdict"] in ("SAFE", "DANGEROUS")
    assert json.loads(row["raw_data"])["versions"] == "1.0,1.1,1.1"
    assert json.loads(row["features"])["n_versions"] == 2


def test_owners_of_packages_outside_the_known_ones(dist, downloads, raw, spark):
    """A scanned package gets its owners' counts, alone and among others."""
    known = raw.filter("pkg_name <> 'good'")
    texts = TextModels.fit(known)
    every = {r["pkg_name"]: r for r in enrich(raw, texts).collect()}
    counts = ("n_pkgs_by_maintainers_30d", "n_low_download_pkgs_by_maintainers", "n_dependents_est")

    def scanned(*names):
        frame = spark.createDataFrame([(n,) for n in names], "name string")
        _, finished = scan_features(dist, downloads, frame, AS_OF, texts, owners=known)
        return {r["pkg_name"]: tuple(r[c] for c in counts) for r in finished.collect()}

    alone = scanned("good")["good"]
    assert alone[:2] == tuple(every["good"][c] for c in counts[:2]) and alone[1] > 0
    others = [r["pkg_name"] for r in raw.select("pkg_name").collect() if r["pkg_name"] != "good"]
    assert scanned("good", *others)["good"] == alone


def test_odd_labels_and_missing_features(raw, spark):
    """Averaged labels count as their whole part; rows without a label are left out; nulls can be scored."""
    texts = TextModels.fit(raw)
    finished = cut_lineage(enrich(raw, texts, distance=texts.own_distance()))
    rows = finished
    for k, label in enumerate((0.0, 1.0, 0.5, None)):
        copy = finished.withColumn("pkg_name", F.concat("pkg_name", F.lit(f"-{k}")))
        rows = rows.unionByName(copy.withColumn("is_spam", F.lit(label).cast("double")))
    rows = rows.withColumn("n_distributions", F.lit(None).cast("long"))
    train, test = split_features(rows)
    both = train.unionByName(test)
    assert both.filter("label not in (0.0, 1.0)").count() == 0 and both.filter("pkg_name like '%-3'").count() == 0
    assert both.filter("pkg_name like '%-2' and label = 0").count() == finished.count()
    model = train_ensemble(train, Settings(forest_trees=3, max_iterations=10))
    scores = ensemble_scores(model, test).select("prediction_score").collect()
    assert scores and all(0 <= r[0] <= 1 for r in scores)


def test_training_is_kept(raw, spark, tmp_path):
    finished = finish_features(raw)
    wide = finished
    for k in range(4):
        wide = wide.unionByName(finished.withColumn("pkg_name", F.concat("pkg_name", F.lit(str(k)))))
    wide = wide.withColumn("is_spam", F.when(F.col("pkg_name").contains("1"), 1).otherwise(0))
    report = train_and_save(wide, str(tmp_path), AS_OF, Settings(forest_trees=3, max_iterations=10))
    assert {r["class"] for r in report.collect()} >= {"macro avg", "weighted avg"}
    assert [p.is_dir() for p in tmp_path.glob(f"{AS_OF:%Y%m%d_%H%M%S}-*")] == [True]
    assert read_latest_stages(spark, str(tmp_path)).transform(wide.limit(3)).count() == 3


def test_values_in_long_form(raw):
    finished = finish_features(raw)
    values = offline_values(finished)
    assert values.count() == raw.count() * len(config.OFFLINE_FEATURES)
    assert numeric_values(values).count() == raw.count() * (len(config.OFFLINE_FEATURES) - 1)
    windows = {(r["pkg_name"], r["window"]): r["downloads"] for r in download_rows(raw).collect()}
    assert windows[("good", "7d")] == 2.0 and ("evil", "7d") not in windows


def test_pruning_and_fills(spark):
    frame = spark.createDataFrame([(1, 2, "x")], "versions int, Versions_2 int, latest_summary string")
    assert drop_raw(frame).columns == ["Versions_2"]
    texts = spark.createDataFrame([("100", None), ("bad", "MIT")], "n_downloads_30d string, cat_license_family string")
    assert [tuple(r) for r in fill_missing(texts).collect()] == [(100.0, "unknown"), (0.0, "MIT")]
    assert fill_missing(frame).columns == frame.columns
