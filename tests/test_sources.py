"""Files in and files out."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from siftward.operators.popularity import download_counts
from siftward.plans.mining import known_spam_names
from siftward.sources import commits, download_log
from siftward.sources.readers import (
    archive_package,
    names_in_listing,
    read_distributions,
    read_downloads,
    read_features,
    read_finished_features,
    read_labels,
    read_latest_stages,
    read_listing,
    read_manifests,
)
from siftward.sources.writers import (
    append_labels,
    json_record,
    save_stages,
    write_features,
    write_names,
)

EXPORTED = {
    "pkg_name": "a", "n_name_len": "1", "has_homepage": "1", "has_license": "true",
    "has_digit_in_name": False, "latest_description": "one\r\ntwo", "pct_non_ascii_desc": 0.5,
    "distinct_authors": ["x@y", "z"], "latest_dependencies": "['q>=1']", "is_spam": 0,
    "t_first_release": "2024-11-23 18:43:00.3949 UTC",
}


def check_exported(frame):
    row = frame.first()
    assert row["n_name_len"] == 1
    assert (row["has_homepage"], row["has_license"]) == (1.0, 1.0)
    assert row["has_digit_in_name"] is False
    assert row["latest_description"] == "one two"
    assert row["pct_non_ascii_desc"] == 0.5
    assert row["distinct_authors"] == ["x@y", "z"]
    assert row["latest_dependencies"] == ["q>=1"]
    assert row["is_spam"] == 0
    assert row["t_first_release"] == datetime(2024, 11, 23, 18, 43, 0, 394900)
    assert row["distinct_keywords"] == []


def test_read_lines(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text(json.dumps(EXPORTED) + "\n" + json.dumps({"pkg_name": "b"}) + "\n")
    frame = read_features(spark, str(path))
    assert frame.count() == 2
    check_exported(frame.filter("pkg_name = 'a'"))


def test_read_documents(spark, tmp_path):
    for name, content in (("one.json", EXPORTED), ("many.json", [EXPORTED, EXPORTED])):
        path = tmp_path / name
        path.write_text(json.dumps(content, indent=2))
        frame = read_features(spark, str(path), lines=False)
        assert frame.count() == (2 if name == "many.json" else 1)
        check_exported(frame)


def test_features_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 3, None, True)], "pkg_name string, n_versions long, n_downloads_7d double, has_single_release boolean")
    write_features(rows, str(tmp_path / "out"))
    lines = [line for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines()]
    assert json.loads(lines[0]) == {"pkg_name": "a", "n_versions": 3, "n_downloads_7d": None, "has_single_release": True}
    back = read_finished_features(spark, str(tmp_path / "out")).first()
    assert (back["n_versions"], back["has_single_release"], back["n_downloads_7d"]) == (3, True, None)


def test_append_labels(spark, tmp_path):
    path = str(tmp_path / "labels")
    first = spark.createDataFrame([("a", 0), ("b", 1)], "package_name string, is_spam int")
    append_labels(first, path)
    append_labels(spark.createDataFrame([("b", 0), ("c", 1)], first.schema), path)
    assert sorted(map(tuple, read_labels(spark, path).collect())) == [("a", 0), ("b", 1), ("c", 1)]


def test_tables_with_declared_schema(spark, tmp_path):
    rows = [(datetime(2024, 1, d), ("a",)) for d in (1, 20)]
    log = spark.createDataFrame(rows, "timestamp timestamp, file struct<project:string>")
    log.write.parquet(str(tmp_path / "log"))
    recent = read_downloads(spark, str(tmp_path / "log"), datetime(2024, 1, 10))
    assert recent.count() == 1
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan
    spark.createDataFrame([("a", "1")], "name string, version string").write.parquet(str(tmp_path / "dist"))
    dist = read_distributions(spark, str(tmp_path / "dist"))
    assert dist.first()["requires_dist"] is None and len(dist.columns) == 16


def test_archive_names(evaluate):
    values = ["pkg-1.0.tar.gz", "my-pkg-2.tar.gz", "a-1-2.0.tar.gz", "pkg-1.0b.tar.gz", "pkg.tar.gz", "-1.tar.gz", "pkg-1.0.zip"]
    assert evaluate(archive_package, values) == ["pkg", "my-pkg", "a-1", None, None, None, None]


def test_listing_and_manifest(spark, tmp_path):
    (tmp_path / "listing.txt").write_text(
        "\n".join(
            [
                "reg-main/", "reg-main/evil/", "reg-main/evil/evil-1.0.tar.gz",
                "reg-main/evil/evil-1.1.tar.gz", "reg-main/reg-2.0.tar.gz", "other/good-1.0.tar.gz",
                "reg-main/README.md", "reg-main/num2words/num2words-0.5.tar.gz",
            ]
        )
    )
    (tmp_path / "manifest.json").write_text(json.dumps({"worse": None, "evil": ["1.0"], "ultralytics": ["8"]}, indent=1))
    listing = read_listing(spark, str(tmp_path / "listing.txt"), "reg")
    manifest = read_manifests(spark, str(tmp_path / "manifest.json"))
    assert sorted(r[0] for r in listing.collect()) == ["evil", "evil", "num2words"]
    names = known_spam_names(listing, manifest)
    assert [r[0] for r in names.collect()] == ["evil", "worse"]
    write_names(names, str(tmp_path / "names"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "names")).collect()] == ["evil", "worse"]
    only = names_in_listing(spark.createDataFrame([("reg/x-1.tar.gz",)], "e string"), "e", "reg")
    assert known_spam_names(only, only, excluded=()).count() == 1


def test_json_record(spark):
    frame = spark.createDataFrame(
        [("a", datetime(2024, 1, 2, 3, 4, 5), ["x"], None)],
        "name string, t timestamp, l array<string>, d double",
    )
    text = frame.select(json_record(frame)).first()[0]
    assert json.loads(text) == {"name": "a", "t": "2024-01-02T03:04:05+00:00", "l": ["x"], "d": None}
    plain = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-02 03:04:05.000120' AS a, TIMESTAMP '2024-01-02 03:04:05.5' AS b")
    assert json.loads(plain.select(json_record(plain)).first()[0]) == {
        "a": "2024-01-02T03:04:05.000120", "b": "2024-01-02T03:04:05.500000+00:00",
    }


def test_broken_files_are_errors(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"pkg_name": "a"}\n{"pkg_name": \n')
    (tmp_path / "names.json").write_text('{"a": 1, ')
    for read in (read_features, read_finished_features):
        with pytest.raises(Exception, match="(?i)malformed"):
            read(spark, str(tmp_path / "rows.jsonl")).collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        read_manifests(spark, str(tmp_path / "names.json")).collect()


def test_appending_repeats_and_unknown_errors(spark, tmp_path):
    mined = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0)], "package_name string, is_spam int")
    for _ in range(2):
        append_labels(mined, str(tmp_path / "labels"))
    assert sorted(tuple(r) for r in read_labels(spark, str(tmp_path / "labels")).collect()) == [("a", 1), ("b", 0)]


def test_interleaved_appends_leave_each_name_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "labels")
    rows = lambda *names: spark.createDataFrame([(n, 1) for n in names], "package_name string, is_spam int")
    append_labels(rows("a"), path)
    commit, calls = commits.commit, []

    def slow(*arguments):
        # Another writer commits between this one's look and its commit.
        calls.append(arguments[2])
        if len(calls) == 1:
            append_labels(rows("b", "c"), path)
        return commit(*arguments)

    monkeypatch.setattr(commits, "commit", slow)
    append_labels(rows("c", "d", "a"), path)
    append_labels(rows("c", "d"), path)
    assert sorted(r["package_name"] for r in read_labels(spark, path).collect()) == ["a", "b", "c", "d"]
    assert calls == [2, 2, 3, 4] and commits.state(spark, path)[0] == 4


def test_part_of_a_lost_writer_is_not_read(spark, tmp_path):
    path = str(tmp_path / "labels")
    rows = spark.createDataFrame([("a", 1)], "package_name string, is_spam long")
    append_labels(rows, path)
    rows.write.parquet(f"{path}/part-lost")
    assert read_labels(spark, path).count() == 1 and not commits.commit(spark, path, 1, ["part-lost"])
    assert read_labels(spark, path).count() == 1


def test_appending_to_a_table_without_commits(spark, tmp_path):
    path = str(tmp_path / "labels")
    spark.createDataFrame([("a", 1), ("b", 0)], "package_name string, is_spam long").write.parquet(path)
    append_labels(spark.createDataFrame([("b", 1), ("c", 1)], "package_name string, is_spam int"), path)
    assert sorted(map(tuple, read_labels(spark, path).collect())) == [("a", 1), ("b", 0), ("c", 1)]


def adds(number):
    return PipelineModel([SQLTransformer(statement=f"SELECT *, x + {number} AS y FROM __THIS__")])


def test_save_stages(spark, tmp_path):
    frame = spark.range(1).select(F.col("id").alias("x"))
    path = save_stages(adds(1), str(tmp_path), datetime(2024, 1, 2, 3, 4, 5))
    assert path.rsplit("/", 1)[1].startswith("20240102_030405")
    assert PipelineModel.load(path).transform(frame).first()["y"] == 1
    save_stages(adds(2), str(tmp_path), datetime(2024, 1, 2, 3, 4, 5))
    assert read_latest_stages(spark, str(tmp_path)).transform(frame).first()["y"] == 2


@pytest.mark.parametrize("step", ["_written", "_rename"])
def test_failed_publishing_leaves_the_old_stages(spark, tmp_path, monkeypatch, step):
    frame = spark.range(1).select(F.col("id").alias("x"))
    save_stages(adds(1), str(tmp_path), datetime(2024, 1, 2))

    def fails(*_, **__):
        raise OSError("lost")

    monkeypatch.setattr(commits, step, fails)
    with pytest.raises(OSError):
        save_stages(adds(2), str(tmp_path), datetime(2024, 1, 3))
    assert read_latest_stages(spark, str(tmp_path)).transform(frame).first()["y"] == 1


# --- download log ----------------------------------------------------------


@pytest.fixture(scope="module")
def log_rows():
    draw = random.Random(3)
    start = datetime(2024, 3, 1)
    rows = [(start + timedelta(minutes=draw.randrange(45 * 24 * 60)), (draw.choice("abcd"),)) for _ in range(3000)]
    # A third of all rows on one day, and some without a moment or a name.
    rows += [(datetime(2024, 4, 2, 5), ("hot",))] * 1500 + [(None, ("a",)), (datetime(2024, 4, 3), (None,))]
    return rows


LOG = "timestamp timestamp, file struct<project:string>"


def test_windows_from_daily_counts(spark, tmp_path, log_rows):
    raw = spark.createDataFrame(log_rows, LOG)
    log, daily = str(tmp_path / "log"), str(tmp_path / "daily")
    download_log.store_log(raw, log)
    download_log.store_daily(spark, log, daily)
    for as_of in (datetime(2024, 4, 9, 13, 30), datetime(2024, 4, 10), datetime(2024, 4, 30, 23, 59)):
        got = download_log.window_counts(spark, log, daily, as_of)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, download_counts(raw, as_of).collect()), key=repr)


def test_log_is_pruned_by_date(spark, tmp_path, log_rows):
    raw = spark.createDataFrame(log_rows, LOG)
    log, daily = str(tmp_path / "log"), str(tmp_path / "daily")
    download_log.store_log(raw, log)
    download_log.store_daily(spark, log, daily)
    counts = download_log.window_counts(spark, log, daily, datetime(2024, 4, 9, 12))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert len(scans) == 2 and all("PartitionFilters: [isnotnull(date" in s for s in scans)
    # The next day: one day of the log is read, and its counts replace nothing else.
    day = [date(2024, 4, 2)]
    one = download_log.read_log(spark, log, day)
    assert one.count() == sum(t is not None and t.date() == day[0] for t, _ in log_rows)
    more = spark.createDataFrame([(datetime(2024, 5, 1, 1), ("a",))] * 3, LOG)
    download_log.store_log(more, log)
    download_log.store_daily(spark, log, daily, [date(2024, 5, 1)])
    stored = spark.read.schema(download_log.DAILY).parquet(daily)
    assert stored.where("date = '2024-05-01'").collect()[0]["n"] == 3
    assert stored.agg(F.sum("n")).first()[0] == sum(t is not None for t, _ in log_rows) + 3
    # A day that is delivered again is counted once.
    download_log.store_log(more, log)
    download_log.store_daily(spark, log, daily, [date(2024, 5, 1)])
    assert spark.read.schema(download_log.DAILY).parquet(daily).where("date = '2024-05-01'").first()["n"] == 3
