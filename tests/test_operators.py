"""Operators against brute force, with hot keys among the data."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftward.operators import scope as scoping
from siftward.operators.labels import label_per_package, name_sample, not_listed, with_legit_mask
from siftward.operators.owners import with_owner_activity
from siftward.operators.popularity import dependent_counts, download_counts
from siftward.operators.releases import (
    distributions_of_latest,
    files_of,
    latest_release,
    median_gap,
    release_profile,
    version_files,
    versions_text,
)
from siftward.operators.similarity import (
    corpus_distance,
    description_distance,
    fit_descriptions,
    fit_names,
    name_similarity,
)
from siftward.operators import similarity, skew
from siftward.operators.skew import lookup_join, numbered, running_totals
from siftward.session import cut_lineage


# --- releases --------------------------------------------------------------


@pytest.fixture(scope="module")
def uploads(spark):
    draw = random.Random(1)
    rows = []
    for i in range(900):
        # One package has a third of all uploads.
        name = "hot" if i % 3 == 0 else f"p{draw.randrange(60)}"
        moment = datetime(2024, 1, 1) + timedelta(hours=draw.randrange(24 * 90))
        when = None if i % 50 == 7 else moment
        version = None if i % 70 == 5 else f"{draw.randrange(3)}.{draw.randrange(3)}"
        rows.append((name, version, when, i % 4 == 0, i))
    schema = "name string, version string, upload_time timestamp, has_signature boolean, id int"
    return rows, spark.createDataFrame(rows, schema)


def test_median_gap(uploads):
    rows, frame = uploads
    times = defaultdict(list)
    for name, _, when, _, _ in rows:
        if when:
            times[name].append(when)
    expected = {}
    for name, moments in times.items():
        moments.sort()
        gaps = sorted((b.date() - a.date()).days for a, b in zip(moments, moments[1:]))
        if gaps:
            expected[name] = gaps[(len(gaps) - 1) // 2]
    got = {r["name"]: r["t_median_release_gap_days"] for r in median_gap(frame).collect()}
    assert got == expected


def test_release_profile(uploads):
    rows, frame = uploads
    got = {
        r["name"]: r
        for r in release_profile(version_files(frame))
        .withColumn("text", versions_text("version_files"))
        .withColumn("first_files", files_of("version_files", F.lit("0.0")))
        .collect()
    }
    for name in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == name]
        versions = [r[1] for r in own if r[1] is not None]
        assert got[name]["version_count"] == len(set(versions))
        assert got[name]["signed_version_count"] == len({r[1] for r in own if r[3] and r[1]})
        assert got[name]["n_versions"] == len({r[1] for r in own if r[2] and r[1]})
        assert got[name]["text"] == ",".join(sorted(versions))
        assert got[name]["first_files"] == (versions.count("0.0") or None)
        assert got[name]["last_upload"] == max((r[2] for r in own if r[2]), default=None)


def test_latest_and_its_files(uploads):
    rows, frame = uploads
    order = ("upload_time", "id")
    latest = {}
    for row in rows:
        rank = (row[2] is not None, row[2] or datetime.min, row[4])
        if row[0] not in latest or rank > latest[row[0]][0]:
            latest[row[0]] = (rank, row)
    got = {r["name"]: r["id"] for r in latest_release(frame, ["id"], order).collect()}
    assert got == {n: row[4] for n, (_, row) in latest.items()}
    files = {
        r["pkg_name"]: (r["latest_version"], r["n_distributions"])
        for r in distributions_of_latest(frame, order).collect()
    }
    expected = {
        n: (row[1], sum(r[0] == n and r[1] == row[1] for r in rows))
        for n, (_, row) in latest.items()
        if row[1] is not None
    }
    assert files == expected


def test_latest_keeps_nulls(spark):
    frame = spark.createDataFrame(
        [("a", "1", datetime(2024, 1, 1), "old"), ("a", "2", datetime(2024, 1, 2), None)],
        "name string, version string, upload_time timestamp, summary string",
    )
    assert latest_release(frame, ["summary"]).first()["summary"] is None


# --- popularity ------------------------------------------------------------


def test_download_windows(spark):
    as_of = datetime(2024, 1, 31, 12)
    times = [
        datetime(2024, 1, 1), datetime(2023, 12, 31, 23, 59), datetime(2024, 1, 24, 12),
        datetime(2024, 1, 24, 11, 59), datetime(2024, 1, 31),
    ]
    frame = spark.createDataFrame([(t, ("a",)) for t in times], "timestamp timestamp, file struct<project:string>")
    row = download_counts(frame, as_of).first()
    assert (row["n_downloads_7d"], row["n_downloads_30d"]) == (2, 4)


def test_dependents(spark):
    rows = [("a", ["x>=1", "x[e]", "y"]), ("a", ["x"]), ("b", ["x ; m", "(z)"]), ("c", None), ("x", ["x"])]
    frame = spark.createDataFrame(rows, "name string, requires_dist array<string>")
    got = {r["pkg_name"]: r["n_dependents_est"] for r in dependent_counts(frame).collect()}
    assert got == {"x": 3, "y": 1}


def test_scope_gives_the_same_either_way(spark, monkeypatch):
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "name string, v int")
    names = spark.createDataFrame([("a",), ("c",), ("d",)], "name string")

    def restricted():
        scope = scoping.Scope(names)
        sums = scope.early(frame).groupBy("name").agg(F.sum("v").alias("v"))
        return scope.is_short, sorted(map(tuple, scope.late(sums).collect()))

    short = restricted()
    monkeypatch.setattr(scoping, "fits_broadcast", lambda names: False)
    long = restricted()
    assert (short[0], long[0]) == (True, False)
    assert short[1] == long[1] == [("a", 3), ("c", 4)]


def test_size_check(spark):
    names = spark.createDataFrame([("aa",), ("bb",)], "name string")
    assert scoping.fits_broadcast(names)
    assert not scoping.fits_broadcast(names, rows=1)
    assert not scoping.fits_broadcast(names, size=3)


# --- skew ------------------------------------------------------------------


@pytest.mark.parametrize("hot_keys", [2, 10, 1000])
def test_lookup_join(spark, hot_keys):
    draw = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else f"k{draw.randrange(40)}") for i in range(600)]
    rows.append((600, "missing"))
    counts = Counter(k for _, k in rows if k != "missing")
    lookup = spark.createDataFrame([(k, n, n * 2.0) for k, n in counts.items()], "k string, n long, v double")
    frame = spark.createDataFrame(rows, "id long, k string")
    got = lookup_join(frame, lookup, "k", "n", spread="id", hot_keys=hot_keys)
    expected = {i: (k, counts[k] * 2.0 if k in counts else None) for i, k in rows}
    assert got.columns == ["id", "k", "v"]
    assert {r["id"]: (r["k"], r["v"]) for r in got.collect()} == expected
    assert got.count() == len(rows)


@pytest.mark.parametrize("range_rows", [5, 100_000])
def test_running_totals(spark, range_rows):
    draw = random.Random(3)
    points = [(i / 97, draw.randrange(5), draw.randrange(3)) for i in range(250)]
    frame = spark.createDataFrame(points, "x double, a long, b long")
    got = running_totals(frame, "x", {"a": "sum_a", "b": "sum_b"}, range_rows).collect()
    assert len(got) == len(points)
    for row in got:
        assert row["sum_a"] == sum(a for x, a, _ in points if x >= row["x"])
        assert row["sum_b"] == sum(b for x, _, b in points if x >= row["x"])


@pytest.mark.parametrize("range_rows", [20, 1000])
def test_numbered_rows(spark, range_rows):
    draw = random.Random(4)
    rows = [(draw.randrange(9), None if i % 40 == 3 else i) for i in range(300)]
    frame = spark.createDataFrame(rows, "score int, id int")
    order = [F.desc("score"), F.asc_nulls_last("id")]
    got = numbered(frame, order, "place", range_rows).collect()
    assert sorted(r["place"] for r in got) == list(range(1, 301))
    expected = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    assert [(r["score"], r["id"]) for r in sorted(got, key=lambda r: r["place"])] == expected


def test_scans_broadcast_nothing(spark):
    frame = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit(1).cast("long").alias("n"))
    plan = running_totals(frame, "x", {"n": "sum_n"}, 50)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    assert numbered(frame.limit(0), [F.asc("x")], "place").collect() == []


# --- owners ----------------------------------------------------------------


OWNER_SCHEMA = (
    "pkg_name string, distinct_authors array<string>, distinct_maintainers array<string>, "
    "t_age_last_release_days int, n_downloads_30d double, latest_project_urls array<string>"
)


def owners_of(spark, rows):
    frame = spark.createDataFrame(rows, OWNER_SCHEMA)
    return {
        r["pkg_name"]: (r["n_pkgs_by_maintainers_30d"], r["n_low_download_pkgs_by_maintainers"],
                        r["n_latest_project_urls"])
        for r in with_owner_activity(frame).collect()
    }


def test_owner_boundaries(spark):
    got = owners_of(
        spark,
        [
            ("on", ["a@x"], [], 30, 49.0, ["u", "v"]),
            ("off", ["b@x"], [], 31, 50.0, []),
            ("unknown", ["c@x"], None, 100, None, None),
            ("nobody", [], [], 1, 1.0, []),
            ("blank", [""], [], 1, 1.0, []),
        ],
    )
    assert got == {
        "on": (1.0, 1.0, 2), "off": (0.0, 0.0, 0), "unknown": (0.0, 1.0, 0),
        "nobody": (0.0, 0.0, 0), "blank": (0.0, 0.0, 0),
    }


def test_owner_network(spark):
    draw = random.Random(4)
    rows = []
    for i in range(200):
        people = {"everyone@x"} if i % 3 == 0 else set()
        people |= {f"u{draw.randrange(20)}@x" for _ in range(draw.randrange(4))}
        people = sorted(people)
        rows.append((f"p{i}", people[:2], people[1:], draw.randrange(60), float(draw.randrange(100)), None))
    recent, low = Counter(), Counter()
    for _, a, m, age, downloads, _ in rows:
        for person in set(a + m):
            recent[person] += age <= 30
            low[person] += downloads < 50
    expected = {
        p: (float(sum(recent[x] for x in set(a + m))), float(sum(low[x] for x in set(a + m))), 0)
        for p, a, m, *_ in rows
    }
    assert owners_of(spark, rows) == expected


# --- labels ----------------------------------------------------------------


def test_labels(spark):
    labels = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0), (None, 1)], "package_name string, is_spam int")
    assert sorted(map(tuple, label_per_package(labels).collect())) == [("a", 0.5), ("b", 0.0)]
    sample = name_sample(labels, labels.limit(1))
    assert sample.count() == 5
    frame = spark.createDataFrame([("a",), ("c",)], "name string")
    assert [r["name"] for r in not_listed(frame, "name", labels, "package_name").collect()] == ["c"]
    assert with_legit_mask(frame).filter("is_legit").count() == 2
    assert with_legit_mask(labels).filter("is_legit").count() == 2


# --- similarity ------------------------------------------------------------


def brute_similarity(texts, legit, terms_of, vocabulary=None):
    counts = [Counter(t for t in terms_of(x) if vocabulary is None or t in vocabulary) for x in texts]
    n = len(texts)
    df = Counter(t for c in counts for t in c)
    vectors = []
    for c in counts:
        v = {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items()}
        length = math.sqrt(sum(w * w for w in v.values()))
        vectors.append({t: w / length for t, w in v.items()})
    chosen = [v for v, ok in zip(vectors, legit) if ok] or vectors
    center = Counter()
    for v in chosen:
        center.update(v)
    length = math.sqrt(sum(w * w for w in center.values()))
    return [sum(w * center[t] for t, w in v.items()) / length for v in vectors]


def grams(name):
    name = name.lower()
    return [name[i : i + n] for n in (2, 3, 4, 5) for i in range(len(name) - n + 1)]


@pytest.mark.parametrize("all_spam", [False, True])
def test_name_similarity(spark, all_spam):
    names = ["requests", "numpy", "Numpy", "requests-mock", "py", "x", "pythön", "requests"]
    legit = [not all_spam and i % 2 == 0 for i in range(len(names))]
    frame = spark.createDataFrame(list(zip(names, legit)), "pkg_name string, is_legit boolean")
    model = cut_lineage(fit_names(frame))
    got = {r[0]: r[1] for r in name_similarity(frame, model).collect()}
    expected = brute_similarity(names, legit, grams)
    for name, value in zip(names, expected):
        assert got.get(name, 0.0) == pytest.approx(value, abs=1e-9)


def words(text, stop):
    import re

    kept = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in stop]
    return kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])]


@pytest.mark.parametrize("size", [5, 5000])
def test_description_distance(spark, size):
    draw = random.Random(5)
    stop = ["the", "and"]
    lexicon = ["data", "the", "library", "python", "and", "tool", "café", "fast", "web", "a"]
    texts = [" ".join(draw.choices(lexicon, k=draw.randrange(12))) for _ in range(40)] + [None, "the"]
    legit = [i % 3 == 0 for i in range(len(texts))]
    rows = [(f"p{i}", t, ok) for i, (t, ok) in enumerate(zip(texts, legit))]
    frame = spark.createDataFrame(rows, "pkg_name string, latest_description string, is_legit boolean")
    model, corpus = fit_descriptions(frame, size=size, stop_words=stop)
    model = cut_lineage(model)
    totals = Counter(t for x in texts for t in words(x, stop))
    kept = set(sorted(totals, key=lambda t: (-totals[t], t))[:size])
    expected = brute_similarity(texts, legit, lambda x: words(x, stop), kept)
    own = {r[0]: r[1] for r in corpus_distance(corpus, model).collect()}
    again = {r[0]: r[1] for r in description_distance(frame, model, stop_words=stop).collect()}
    assert model.count() == len(kept)
    for (name, _, _), value in zip(rows, expected):
        assert own.get(name, 1.0) == pytest.approx(1 - value, abs=1e-9)
        assert again.get(name, 1.0) == pytest.approx(1 - value, abs=1e-9)


def test_distance_to_itself(spark):
    rows = [("good", "a python http library", True), ("bad", "malware", False)]
    frame = spark.createDataFrame(rows, "pkg_name string, latest_description string, is_legit boolean")
    model, corpus = fit_descriptions(frame)
    got = {r[0]: r[1] for r in corpus_distance(corpus, model).collect()}
    assert got["good"] == pytest.approx(0.0, abs=1e-12)
    assert got["bad"] == pytest.approx(1.0)


def test_empty_corpus(spark):
    frame = spark.createDataFrame([], "pkg_name string, latest_description string, is_legit boolean")
    assert name_similarity(frame, cut_lineage(fit_names(frame))).count() == 0
    model, corpus = fit_descriptions(frame)
    assert corpus_distance(corpus, model).count() == 0


def test_newest_is_chosen_before_texts_are_met(spark):
    """Rows of a joined table are told apart below the join that brings in their texts."""
    uploads = spark.createDataFrame(
        [("a", 1, "x", 7), ("a", 2, "y", 7), ("a", 2, "z", 8), ("b", None, "v", None), (None, 3, "w", 9)],
        "name string, upload_time int, version string, id int",
    )
    texts = spark.createDataFrame([(7, "seven"), (8, "eight"), (9, "nine")], "text_id int, description string")
    dist = uploads.join(texts, F.col("id") == F.col("text_id"), "left")
    rows = latest_release(dist, ["version", "description"])
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(
        map(repr, [("a", "z", "eight"), ("b", "v", None), (None, "w", "nine")])
    )
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftOuter") < plan.index("LeftSemi")
    scope = scoping.Scope(spark.createDataFrame([("a",)], "name string"))
    listed = scope.early(dist)
    assert {r["description"] for r in listed.collect()} == {"seven", "eight"}
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftOuter") < plan.index("LeftSemi")


def test_parts_of_a_spread_table_are_bounded_by_their_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "one file")
    spark.range(20_000).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    assert skew.use_all_cores(rows).rdd.getNumPartitions() == cores
    size = skew.stored_bytes(spark, rows.inputFiles())
    monkeypatch.setattr(skew, "PART_BYTES", size // 50)
    spread = skew.use_all_cores(rows)
    assert spread.rdd.getNumPartitions() >= 50 > cores
    assert spread.agg(F.sum("id"), F.count("id")).first() == (20_000 * 19_999 // 2, 20_000)


@pytest.mark.parametrize("most", [200_000, 3])
@pytest.mark.parametrize("size", [1, 4, 9, 30, 1000])
def test_vocabulary_counts_pairs_of_frequent_words(spark, monkeypatch, size, most):
    rng = random.Random(size)
    listed = [" ".join(rng.choices("aa bb cc dd ee ff gg hh".split(), range(1, 9), k=rng.randint(0, 12))) for _ in range(40)]
    listed += [None, "", "rare", "zz zz zz", "cc dd"]
    counts = Counter()
    for said in listed:
        words = (said or "").split()
        counts.update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    expected = sorted(counts, key=lambda t: (-counts[t], t))[:size]
    texts = spark.createDataFrame([(x,) for x in listed], "said string")
    words = similarity.description_words("said", ["no"])
    seen = []
    pairs = similarity.candidate_pairs
    monkeypatch.setattr(similarity, "candidate_pairs", lambda t, w, f: seen.append(pairs(t, w, f, most)) or seen[-1])
    assert [r.term for r in similarity.vocabulary(texts, words, size).collect()] == expected
    every = sum(n for t, n in counts.items() if " " in t)
    assert seen[0].count() < every if size < 8 and most > 3 else seen[0].count() <= every
