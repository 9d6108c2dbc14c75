"""State by batches against all uploads at once."""

import random
from datetime import datetime, timedelta

import pytest

from siftward.operators.metadata import package_profile
from siftward.operators.popularity import dependent_counts, counted_dependents
from siftward.operators.releases import median_gap, median_gap_of_days, version_files
from siftward import session
from siftward.operators import releases
from siftward.plans import state
from siftward.sources import commits, schemas


@pytest.fixture(scope="module")
def uploads(spark):
    draw = random.Random(5)
    fields = schemas.DISTRIBUTION_METADATA.fieldNames()
    rows = []
    for k in range(240):
        row = dict.fromkeys(fields)
        row["name"] = "hot" if k % 3 == 0 else draw.choice(["a", "b", "c", None, f"p{k}"])
        row["version"] = draw.choice(["1", "2", "10", None])
        row["upload_time"] = None if k % 11 == 0 else datetime(2024, 1, 1) + timedelta(hours=draw.randrange(2000))
        row["author_email"] = draw.choice([None, "x@y.z", "u@v.w"])
        row["license"] = draw.choice([None, "MIT", "BSD"])
        row["classifiers"] = draw.choice([None, [], ["A :: B", "C :: D"], ["E :: F", None]])
        row["requires_dist"] = draw.choice([None, [], ["a >=1", "b"], ["c; extra == 'x'", "hot"]])
        row["has_signature"] = draw.choice([None, True, False])
        row["summary"] = f"summary {k}"
        rows.append(tuple(row[f] for f in fields))
    return spark.createDataFrame(rows, schemas.DISTRIBUTION_METADATA).cache(), rows


def said(frame):
    columns = sorted(frame.columns)
    return sorted((repr(tuple(r)) for r in frame.select(*columns).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_state_after_any_split_is_that_of_all(spark, uploads, tmp_path, seed):
    whole, rows = uploads
    draw = random.Random(seed)
    batches = [[], [], []]
    for row in rows:
        draw.choice(batches).append(row)
    path = str(tmp_path / "state")
    for batch in batches:
        state.update(spark.createDataFrame(batch, schemas.DISTRIBUTION_METADATA), path, buckets=3)
    stored = state.read_state(spark, path, state.state_of(whole))
    for part, expected in state.state_of(whole).items():
        assert said(stored[part]) == said(expected), part
    named = lambda frame: frame.where("name is not null")
    assert said(named(state.profile_of(stored))) == said(named(package_profile(whole)))
    assert said(stored["files"]) == said(version_files(whole))
    assert said(median_gap_of_days(stored["days"])) == said(median_gap(whole))
    assert said(counted_dependents(stored["required"])) == said(dependent_counts(whole))


def test_an_update_in_between_is_noticed(spark, uploads, tmp_path, monkeypatch):
    whole, rows = uploads
    path = str(tmp_path / "state")
    one = spark.createDataFrame(rows[:5], schemas.DISTRIBUTION_METADATA)
    two = spark.createDataFrame(rows[5:9], schemas.DISTRIBUTION_METADATA)
    commit, done = commits.commit, []

    def slow(*arguments):
        if not done:
            done.append(1)
            state.update(two, path, buckets=2)
        return commit(*arguments)

    monkeypatch.setattr(commits, "commit", slow)
    with pytest.raises(RuntimeError):
        state.update(one, path, buckets=2)
    like = state.state_of(whole)
    assert said(state.read_state(spark, path, like)["files"]) == said(version_files(two))
    state.update(one, path, buckets=2)
    assert said(state.read_state(spark, path, like)["files"]) == said(version_files(one.union(two)))


def test_batches_are_not_stored(spark, uploads, tmp_path, monkeypatch):
    """An update stores the merged state and no copy of the batch beside it."""
    stored = []
    for module in (session, releases):
        cut = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, cut=cut: stored.append(df.columns) or cut(df))
    monkeypatch.setattr(state, "cut_lineage", session.cut_lineage, raising=False)
    state.update(uploads[0], str(tmp_path / "state"), buckets=2)
    assert not any({"latest", "description"} & set(columns) for columns in stored)
