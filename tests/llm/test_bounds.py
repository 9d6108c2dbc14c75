"""Very long texts, repeated ids, clashing names and missing keys."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftward.llm import decontamination, line_crf, mixing, preferences, quality, simhash, toxicity
from siftward.llm.common import within

FOLDER = "/root/testdata/sf0.001"


def sequences(rng, n, size):
    masks = [rng.integers(1, 1 << len(line_crf.FEATURES), size) | 1 for _ in range(n)]
    return masks, [(m >> 1 & 1) for m in masks]


@pytest.mark.parametrize("lines", [800, 5000, 200_000])
def test_a_very_long_labelled_text_leaves_weights_finite(lines):
    rng = np.random.default_rng(1)
    masks, wanted = sequences(rng, 200, 30)
    long, truth = sequences(rng, 1, lines)
    started = time.time()
    field = line_crf.LineField.fit(masks + long, wanted + truth)
    assert np.isfinite(field.weights).all() and np.isfinite(field.step).all() and time.time() - started < 120
    unseen, right = sequences(rng, 20, 40)
    said = [field.decode(m.tolist()) for m in unseen]
    assert np.mean([s == r.tolist() for s, r in zip(said, right)]) > 0.9


def test_parts_of_a_sequence_share_a_line(monkeypatch):
    rng = np.random.default_rng(2)
    masks, wanted = sequences(rng, 3, 41)
    monkeypatch.setattr(line_crf, "PART_LINES", 11)
    cut = []
    evened = line_crf.evened
    monkeypatch.setattr(line_crf, "evened", lambda kept: cut.extend(kept) or evened(kept))
    line_crf.LineField.fit(masks, wanted, rounds=1)
    assert sum(len(s) - 1 for s, _ in cut) == 3 * 40 and max(len(s) for s, _ in cut) == 11


def test_batches_by_cells():
    kept = [(np.zeros(n, int), np.zeros(n, int)) for n in sorted([1, 2, 3, 50, 400, 900, 2000])]
    parts = list(line_crf.evened(kept, 1000))
    assert sum(map(len, parts)) == len(kept) and all(len(p) == 1 or len(p) * len(p[-1][0]) <= 1000 for p in parts)


@pytest.fixture(scope="module")
def many_rows_of_an_id(spark):
    texts = ["one good line here\nand more", "bad | bad | bad\n# $ %"]
    rows = [(k, texts[k % 2]) for k in range(40)] + [(7, f"row {k} of one id") for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)] + [(7, 1, 1)] * 50, "doc_id long, quality int, toxic int")
    return docs, labels


def test_samples_are_bounded_by_rows(spark, many_rows_of_an_id):
    docs, labels = many_rows_of_an_id
    rows = quality.sampled(docs, labels, 30).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 40
    seen = []
    fit = toxicity.fit
    toxicity.fit = lambda rows, weight: seen.append(len(rows)) or fit(rows, weight)
    try:
        toxicity.train(docs, labels, documents=4)
        toxicity.train(docs, labels, documents=30, most_features=60)
    finally:
        toxicity.fit = fit
    assert seen[0] == 8 and 0 < seen[1] < 30


def test_lines_of_a_sample_are_bounded(spark):
    rows = spark.createDataFrame([(k, 10 if k != 3 else 1000) for k in range(20)], "id int, size int")
    got = within(rows, "size", 55, F.col("id")).collect()
    assert [r.id for r in got] == [0, 1, 2, 4, 5]


CLASHES = ["row_a", "row_b", "row_a_", "hits", "hits_0", "HITS", "fp", "bare", "times", "time", "row", "a", "kept", "epoch"]


@pytest.mark.parametrize("stage", ["near_duplicates", "source_mixture", "benchmark_decontamination", "toxicity"])
def test_users_columns_keep_their_values(spark, stage):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    # Repeated rows take the ways of their own.
    docs = docs.unionByName(docs.limit(5))
    docs = docs.select("*", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in CLASHES if c != "HITS"])
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, FOLDER)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) > 20 and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in CLASHES if c != "HITS")


def test_near_copies_without_id_go(spark):
    text = "some words that are long enough to make a few shingles of four"
    rows = [(None, text, k) for k in range(4)] + [(5, text, 9), (3, text, 8), (3, text, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    assert [r.doc_id for r in simhash.one_of_each_group(docs).collect()] == [3]
    assert simhash.one_of_each_group(docs.where("doc_id is null")).count() == 1


def test_blocks_of_a_benchmark_beside_a_column_of_that_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "mine"), (2, None, "mine")], "doc_id long, text string, found_0 string")
    items = spark.createDataFrame([("x", "b c"), ("y", "d e"), ("z", "q")], "item_id string, text string")
    got = decontamination.with_hits(docs, items, "found", block_bytes=4).orderBy("doc_id").collect()
    assert [r.found_0 for r in got] == ["mine", "mine"] and got[0].found.n_hit == 4 and got[0]["found"]["items"] == ["x", "y"]


def test_preferences_without_key_follow_the_statement(spark, tmp_path):
    rows = [(c, t, r, f"{r} {c} {t}") for c in range(30) for t, r in enumerate(["user", "assistant", "user", "assistant"][: 2 + c % 3])]
    rows += [(None, 0, "assistant", f"alone {k}") for k in range(40)] + [(None, 1, "user", "no answer"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    whole = preferences.gathered(frame)
    got = preferences.formatted(preferences.paired(frame).unionByName(preferences.unanswered(whole)))
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    result = db.execute(preferences.ORACLE)
    columns = [d[0] for d in result.description]
    expected = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == expected and len(expected) == 72


def test_mixture_takes_rows_without_id(spark):
    rows = [(None, f"text {k} of some words", "s", k) for k in range(50)] + [(None, "same text", "s", 0)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, times int")
    out = mixing.mixed_documents(docs, mixing.Mix(repeats=2.0)).collect()
    assert len(out) == 70 and len({r.text for r in out}) == 51


def test_rows_without_id_are_dealt_to_blocks_as_the_statement_says(spark, tmp_path):
    rows = [(None if k % 3 == 0 else k, " ".join(["w"] * (k % 400)) + f" {k}", f"s{k % 2}") for k in range(900)]
    rows += [(None, "same text", "s0")] * 5 + [(None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(frame, mixing.MIX)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    result = db.execute(mixing.ORACLE)
    columns = [d[0] for d in result.description]
    expected = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == expected
    # Not all in one block.
    assert got.where("doc_id is null and source = 's0'").select("slot").distinct().count() > 1
