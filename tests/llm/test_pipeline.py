"""The corpus pipeline, stage by stage, against brute force."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_decontamination import by_plain_search
from test_duplicates import fingerprint, groups
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from siftward.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_registered(spark):
    names = set(contract.queries())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES} and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "benchmark_decontamination", "source_mixture", "token_ids",
    ]


def test_stages_on_whole_table(spark, documents):
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    mild = stages["toxicity"](spark, documents, FOLDER)
    scores = toxicity.scored(documents, toxicity.train(documents, labels)).collect()
    assert mild.columns == COLUMNS and ids(mild) == sorted(r.doc_id for r in scores if not r.predicted)

    unlike = stages["near_duplicates"](spark, documents, FOLDER)
    prints = {r.doc_id: fingerprint(r.text) for r in documents.collect()}
    roots = groups(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for i, p in sorted(prints.items()):
        first.setdefault(roots[p], i)
    assert unlike.columns == COLUMNS and ids(unlike) == sorted(first.values()) and len(first) < len(prints)

    clean = stages["benchmark_decontamination"](spark, documents, FOLDER)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hits = by_plain_search([(r.doc_id, r.text) for r in documents.collect()], items)
    assert clean.columns == COLUMNS and ids(clean) == sorted(h[0] for h in hits if not h[-1])
    assert any(h[-1] for h in hits)

    mixture = stages["source_mixture"](spark, documents, FOLDER)
    assert mixture.columns == COLUMNS and len(set(ids(mixture))) == mixture.count() <= documents.count()

    encoder = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    start, expected = 0, []
    for row in documents.orderBy("doc_id").collect():
        tokens = [*encoder.encode(row.text, add_special_tokens=False).ids, 2]
        expected.append((row.doc_id, start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    assert sorted(tuple(r) for r in stages["token_ids"](spark, documents, FOLDER).collect()) == expected


def test_run_chains_the_stages(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    ordered = rows.orderBy("start").collect()
    assert 100 < len(ordered) < 200 and [r.doc_id for r in ordered] == sorted(r.doc_id for r in ordered)
    assert ordered[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_no_documents(spark, messy, no_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, no_docs, FOLDER).count() == 0
    out = stage(spark, messy, FOLDER)
    assert out.count() > 20 and (name == "token_ids" or out.columns == messy.columns)


def test_hot_source_is_levelled(spark):
    rows = [(i, " ".join(["w"] * 30), None, "hot" if i % 10 < 7 else f"s{i % 3}", 1) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["source_mixture"](spark, docs, FOLDER).groupBy("source").count().collect()
    count = {r.source: r["count"] for r in kept}
    share = np.array(list(count.values())) / sum(count.values())
    assert -(share * np.log(share)).sum() / np.log(4) > 0.88 and count["hot"] < 840
    assert all(count[f"s{k}"] > 100 for k in range(3))


def test_scarce_source_does_not_cut_the_others(spark):
    source = lambda i: "hot" if i % 3 == 0 else f"s{i % 19}"
    rows = [(i, " ".join(["w"] * 30), None, source(i), 1) for i in range(12_000)]
    rows += [(12_000 + k, "w w", None, None, 1) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["source_mixture"](spark, docs, FOLDER).collect()
    assert 12_000 <= len(kept) <= 12_200 and len({r.doc_id for r in kept}) > 0.9 * len(rows)
    assert {r.doc_id for r in kept if r.source is None} == {12_000, 12_001, 12_002}
    assert max(Counter(r.doc_id for r in kept).values()) == 2


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    from check_oracle import compare

    df = contract.queries()[name](spark, FOLDER)
    problems, _, rows = compare(spark, FOLDER, name, df)
    assert problems == [] and rows > 0
