"""FM-index and benchmark hits against plain search."""

import hashlib
import random
import re

import numpy as np
import pytest

from siftward.llm import decontamination as d
from siftward.llm.fm_index import FMIndex

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_every_occurrence(seed):
    rng = random.Random(seed)
    alphabet = rng.choice([2, 3, 6, 40])
    text = []
    for _ in range(rng.randint(1, 12)):
        part = [rng.randrange(1, alphabet) for _ in range(rng.randint(1, 60))]
        text += part * rng.choice([1, 1, 3]) + [0]
    index = FMIndex(np.array(text), alphabet)
    for size in (1, 2, 5):
        patterns = {tuple(text[k : k + size]) for k in range(len(text) - size)}
        patterns |= {tuple(rng.randrange(1, alphabet) for _ in range(size)) for _ in range(20)}
        patterns = sorted(p for p in patterns if 0 not in p)
        low, high = index.search(np.array(patterns))
        for pattern, a, b in zip(patterns, low, high):
            expected = [k for k in range(len(text)) if tuple(text[k : k + size]) == pattern]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def by_plain_search(docs, items):
    windows = {}
    for item, text in items:
        words = WORDS.findall((text or "").encode().lower())
        size = min(13, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        words, hit, found = WORDS.findall((text or "").encode().lower()), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                owners = windows.get(tuple(words[k : k + size]))
                if owners:
                    hit.update(range(k, k + size))
                    found |= owners
        out.append((i, len(words), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


@pytest.fixture(scope="module")
def items(messy_rows):
    shared = messy_rows[0][1].split()
    long = messy_rows[11][1].split()
    return [
        (1, " ".join(shared[5:40])), (1, " ".join(shared[30:50])), (20, " ".join(shared[5:18])), (3, "Été, ÇA va"), (4, None), (5, " ,.; "),
        (None, "one"), (7, "A-B"), (8, " ".join(long[100:130])), (9, "never seen anywhere in these texts at all"), (2, " ".join(shared[5:40])),
    ]


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_hits(spark, messy, messy_rows, items, block_bytes):
    bench = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, found string")
    found = d.with_hits(messy, bench, "hits", block_bytes=block_bytes)
    got = [
        (r.doc_id, r.hits.n_words, r.hits.n_hit, list(r.hits["items"]), r.hits.n_hit > 0 and 20 * r.hits.n_hit >= r.hits.n_words)
        for r in found.collect()
    ]
    assert sorted(got, key=repr) == sorted(by_plain_search([r[:2] for r in messy_rows], items), key=repr)
    for row in found.collect():
        spans = [(s.first, s.stop) for s in row.hits.spans]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_clean_rows_keep_their_columns(spark, messy, messy_rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = d.decontaminated(messy, bench)
    assert kept.columns == messy.columns
    dirty = sum(x[-1] for x in by_plain_search([r[:2] for r in messy_rows], items))
    assert kept.count() == len(messy_rows) - dirty and dirty > 5


def test_empty_tables(spark, messy, no_docs, items):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = d.with_hits(messy, none, "hits").collect()
    assert len(rows) == messy.count() and all(r.hits.n_hit == 0 and r.hits.spans == [] for r in rows)
    assert d.with_hits(no_docs, spark.createDataFrame(items, "item_id long, text string"), "hits").count() == 0


def test_query_digest_of_no_items(spark):
    row = d.op6_decontamination(spark, "/root/testdata/sf0.001").where("n_hit = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest() and row.n_items == 0


def test_long_segments_overlap(monkeypatch):
    monkeypatch.setattr(d, "SHARD_WORDS", 50)
    rng = random.Random(1)
    words = [rng.choice("abc").encode() for _ in range(400)]
    phrases = d.Phrases([("1", b" ".join(words[40:60])), ("2", b" ".join(words[200:213]))], 13)
    row = d.find(iter([[b" ".join(words)]]), phrases)[0]
    (expected,) = by_plain_search([(0, b" ".join(words).decode())], [(1, b" ".join(words[40:60]).decode()), (2, b" ".join(words[200:213]).decode())])
    assert sum(s["stop"] - s["first"] for s in row["spans"]) == expected[2] and row["items"] == expected[3]
