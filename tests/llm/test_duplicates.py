"""SimHash groups, components and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from siftward.llm import repeats, simhash, substring_dedup
from siftward.llm.components import components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_groups(messy, messy_rows):
    prints = [(r[0], fingerprint(r[1])) for r in messy_rows]
    roots = groups({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(least.get(roots[p], i), i)
    expected = sorted(((i, signed(p), least.get(roots[p])) for i, p in prints), key=repr)
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.grouped(messy).collect()]
    assert sorted(got, key=repr) == expected


@pytest.mark.parametrize("paired", [2, 4, 1000])
def test_links_of_crowded_and_sparse_lists(spark, paired):
    rng = random.Random(paired)
    centre = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(40)} | {centre}
    for _ in range(60):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 7)))
        prints.add(centre ^ flips)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    links = simhash.links(frame, paired=paired)
    assert all((r.a ^ r.b) & (2**64 - 1) != 0 and ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in links.collect())
    found = {r.node: r.root for r in components(links).collect()}
    expected = groups({signed(p) for p in prints}, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert {n: found.get(n, n) for n in expected} == expected


def test_one_of_each_group(messy, messy_rows, no_docs):
    kept = simhash.one_of_each_group(messy)
    assert kept.columns == messy.columns
    prints = [(r[0], fingerprint(r[1])) for r in messy_rows]
    roots = groups({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(least.get(roots[p], i), i)
    expected = sorted({least.get(roots[p]) for _, p in prints}, key=repr)
    # Here every group has a document with an id.
    assert None not in expected
    assert sorted(map(repr, (r.doc_id for r in kept.select("doc_id").collect()))) == sorted(map(repr, expected))
    assert simhash.one_of_each_group(no_docs).count() == 0


def test_one_row_of_each_group(spark):
    rng = random.Random(21)
    one, two, three = (" ".join(str(rng.random()) for _ in range(50)) for _ in range(3))
    # Copies without id; equal rows of the smallest id; an id on several texts, of which one is the only row of its group.
    rows = [(None, one)] * 40 + [(4, two)] * 3 + [(7, two), (7, three)]
    kept = simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(None, one), (4, two), (7, three)], key=repr)


def test_components(spark):
    rng = random.Random(2)
    chain = [(k, k + 1) for k in range(40)]
    star = [(1000, 1000 + k) for k in range(1, 60)]
    loose = [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(70)]
    links = chain + star + loose + [(5, 5), (7, 6)]
    nodes = {x for pair in links for x in pair if pair[0] != pair[1]}
    pairs = set(links)
    expected = groups(nodes, lambda a, b: (a, b) in pairs or (b, a) in pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_pair_of_a_group_of_copies(spark):
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same few words in each of them").alias("text"))
    rows = simhash.grouped(copies)
    assert rows.agg(F.max("component_id"), F.count(F.lit(1))).first() == (0, 3000)


def deduped(rows):
    first = {}
    rank = lambda i: (1, 0) if i is None else (0, i)
    for i, text, *_ in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - 12):
            w = tuple(words[k : k + 13])
            first[w] = min(first.get(w, rank(i)), rank(i))
    out = []
    for i, text, *_ in rows:
        words, gone = (text or "").encode().split(), set()
        for k in range(len(words) - 12):
            if first[tuple(words[k : k + 13])] < rank(i):
                gone.update(range(k, k + 13))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 23, 4000])
def test_substrings(monkeypatch, messy, messy_rows, block_bytes):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 150 if block_bytes == 4000 else 200_000)
    rows = substring_dedup.without_repeats(messy, block_bytes=block_bytes).drop("kept").collect()
    assert sorted((tuple(r) for r in rows), key=repr) == deduped(messy_rows)


def test_substrings_of_random_passages(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(12)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(12, 40))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages)[rng.randint(0, 5) :] if rng.random() < 0.6 else rng.choices(vocabulary, k=9)
        rows.append((rng.randint(0, 50), " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.without_repeats(frame, block_bytes=600).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == deduped(rows)


def test_words_of_a_piece_are_held_at_a_time(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["one", "two", "three", "four"], k=60)).encode() for _ in range(200)]
    blocks = pa.array([k % 3 for k in range(200)], pa.int32())
    rows = pa.table({"block": blocks, "doc_id": pa.array(range(200), pa.int64()), "text": pa.array(texts, pa.binary())})
    batch = pa.RecordBatch.from_pydict({"block": blocks, "text": pa.array(texts, pa.binary())})

    def results():
        packed = [b.to_pylist() for b in substring_dedup.block_anchors(5, 13)([batch])]
        keys = pa.table({"block": pa.array([0] * 5, pa.int32()), "keys": pa.array([r["keys"] for r in packed[0]], pa.binary())})
        return packed, substring_dedup.split_block(13)(rows, keys.slice(0, 3)).to_pylist()

    whole, sizes = results(), []
    monkeypatch.setattr(substring_dedup, "PIECE_BYTES", 2000)
    monkeypatch.setattr(repeats, "STRETCH", 7)
    monkeypatch.setattr(substring_dedup, "Words", lambda texts, window: sizes.append(sum(map(len, texts))) or repeats.Words(texts, window))
    assert results() == whole
    # A text that begins in a piece may end beyond it.
    assert max(sizes) < 2000 + max(map(len, texts)) and sum(sizes) == 2 * sum(map(len, texts))


def test_ids_in_few_bytes():
    for ids, width in (([0, 127, -128], 1), ([128], 2), ([3, 300_000], 3), ([-(1 << 63), 5], 8), ([substring_dedup.LAST], 8)):
        data = substring_dedup.narrow(np.array(ids))
        assert len(data) == width * len(ids) and substring_dedup.widened(data, len(ids)).tolist() == ids


def test_unfinished_documents_are_kept_small():
    """They are stored and shuffled again, which was most of the disk."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(3000)]
    pending = [{"doc_id": k, "text": " ".join(rng.choices(words, k=300)).encode(), "windows": [0, 280]} for k in range(300)]
    pending += [{"doc_id": None, "text": b"", "windows": []}]
    data = substring_dedup.zipped(pending)
    assert substring_dedup.unzipped(data) == pending and len(data) < 0.5 * sum(len(p["text"]) for p in pending)
    assert substring_dedup.zipped([]) is None
    batch = pa.RecordBatch.from_pydict({"block": pa.array([k % 9 for k in range(300)], pa.int32()), "text": [p["text"] for p in pending[:300]]})
    (anchors,) = substring_dedup.block_anchors(9, 13)([batch])
    keys, blocks = (sum(map(len, anchors.column(c).to_pylist())) for c in ("keys", "blocks"))
    assert keys == 4 * blocks > 0


def test_no_substrings(no_docs):
    assert substring_dedup.without_repeats(no_docs).count() == 0


def test_equal_windows_have_equal_keys():
    rng = random.Random(4)
    words = [rng.choice(["aa", "b", "ccc", "dddd"]).encode() for _ in range(3000)]
    keys = repeats.window_keys(words, repeats.word_hashes(words))
    seen = {}
    for k, key in enumerate(keys.tolist()):
        assert seen.setdefault(tuple(words[k : k + 13]), key) == key
    assert len(keys) == 3000 - 12
