"""Vectors, resampling and phrases against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from siftward.llm import phrases, resampling, vectors

# --- vectors -----------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, ball long, c long, key string, component_id int"


def unit(v):
    return np.asarray(v, np.float64) / np.linalg.norm(np.asarray(v, np.float64))


def near(rng, centre, cos):
    other = rng.standard_normal(len(centre))
    other -= other @ unit(centre) * unit(centre)
    return (cos * unit(centre) + math.sqrt(1 - cos * cos) * unit(other)).astype(np.float32).tolist()


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(16).astype(np.float32).tolist()) for k in range(100, 160)]
    centre, loose = rng.standard_normal(16), rng.standard_normal(16)
    rows += [(k, near(rng, centre, 0.995)) for k in range(200, 260)]
    # A loose group, some of whose pairs are linked and some not.
    rows += [(k, near(rng, loose, 0.95)) for k in range(300, 340)]
    same = rng.standard_normal(16).astype(np.float32).tolist()
    rows += [(k, same) for k in range(400, 430)] + [(400, same), (None, same), (None, same)]
    bare = rng.standard_normal(16).astype(np.float32).tolist()
    rows += [(None, bare), (None, [2 * x for x in bare]), (50, [float("nan")] * 16), (51, [0.0] * 16), (52, None), (53, [])]
    rows += [(54, [1.0, None] * 8), (55, [float("inf")] + [1.0] * 15), (56, [1.0, 2.0]), (57, [1.0, 2.0]), (58, [1e30, 2e30]), (None, None)]
    rows += [(59, [1e-30] * 16), (60, [1.0] * 16)]
    return rows


def expected_links(rows):
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    units = [unit(np.array(v) / max(map(abs, v))) if ok else None for (_, v), ok in zip(rows, good)]
    linked = {(a, b) for a in range(len(rows)) for b in range(len(rows))
              if a != b and good[a] and good[b] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    n = Counter(a for a, _ in linked)
    return [(i, n[k], least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows)]


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, None, 7, k, "x", 1) for k, (i, v) in enumerate(rows)], VECTORS).repartition(3)


@pytest.mark.parametrize("paired, block", [(32, 256), (2, 5)])
def test_vectors_that_all_meet(spark, vector_rows, monkeypatch, paired, block):
    monkeypatch.setattr(vectors, "PAIRED_BUCKET", paired)
    monkeypatch.setattr(vectors, "BLOCK", block)
    # One cell holds all, so nothing is left to chance: balls, pairs of balls and blocks must give every link.
    frame = vector_frame(spark, vector_rows)
    got = vectors.near_vectors(frame, plan=vectors.Tables(1e6, 1, 2)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected_links(vector_rows), key=repr)


def test_vectors_found_by_planned_tables(spark, vector_rows):
    got = vectors.near_vectors(vector_frame(spark, vector_rows)).collect()
    expected = expected_links(vector_rows)
    assert len(got) == len(expected)
    found, there = sum(r.n_links for r in got), sum(r[1] for r in expected)
    assert 0.9 * there <= found <= there
    tight = {i: (n, c, k) for i, n, c, k in expected if i is not None and not 300 <= i < 340 and i != 400}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id in tight} == tight


def test_no_vectors(spark):
    assert vectors.near_vectors(vector_frame(spark, [])).collect() == []
    assert [tuple(r) for r in vectors.near_vectors(vector_frame(spark, [(4, None)])).collect()] == [(4, 0, 4, True)]


def test_chance_of_collision():
    rng = np.random.default_rng(1)
    plan = vectors.Tables(2.0, 3, 4000)
    a = rng.standard_normal(16)
    pair = np.stack([unit(a), unit(near(rng, a, 0.9))])
    keys = vectors.keys_of(pair, plan)
    assert abs((keys[0] == keys[1]).mean() - vectors.collision(math.sqrt(0.2), 2.0) ** 3) < 0.03
    few, many = vectors.Tables.plan(1000), vectors.Tables.plan(10**6)
    for plan in (few, many):
        p = vectors.collision(math.sqrt(0.2), plan.width) ** plan.directions
        assert 1 - (1 - p) ** plan.tables >= vectors.RECALL
    assert many.directions > few.directions


# --- resampling ----------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def features_of(text):
    words = WORD.findall(lowered(text))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def resampled_rows(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in rows for f in features_of(t)[1])
    t = Counter(bucket(f) for x in target for f in features_of(x)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        n, found = features_of(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in map(bucket, found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, n, len(found), weight, score, None])
    enough = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: 25 * len(enough) // 100]):
        r[5] = k + 1
    return [tuple(r) for r in out]


TARGET = ["Shared words, th er on an re he", "in ed nd ha th", None, "", "Ever on été ퟿"]


@pytest.mark.parametrize("limit", [300, 1 << 20])
def test_resampled(spark, messy, messy_rows, limit):
    target = spark.createDataFrame([(None, t, 1) for t in TARGET], "item_id string, text string, weight int")
    rows = messy if limit > 300 else messy.where("length(text) < 5000 or text is null")
    held = [r[:2] for r in messy_rows if limit > 300 or len(r[1] or "") < 5000]
    got = [tuple(r) for r in resampling.resampled(rows, target, batch_bytes=limit).collect()]
    assert sorted(got, key=repr) == sorted(resampled_rows(held, TARGET), key=repr)


def test_resampled_nothing(spark, messy, no_docs):
    none = spark.createDataFrame([], "item_id string, text string")
    assert resampling.resampled(no_docs, none).collect() == []
    got = [tuple(r) for r in resampling.resampled(messy, none).collect()]
    assert len(got) == messy.count() and any(r[-1] for r in got)


def test_hashes_of_stretches():
    rng = random.Random(2)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(1, 80), 300]]
    buffer = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    got = resampling.hashes(buffer, starts, sizes).tolist()
    assert got == [xxhash.xxh64_intdigest(p) for p in parts]


@pytest.mark.parametrize("digest", [resampling.hashes, lambda b, starts, sizes: np.full(len(starts), 5, np.uint64)])
def test_interned_by_bytes(digest):
    """Also when all keys are equal: then only the bytes tell n-grams apart."""
    rng = random.Random(7)
    words = [rng.choice(["a", "bb", "abcdefgh", "abcdefgi", "abcdefghabcdefgh", "x" * 40, "x" * 39 + "y"]).encode() for _ in range(400)]
    batch = resampling.Batch([(0, b" ".join(words), 0)], 1, 2)
    kept = resampling.Interned(batch.buffer, batch.starts, batch.sizes, 10000, digest)
    grams = words + [a + b" " + b for a, b in zip(words, words[1:])]
    by_slot = defaultdict(set)
    for slot, gram in zip(kept.slots.tolist(), grams):
        by_slot[slot].add(gram)
    assert all(len(x) == 1 for x in by_slot.values()) and len(by_slot) == len(set(grams)) == len(kept.filled)
    times = Counter(grams)
    for slot, (gram,) in by_slot.items():
        assert kept.count[slot] == times[gram] and kept.bucket[slot] == zlib.crc32(gram) % 10000


def test_parts_of_a_text_lose_nothing():
    text = " ".join(["Lorem", "ip-sum"] * 200 + ["x" * 90] + ["dolor"] * 20).encode()
    whole = resampling.Batch([(0, text, 0)], 1, 2)
    grams = Counter(bytes(whole.buffer[a : a + n]) for a, n in zip(whole.starts, whole.sizes))
    parts = Counter()
    for part in resampling.parts_of(text, 0, 2, 50):
        one = resampling.Batch([part], 1, 2)
        parts += Counter(bytes(one.buffer[a : a + n]) for a, n in zip(one.starts, one.sizes))
    assert parts == grams


# --- phrases -------------------------------------------------------------------


def counted_phrases(rows):
    found = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                for k in range(len(words) - n + 1):
                    found["und" if lang is None else lang][tuple(words[k : k + n])] += 1
    return found


def best_phrases(rows, top=2000):
    out = []
    for lang, f in counted_phrases(rows).items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= 10}
        dropped = {p[k : k + 2] for p, a in candidates.items() if len(p) == 3 for k in (0, 1) if 100 * a >= 50 * f[p[k : k + 2]]}
        scored = []
        for p, a in candidates.items():
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if p not in dropped:
                scored.append((-score, -a, " ".join(p), f[p[:k]], f[p[k:]]))
        n = sum(c for p, c in f.items() if len(p) == 1)
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase, -a, l, r, n, -score))
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(9)
    some = ["new", "York", "city", "of", "the", "a\x00b", "été", "hall", "rare", "x" * 30]
    rows = []
    for k in range(160):
        words = rng.choices(some, weights=[9, 8, 7, 9, 9, 2, 3, 3, 1, 1], k=rng.randint(0, 30))
        gaps = [rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\x0b ", "?! "]) if rng.random() < 0.3 else " " for _ in words]
        text = "".join(w + g for w, g in zip(words, gaps))
        rows.append((text, rng.choice(["en", "en", "en", None, "de", ""])))
    rows += [(None, "en"), ("", None), (" .,; ", "en"), ("alone " * 12, "once"), ("new york city " * 900, "long"), ("tok " * 9, "few")]
    return rows + [rows[3]] * 5


@pytest.mark.parametrize("one_in, limit", [(8, 4 << 20), (1, 100), (10**9, 700)])
def test_phrases(spark, phrase_rows, one_in, limit):
    """Whatever the sample proposes: an empty one leaves all to the border and its failures."""
    frame = spark.createDataFrame([(t, l, "x", 1) for t, l in phrase_rows], "text string, lang string, phrase string, n int")
    got = phrases.collocations(frame.repartition(3), one_in=one_in, batch_bytes=limit).collect()
    assert sorted(map(tuple, got)) == best_phrases(phrase_rows)


def test_a_small_filter_only_costs_work(spark, phrase_rows, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    frame = spark.createDataFrame(phrase_rows, "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(frame, top=4).collect())) == best_phrases(phrase_rows, 4)


def test_no_phrases(spark, no_docs):
    assert phrases.collocations(no_docs).collect() == []
    frame = spark.createDataFrame([("one two", "en"), (None, None)], "text string, lang string")
    assert phrases.collocations(frame).collect() == []


@pytest.mark.parametrize("limit", [7, 30, 200])
def test_parts_keep_pieces(limit):
    rng = random.Random(limit)
    text = "".join(rng.choice("abc  \t.\n") for _ in range(700)).encode()
    none = phrases.Filter(np.full(1, 2**64 - 1, np.uint64))

    def counted(parts):
        total = Counter()
        for part, context in parts:
            for some, size, times in phrases.counted_batch(b"en", part, context, none, None):
                assert len(set(some)) == len(some) and all(p.count(b" ") == size - 1 for p in some)
                total.update(dict(zip(some, times.tolist())))
        return total

    assert counted(phrases.parts_of(text, limit)) == counted(phrases.parts_of(text, 10**6))


def test_long_words_are_not_cut():
    text = b"a b " + b"x" * 500 + b" c"
    batch = pa.array([text, b"a"], pa.binary())
    got = list(phrases.batches_of([None, b"en"], iter(batch)))
    assert sum(t.count(b"x" * 500) for _, t, _ in got) == 1 and {x for x, _, _ in got} == {b"und", b"en"}
