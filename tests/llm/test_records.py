"""WARC archives, mixtures and preference pairs."""

import base64
import gzip
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftward.llm import mixing, preferences, warc
from siftward.llm.common import file_system

PAGES = [
    (1, "http://a", "same"), (2, "http://b c\n", "same"), (5, None, "same"), (5, "http://again", "same"), (3, "http://n", None), (4, "http://e", ""),
    (None, "http://x", "same"), (None, "http://y", "alone"), (7, "é", "ünï\r\n\r\ncode"), (8, "http://l", "long " * 400_000),
]


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected_pages(pages, least=0):
    keeper = {}
    for i, _, t in pages:
        if i is not None and len((t or "").encode()) >= least:
            keeper[t or ""] = max(keeper.get(t or "", i), i)
    count = Counter(t or "" for _, _, t in pages)
    out = []
    for i, _, t in pages:
        k = keeper.get(t or "")
        revisit = k is not None and i != k and count[t or ""] > 1
        out.append((i, len((t or "").encode()), b32(t), "revisit" if revisit else "response", k if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 3, 10])
@pytest.mark.parametrize("archive_bytes", [1 << 30, 600])
def test_round_trip(spark, least, archive_bytes):
    frame = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, payload string, keeper int")
    folder, index = warc.write_archives(frame, revisit_bytes=least, archive_bytes=archive_bytes)
    records = warc.read_records(index, folder)
    assert sorted((tuple(r) for r in warc.page_digests(records).collect()), key=repr) == expected_pages(PAGES, least)
    bodies = sorted((r.page_id or -1, bytes(r.payload)) for r in records.where("record_type = 'response'").collect())
    keep = {(i, t) for i, _, _, kind, _ in expected_pages(PAGES, least) if kind == "response" for j, _, t in PAGES if i == j}
    assert {b for _, b in bodies} == {(t or "").encode() for _, t in keep}


def test_archives_are_gzip_members_with_correct_places(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    folder, index = warc.write_archives(frame)
    rows = index.orderBy("archive", "offset").collect()
    store, base = file_system(folder)
    for name in {r.archive for r in rows}:
        with store.open_input_file(f"{base}/{name}") as file:
            data = file.read()
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 1 + sum(r.archive == name for r in rows)
        for r in rows:
            if r.archive == name:
                fields, _ = warc.parsed(data[r.offset : r.offset + r.length])
                assert fields["WARC-Payload-Digest"] == "sha1:" + r.digest and fields["WARC-Type"] == r.record_type


def test_selected_records_only(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder, index = warc.write_archives(frame)
    (row,) = warc.read_records(index.where("page_id = 7"), folder).collect()
    assert bytes(row.payload).decode() == "ünï\r\n\r\ncode" and row.url == "é"
    assert warc.page_digests(warc.read_records(index.limit(0), folder)).count() == 0


def test_near_ranges_are_one_read():
    gap, most = warc.GAP_BYTES, warc.READ_BYTES
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 20 + gap, 5), ("a", 26 + 2 * gap, 5), ("b", 0, 5), ("b", 5, most)]
    reads = list(warc.coalesced(iter(rows)))
    assert [(r[0], r[1], r[2], len(r[3])) for r in reads] == [
        ("a", 0, 25 + gap, 3), ("a", 26 + 2 * gap, 31 + 2 * gap, 1), ("b", 0, 5, 1), ("b", 5, 5 + most, 1),
    ]


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    folder, index = warc.write_archives(none)
    assert warc.page_digests(warc.read_records(index, folder)).count() == 0


@pytest.fixture(scope="module")
def sourced(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        rows.append((i if i % 50 else None, " ".join(["w"] * rng.randint(0, 40)) or None, source, "x", i))
    rows += [(1, "w w w", "hot", "x", 0)] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, source string, epoch string, block int")


def totals(rows):
    out = defaultdict(int)
    for r in rows:
        out[r.source] += r.n_tokens
    return out


def test_repetition_limit(sourced):
    mix = mixing.Mix(repeats=1.25, block_tokens=200)
    plan = {r.source: r for r in mixing.weights(mixing.counted(sourced), mix).collect()}
    assert sum(r.weight for r in plan.values()) == pytest.approx(1)
    most = max(r.budget / r.n_tokens for r in plan.values())
    assert 1.2 < most <= 1.2501
    rows = mixing.mixed(sourced, mix).collect()
    for source, n in totals(rows).items():
        assert 0 <= n - plan[source].budget < 41
    per_epoch = Counter((r.source, r.epoch) for r in rows)
    assert per_epoch["a", 0] == plan["a"].n_docs and 0 < per_epoch["a", 1] < plan["a"].n_docs
    places = Counter((r.source, r.epoch, r.slot, r.rank) for r in rows)
    assert max(places.values()) == 1


def test_entropy_target_without_repetition(sourced):
    mix = mixing.Mix(entropy=0.995, block_tokens=200)
    plan = mixing.weights(mixing.counted(sourced), mix).toPandas()
    w = plan.weight.to_numpy()
    assert -(w * np.log(w)).sum() / np.log(len(w)) == pytest.approx(0.995, abs=1e-6)
    assert (plan.budget <= plan.n_tokens).all() and (plan.budget / plan.n_tokens).max() > 0.999
    rows = mixing.mixed(sourced, mix).collect()
    assert {r.epoch for r in rows} <= {0, 1}
    kept = mixing.mixed_documents(sourced, mix)
    assert kept.columns == sourced.columns


def test_documents_are_those_taken(spark):
    rows = [(None, " ".join(f"{k}-{j}" for j in range(10)), "bare") for k in range(600)]
    rows += [(None, "w w w w w", "equal")] * 300 + [(5, f"{k} b c d e", "one id") for k in range(300)]
    rows += [(1000 + k, "a b c d e", "scarce") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mix = mixing.Mix(repeats=2.0, block_tokens=200)
    plan = {r.source: r for r in mixing.weights(mixing.counted(docs), mix).collect()}
    kept = mixing.mixed_documents(docs, mix).collect()
    tokens = Counter()
    for r in kept:
        tokens[r.source] += len(r.text.split())
    assert all(0 <= tokens[s] - p.budget < 10 for s, p in plan.items()) and plan["bare"].budget < 6000
    assert {tuple(r) for r in kept} <= set(rows)


def test_epochs_have_their_own_order(sourced):
    rows = mixing.mixed(sourced, mixing.Mix(repeats=9.0, budget=60_000, block_tokens=100)).collect()
    order = lambda e: [r.doc_id for r in sorted((r for r in rows if r.source == "b" and r.epoch == e), key=lambda r: (r.slot, r.rank))]
    first, second = order(0), order(1)
    assert sorted(map(str, first)) == sorted(map(str, second)) and first != second


def test_mixtures_of_nothing(spark, no_docs):
    mix = mixing.Mix(repeats=2.0)
    assert mixing.mixed(no_docs, mix).count() == 0
    silent = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert mixing.mixed(silent, mix).count() == 0
    one = spark.createDataFrame([(1, "w w", None)], "doc_id long, text string, source string")
    assert mixing.mixed(one, mixing.Mix(entropy=0.9)).count() == 1
    with pytest.raises(ValueError):
        mixing.Mix()


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def test_formatting_of_given_pairs(spark):
    u, a, b = ("user", "hi 😀"), ("assistant", "one"), ("assistant", "two <|im_end|>")
    cases = [([u, a], [u, b]), ([u, a, u, b], [u, a, u, a]), ([u], [u]), ([], [u, a]), (None, None), ([u, a], [u, a, u, b]), ([a, u], [u, a])]
    rows = [(k, *[None if s is None else [{"role": r, "text": t} for r, t in s] for s in pair], "kept") for k, pair in enumerate(cases)]
    frame = spark.createDataFrame(rows, f"id int, chosen {preferences.TURNS}, rejected {preferences.TURNS}, extra string")
    for row in preferences.formatted(frame).collect():
        chosen, rejected = (x or [] for x in cases[row.id])
        n = 0
        while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
            n += 1
        assert row.n_prompt_turns == n and row.extra == "kept"
        assert row.prompt == render(chosen[:n])
        for text, spans, turns in ((row.chosen_text, row.chosen_spans, chosen[n:]), (row.rejected_text, row.rejected_spans, rejected[n:])):
            assert text == render(turns)
            ranges = [tuple(map(int, s.split("-"))) for s in spans.split(",") if s]
            assert [text[x:y] for x, y in ranges] == [t + "<|im_end|>" for r, t in turns if r == "assistant"]


def test_pairs_of_conversations(spark):
    turns = [
        (1, 0, "user", "q"), (1, 1, "assistant", "one"), (2, 0, "user", "q"), (2, 2, "assistant", "B"), (2, 1, "assistant", "A"),
        (3, 0, "user", "other"), (3, 1, "assistant", "three"), (3, 2, "user", "left open"), (4, 0, "user", "no answer"),
        (None, None, None, None), (None, 1, "assistant", "<|im_end|>"), (5, 0, "system", None), (5, 0, "assistant", "x"), (5, 0, "assistant", "x"),
    ]
    frame = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, prompt string").repartition(3)
    pairs = {r.conv_id: r for r in preferences.paired(frame).collect()}
    assert set(pairs) == {1, 2, 3, 5, None}
    assert {pairs[1].partner_id, pairs[2].partner_id} & {1, 2}
    for r in pairs.values():
        assert r.chosen[-1].role == "assistant" and r.rejected[-1].role == "assistant"
    assert [t.text for t in pairs[3].chosen] == ["other", "three"]
    assert [t.text for t in pairs[2].chosen] == ["q", "A", "B"]
    assert pairs[None].chosen[-1].text == "< |im_end|>"
    texts = preferences.formatted(preferences.paired(frame)).collect()
    assert len(texts) == 5 and all(r.chosen_text or r.rejected_text or r.prompt for r in texts)


def test_small_rings_hold_all_conversations(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c % 3}-{t}-{c if t else ''}") for c in range(60) for t in range(4)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = preferences.paired(frame, ring=7).collect()
    assert {r.conv_id for r in pairs} == set(range(60)) and Counter(r.partner_id for r in pairs).most_common(1)[0][1] == 1
    assert preferences.formatted(preferences.paired(frame.limit(0))).count() == 0


def test_turns_without_key_are_conversations_of_their_own(spark):
    rows = [(None, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(3000)] + [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = preferences.paired(frame, ring=50)
    assert pairs.where("conv_id is null and size(chosen) = 1").count() == 1500 and pairs.count() == 1501


def test_too_long_conversation_is_an_error_before_it_is_gathered(spark):
    rows = [(1, t, "user", "x" * 100) for t in range(50)] + [(2, 0, "user", "q")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    with pytest.raises(ValueError, match="largest '1'"):
        preferences.gathered(frame, most_bytes=5000)
    assert preferences.gathered(frame, most_bytes=10_000).count() == 2
