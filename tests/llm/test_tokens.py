"""Token counts and the token store against whole-text encoding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftward.llm.elias_fano import EliasFano
from siftward.llm.encoding import splits_at_blanks
from siftward.llm.token_counts import Lengths, count_tokens
from siftward.llm.token_store import Encoder, ShardReader, read_digests, store_tokens, write_shards

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
PARTS = st.lists(
    st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", " ", " ", "　", "\x85", "᠎", "​", "́",
                     "it's", "'ll", "a", "Zebra", "9", "12", "!?", "é", "Σ", "ς", "İ", "<|endoftext|>", "<|startoftext|>", "中文", "😀", "_", ".", ",", ";:", "ß", "Ü"]),
    max_size=14,
).map("".join)


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_level():
    return Tokenizer.from_file(WORD)


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=4))
def test_lengths_of_pieces(byte_level, batch):
    expected = [len(x.ids) for x in byte_level.encode_batch(batch, add_special_tokens=False)]
    assert Lengths(byte_level, True).count([t.encode() for t in batch]) == expected


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=4))
def test_ids_of_words(word_level, batch):
    expected = [x.ids for x in word_level.encode_batch(batch, add_special_tokens=False)]
    for end in (None, "</w>"):
        found = Encoder(word_level, True, end).ids([t.encode() for t in batch])
        assert [np.frombuffer(x, "<u2").tolist() for x in found] == expected


def test_lines_of_words(word_level, messy_rows):
    text = " ".join(r[1] or "" for r in messy_rows) + " Straße Été ÉTÉ İx ŉ ª º ﬁ ͅ Ǆ ĳ word. Word, WORD!? a). x.y. <|ENDOFTEXT|>. <|endoftext|>, é. 9. 1,2: it's. ..."
    expected = word_level.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(Encoder(word_level, True, "</w>").ids([text.encode()])[0], "<u2").tolist() == expected


def test_only_known_tokenizers_are_split():
    assert splits_at_blanks(open(BYTE).read()) and not splits_at_blanks(open(WORD).read())


def test_counts(messy, messy_rows, byte_level):
    got = sorted(tuple(r) for r in count_tokens(messy, BYTE).fillna(-99, ["doc_id"]).collect())
    expected = sorted(
        (-99 if i is None else i, len((t or "").encode()), n := len(byte_level.encode(t or "", add_special_tokens=False).ids), n > 1024)
        for i, t, *_ in messy_rows
    )
    assert got == expected


def test_counts_of_no_documents(no_docs):
    assert count_tokens(no_docs, BYTE).collect() == []


def by_library(rows, encoder):
    def key(row):
        return (row[0] is not None, row[0] or 0)

    out, start = [], 0
    for i, t, *_ in sorted(rows, key=key):
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out, start


def test_store(spark, messy, messy_rows, word_level):
    expected, total = by_library(messy_rows, word_level)
    got = sorted(store_tokens(messy, WORD).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [e[0] for e in expected]
    none = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(none((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(map(none, expected))
    ends = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *ends[:-1].tolist()] and ends[-1] == total


def test_small_shards_hold_the_same(spark, messy):
    folder, manifest = write_shards(messy, WORD, shard_bytes=500)
    assert manifest.count() > 10
    again = {(r.doc_id, r.n_tokens, r.ids_crc32, r.start) for r in read_digests(spark, folder, manifest).collect()}
    whole = {(r.doc_id, r.n_tokens, r.ids_crc32, r.start) for r in store_tokens(messy, WORD).collect()}
    assert again == whole


def test_single_documents_are_read_by_select(spark, messy, messy_rows, word_level):
    folder, manifest = write_shards(messy, WORD)
    for row in manifest.collect():
        reader = ShardReader(folder, row.file)
        for k, (name, at, ids) in enumerate(reader.documents()):
            assert reader.ids(k).tolist() == ids.tolist()
        assert len(reader) == row.n_docs


def test_no_documents_no_shards(no_docs):
    assert store_tokens(no_docs, WORD).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), max_size=60).map(sorted), st.data())
def test_elias_fano(values, data):
    code = EliasFano.from_bytes(EliasFano.of(np.array(values, np.int64)).to_bytes())
    assert code.select_range(0, len(values)).tolist() == values
    if values:
        k = data.draw(st.integers(0, len(values) - 1))
        assert code.select(k) == values[k]


def test_elias_fano_space_and_samples():
    rng = random.Random(3)
    values = np.cumsum([rng.randint(0, 2000) for _ in range(20_000)])
    code = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
    for start in (0, 1, 511, 512, 513, 9_999, 19_000):
        assert code.select_range(start, start + 700).tolist() == values[start : start + 700].tolist()
    assert len(code.to_bytes()) * 8 / len(values) < 2 + np.log2(1000) + 1.5
