"""Operator 9: token ids in binary shards, with Elias-Fano document boundaries.

A shard file holds the ids of its documents one after another (2 bytes each where the vocabulary
allows, else 4), the ends of the documents and the document ids as Elias-Fano codes, and a trailer.
Shards follow one another in ascending document id. Each is written by one task under a name of
its own, and counts only once its row of the manifest is stored; what a lost or repeated task
left behind is never read.

Texts are dealt to the shards by ranges of the document id before they are encoded, so
the shuffle moves text, which is smaller than its ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftward.llm.common import byte_slices, cut_lineage, file_system, new_folder, raw, table, texts
from siftward.llm.elias_fano import EliasFano
from siftward.llm.encoding import (
    CHUNK,
    Cache,
    added_tokens,
    chunks,
    drops_blanks,
    for_worker,
    is_one_word,
    is_plain,
    stem_and_tail,
    stems_and_tails,
    vocabulary,
    word_end,
)

END_ID = 2
MAGIC = b"SWIDS\x00\x01\x00"
#: Magic, bytes per id, documents without id (they come first), ids, bytes of the ends, bytes of the
#: document ids. It stands last, as a stream to an object store cannot go back.
TRAILER = struct.Struct("<8sBQQQQ")
#: Bytes of ids after which a task closes a shard and opens the next.
SHARD_BYTES = 256 << 20


#: Words and stems kept in a worker's memory, some 160 bytes each.
CACHE = (500_000, 1_500_000)
#: New words that are encoded together.
LINE = 64


class Encoder:
    """Ids of whole texts as bytes; words are encoded once each where white space leaves no token.

    A text is taken apart into stems and stops in one go, so that case and stops cost no further encoding; the words
    of an odd text are looked at one by one. New plain words go to the tokenizer in lines, which are cut at the tokens
    that end a word.
    """

    def __init__(
        self, encoder, split: bool, end: str | None = None, cache: tuple[int, int] = CACHE, added: tuple[bytes, ...] = ()
    ):
        self.encoder, self.split, self.added = encoder, split, added
        size = encoder.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = None
        if split and end:
            self.ends = np.zeros(size, bool)
            self.ends[[k for token, k in encoder.get_vocab().items() if token.endswith(end)]] = True
        self.words = Cache(self.joined, cache[0])
        self.stems = Cache(self.of_stems, cache[1])

    def encoded(self, pieces: list[bytes]) -> list[bytes]:
        batch = [p.decode("utf-8", "replace") for p in pieces]
        found = self.encoder.encode_batch_fast(batch, add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def joined(self, words: list[bytes]) -> list[bytes]:
        parts = [stem_and_tail(w) for w in words]
        known = self.stems.of({x for part in parts for x in part})
        return [known[stem] + known[tail] for stem, tail in parts]

    def of_stems(self, pieces: list[bytes]) -> list[bytes]:
        if self.ends is None:
            return self.encoded(pieces)
        out: dict[bytes, bytes] = {}
        plain = [p for p in pieces if is_one_word(p)]
        lines = [plain[k : k + LINE] for k in range(0, len(plain), LINE)]
        texts_ = [b" ".join(x).decode() for x in lines]
        width = self.kind.itemsize
        for line, found in zip(lines, self.encoder.encode_batch_fast(texts_, add_special_tokens=False)):
            ids = np.array(found.ids, self.kind)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
            if len(stops) == len(line):
                data = ids.tobytes()
                out.update(zip(line, [data[a:b] for a, b in zip([0, *stops], stops)]))
        rest = [p for p in pieces if p not in out]
        out.update(zip(rest, self.encoded(rest)))
        return [out[p] for p in pieces]

    def ids(self, batch: list[bytes]) -> list[bytes]:
        if not self.split:
            return self.encoded(batch)
        if len(batch) == 1 and len(batch[0]) > CHUNK:
            return [b"".join(x for c in chunks(batch[0]) for x in self.by_word([c]))]
        return self.by_word(batch)

    def by_word(self, batch: list[bytes]) -> list[bytes]:
        # Only ASCII white space cuts: it is white space for any pattern.
        lower = [text.lower() for text in batch]
        plain = [k for k, text in enumerate(lower) if is_plain(text, self.added)]
        out = [b""] * len(batch)
        parts = stems_and_tails([lower[k] for k in plain])
        known = self.stems.of(set().union(*parts))
        for k, part in zip(plain, parts):
            out[k] = b"".join(map(known.__getitem__, part))
        if len(plain) < len(batch):
            odd = sorted(set(range(len(batch))).difference(plain))
            words = [batch[k].split() for k in odd]
            known = self.words.of(set().union(*words))
            for k, part in zip(odd, words):
                out[k] = b"".join(map(known.__getitem__, part))
        return out


class Shard:
    def __init__(self, folder: str, kind: np.dtype):
        self.kind = kind
        self.store, base = file_system(folder)
        self.name = f"{uuid4().hex}.ids"
        self.path = f"{base}/{self.name}"
        self.file = self.store.open_output_stream(self.path)
        self.ends: list[int] = [0]
        self.docs: list[int | None] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        self.file.write(ids)
        self.ends.append(self.ends[-1] + len(ids) // self.kind.itemsize)
        self.docs.append(doc)

    def close(self) -> dict:
        known = [d for d in self.docs if d is not None]
        ends = EliasFano.of(np.array(self.ends)).to_bytes()
        docs = EliasFano.of(np.array(known, np.int64)).to_bytes()
        trailer = TRAILER.pack(
            MAGIC, self.kind.itemsize, len(self.docs) - len(known), self.ends[-1], len(ends), len(docs)
        )
        self.file.write(ends + docs + trailer)
        self.file.close()
        first = self.docs[0]
        return {"file": self.name, "n_docs": len(self.docs), "n_ids": self.ends[-1], "first_doc": first}


class ShardReader:
    def __init__(self, folder: str, name: str):
        store, base = file_system(folder)
        self.file = store.open_input_file(f"{base}/{name}")
        size = self.file.size()
        trailer = self.read(size - TRAILER.size, TRAILER.size)
        magic, width, self.n_null, self.n_ids, n_ends, n_docs = TRAILER.unpack(trailer)
        if magic != MAGIC:
            raise ValueError(f"not a shard of token ids: {name}")
        self.kind = np.dtype(f"<u{width}")
        at = self.n_ids * width
        if at + n_ends + n_docs + TRAILER.size != size:
            raise ValueError(f"incomplete shard of token ids: {name}")
        self.ends = EliasFano.from_bytes(self.read(at, n_ends))
        self.docs = EliasFano.from_bytes(self.read(at + n_ends, n_docs))

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def __len__(self) -> int:
        return self.ends.n - 1

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document, by two selects and one read."""
        start, stop = self.ends.select_range(k, k + 2).tolist()
        return self.block(start, stop)

    def block(self, start: int, stop: int) -> np.ndarray:
        width = self.kind.itemsize
        return np.frombuffer(self.read(start * width, (stop - start) * width), self.kind)

    def documents(self, bytes_at_once: int = 4 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """All documents in order: id, place of the first token, ids."""
        step = 4096
        for low in range(0, len(self), step):
            high = min(low + step, len(self))
            ends = self.ends.select_range(low, high + 1)
            names = [None] * max(0, min(high, self.n_null) - low)
            names += self.docs.select_range(max(low - self.n_null, 0), max(high - self.n_null, 0)).tolist()
            a = 0
            while a < high - low:
                # As many documents as fit, one at least.
                limit = ends[a] + bytes_at_once // self.kind.itemsize
                b = max(a + 1, int(np.searchsorted(ends, limit, side="right")) - 1)
                ids = self.block(int(ends[a]), int(ends[b]))
                for k in range(a, b):
                    yield names[k], int(ends[k]), ids[ends[k] - ends[a] : ends[k + 1] - ends[a]]
                a = b

    def close(self) -> None:
        self.file.close()


MANIFEST = "file string, n_docs long, n_ids long, first_doc long, part int, number int"


def write_shards(
    docs: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID, key: str = "doc_id",
    text: str = "text", shard_bytes: int = SHARD_BYTES, cache: tuple[int, int] = CACHE,
) -> tuple[str, DataFrame]:
    """Encode and write all documents; returns the folder and the stored manifest.

    The manifest has a row per shard: file, documents, ids, and ``start``, the number of ids in
    all shards before it. A null text is empty and holds the end id alone. Documents without
    id come first; rows of one id stand side by side, ordered by their texts' hash.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-ids")
    source = vocabulary(spark, path)
    split, mark, added = drops_blanks(source.value), word_end(source.value), added_tokens(source.value)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), raw(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = for_worker(source, Encoder, split, mark, cache, added)
        end = np.array([end_id], encoder.kind).tobytes()
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        shard, written, done = None, 0, []
        for batch in batches:
            names, at = batch.column("doc_id").to_pylist(), 0
            for part in byte_slices(batch.column("text")):
                for ids in encoder.ids(texts(part)):
                    if shard is None:
                        shard, written = Shard(folder, encoder.kind), 0
                    shard.add(names[at], ids + end)
                    written += len(ids)
                    at += 1
                    if written >= shard_bytes:
                        done.append(shard.close())
                        shard = None
        if shard is not None:
            done.append(shard.close())
        place = TaskContext.get().partitionId()
        done = [row | {"part": place, "number": k} for k, row in enumerate(done)]
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([
                ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
                ("first_doc", pa.int64()), ("part", pa.int32()), ("number", pa.int32()),
            ]))

    manifest = cut_lineage(rows.select("doc_id", "text").mapInArrow(write, MANIFEST))
    # One row per shard of a quarter of a gigabyte.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))
    return folder, cut_lineage(manifest.withColumn("start", start))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_digests(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: id, place of its first token, tokens, checksum of its ids."""
    count = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = ShardReader(folder, row["file"])
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for doc, at, ids in reader.documents():
                    out["doc_id"].append(doc)
                    out["start"].append(row["start"] + at)
                    out["n_tokens"].append(len(ids))
                    out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                    if len(out["start"]) == 20_000:
                        yield digests(out)
                        out = {k: [] for k in out}
                yield digests(out)
                reader.close()

    files = manifest.select("file", "start").repartition(max(1, count), "file")
    return files.mapInArrow(read, READ)


def digests(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def store_tokens(docs: DataFrame, path: str, cache: tuple[int, int] = CACHE) -> DataFrame:
    """Write a corpus as token ids and read the digest of each document back from the files."""
    folder, manifest = write_shards(docs, path, cache=cache)
    return read_digests(docs.sparkSession, folder, manifest)


def op9_token_store(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return store_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
