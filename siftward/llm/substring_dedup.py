"""Operator 5: substring dedup by repeated-phrase automata.

1. Anchors. Each 13-word window has an anchor that depends on its words alone; neighbours share
   theirs, so a document has about one anchor in six windows. Anchors that occur in several
   documents are found by one shuffle of packed numbers, and go back to the blocks of documents they came from.
2. Candidates. Blocks (some MB of text, by a hash of the row) mark the windows with such an anchor. Documents
   without any are finished.
   The others are kept by block, compressed.
3. Confirmation. 96-bit hashes of the candidate windows, with the least document of the block, are
   shuffled; what comes back is one bit each: whether a smaller document in another block has the window.
4. Automata. Confirmed windows that follow one another and have the same first document are a passage,
   which ends where the content says so (at one anchor in four). Each block compiles its passages into Aho-Corasick automata over word symbols, in
   shards of bounded size, and streams its documents through them to locate every occurrence; the
   words of those whose windows start in a smaller document too are removed. As content ends
   passages, copies with different edits have most of them in common.

No step groups by a window or document: the groups are blocks and hash buckets whose number
grows with the text, and a very common window is one entry for each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftward.llm.common import byte_slices, cut_lineage, raw, table, texts
from siftward.llm.repeats import WINDOW, Words, places, ranges, scrambled, window_hashes

#: Text of a block on average.
BLOCK_BYTES = 4 << 20
#: Text whose words are held at once where a block or batch is read text by text.
PIECE_BYTES = 1 << 19
#: Words of the passages of one automaton; a block has as many automata as it needs.
SHARD_WORDS = 200_000
#: One anchor in so many ends a passage.
CONTENT_CUT = 4
#: Base of a word's symbol, which has three digits or more. An automaton tries a node's children one by one, so nodes
#: must have few.
BASE = 64
#: Rows without id rank behind all ids.
LAST = (1 << 63) - 1

DONE = "array<struct<doc_id: bigint, n_words: bigint, n_removed: bigint, kept_sha256: string>>"


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def packed(numbers: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(numbers, kind).tobytes()


def narrow(numbers: np.ndarray) -> bytes:
    """Signed numbers in as few bytes each as all of them fit."""
    n, width = np.ascontiguousarray(numbers, "<i8"), 1
    # What is left above the sign is 0, or -1 below zero.
    while width < 8 and (n >> (8 * width - 1) != n >> 63).any():
        width += 1
    return n.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``narrow``."""
    found = np.frombuffer(data, np.uint8).reshape(n, -1)
    whole = np.where(found[:, -1:] > 127, 255, 0).astype(np.uint8).repeat(8, axis=1)
    whole[:, : found.shape[1]] = found
    return whole.view("<i8").ravel()


def zipped(pending: list[dict]) -> bytes | None:
    """Unfinished documents of a block, compressed: they are stored, and shuffled once more to meet their replies."""
    if not pending:
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PENDING, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_batch(pa.RecordBatch.from_pylist(pending, PENDING))
    return sink.getvalue().to_pybytes()


def unzipped(pending: bytes) -> list[dict]:
    return pa.ipc.open_stream(pending).read_all().to_pylist()


def bucketed(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Stretches of a sorted array of bucket numbers."""
    edges = np.flatnonzero(np.diff(buckets)) + 1
    for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(buckets)]):
        if stop > start:
            yield int(buckets[start]), slice(start, stop)


def short_keys(keys: np.ndarray) -> np.ndarray:
    """What of an anchor's key is shuffled and compared, beside its bucket. Equal ones by chance only add candidates."""
    return scrambled(keys).astype("<u4")


def piece_anchors(piece: pa.Array, blocks: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of each text, once, with its block."""
    all_ = Words(texts(piece), window)
    key, owner = all_.keys[all_.whole], all_.text[all_.whole]
    # Neighbours mostly share their anchor.
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])[: len(key)]
    key, owner = key[new], owner[new]
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    again = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    new = np.concatenate([[True], ~again])[: len(key)]
    return key[new], blocks[owner[new]]


def packed_anchors(part: pa.Array, blocks: np.ndarray, n: int, window: int) -> pa.RecordBatch:
    """Anchors of some texts by bucket. Words are objects, so only those of a piece are held at a time."""
    pieces, start = [], 0
    for piece in byte_slices(part, PIECE_BYTES):
        pieces.append(piece_anchors(piece, blocks[start : start + len(piece)], window))
        start += len(piece)
    key, block = (np.concatenate(x) for x in zip(*pieces))
    order = np.lexsort((block, key))
    key, block = key[order], block[order]
    # Of equal entries, which are of several documents of a block, two are enough.
    same = (key[1:] == key[:-1]) & (block[1:] == block[:-1])
    third = np.concatenate([[False, False], same[1:] & same[:-1]])[: len(key)]
    key, block = key[~third], block[~third]
    bucket = bucket_of(scrambled(key), n)
    order = np.argsort(bucket, kind="stable")
    key, block, bucket = short_keys(key[order]), block[order], bucket[order]
    rows = [(b, packed(key[s], "<u4"), narrow(block[s])) for b, s in bucketed(bucket)]
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array([r[0] for r in rows], pa.int32()),
        "keys": pa.array([r[1] for r in rows], pa.binary()),
        "blocks": pa.array([r[2] for r in rows], pa.binary()),
    })


def block_anchors(n: int, window: int):
    """Task: anchors of the rows, each with the block of its document, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, start = batch.column("block").to_numpy(), 0
            for part in byte_slices(batch.column("text")):
                yield packed_anchors(part, blocks[start : start + len(part)].astype(np.int64), n, window)
                start += len(part)

    return run


def shared_anchors(group: pa.Table) -> pa.Table:
    """Group: the anchors of a bucket. Those with more than one document, by block."""
    keys = group.column("keys").to_pylist()
    key = np.frombuffer(b"".join(keys), "<u4")
    block = np.concatenate([widened(b, len(k) // 4) for k, b in zip(keys, group.column("blocks").to_pylist())])
    order = np.lexsort((block, key))
    key, block = key[order], block[order]
    same = key[1:] == key[:-1]
    repeated = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    again = np.concatenate([[False], same & (block[1:] == block[:-1])])
    kept = repeated & ~again
    key, block = key[kept], block[kept]
    order = np.argsort(block, kind="stable")
    key, block = key[order], block[order]
    rows = [(b, packed(key[s], "<u4")) for b, s in bucketed(block)]
    return pa.table({
        "block": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary())
    })


def split_piece(piece: pa.Array, names: list, shared: np.ndarray, window: int, pending: list[dict], done: list[dict]) -> None:
    """Put each text to the unfinished or finished documents."""
    all_ = Words(texts(piece), window)
    marked = all_.whole.copy()
    if len(shared):
        keys = short_keys(all_.keys)
        at = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
        marked &= shared[at] == keys
    else:
        marked[:] = False
    found = np.bincount(all_.text[marked], minlength=len(piece))
    bounds = zip(all_.begins.tolist(), all_.ends.tolist())
    for doc, words, n, (low, high) in zip(names, all_.parts, found.tolist(), bounds):
        if n:
            windows = ranges(marked[low : max(low, high - window + 1)])
            pending.append({"doc_id": doc, "text": b" ".join(words), "windows": windows.tolist()})
        else:
            done.append({"doc_id": doc, "n_words": len(words), "n_removed": 0, "kept_sha256": digest(words)})


def split_block(window: int):
    """Group: the documents of a block and its shared anchors. One row: unfinished and finished documents."""

    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "pending": pa.array([], pa.binary()), "done": pa.array([], ARROW_DONE)})
        shared = np.unique(np.frombuffer(b"".join(anchors.column("keys").to_pylist()), "<u4"))
        pending, done = [], []
        names = docs.column("doc_id").to_pylist()
        start = 0
        for chunk in docs.column("text").chunks:
            for piece in byte_slices(chunk, PIECE_BYTES):
                split_piece(piece, names[start : start + len(piece)], shared, window, pending, done)
                start += len(piece)
        return pa.table({
            "block": docs.column("block").slice(0, 1), "pending": pa.array([zipped(pending)], pa.binary()), "done": pa.array([done], ARROW_DONE)
        })

    return run


PENDING = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("windows", pa.list_(pa.int32()))])
ARROW_DONE = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))


def bucket_of(first: np.ndarray, n: int) -> np.ndarray:
    """Buckets that rise with the hash, so that sorted windows lie bucket by bucket."""
    return ((first >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Candidates:
    """Candidate windows of a block: all occurrences, and the distinct ones in order of hash."""

    def __init__(self, pending: list[dict], n: int, window: int):
        # By rank, so that the first of equal windows is of the least document.
        rank = [LAST if p["doc_id"] is None else p["doc_id"] for p in pending]
        order = sorted(range(len(pending)), key=rank.__getitem__)
        self.pending = [pending[k] for k in order]
        self.ranks = [rank[k] for k in order]
        all_ = Words([p["text"] for p in self.pending], window)
        self.words = all_.parts
        starts = [places(np.array(p["windows"], np.int64)) for p in self.pending]
        self.docs = np.repeat(np.arange(len(starts)), [len(x) for x in starts])
        self.starts = np.concatenate(starts)
        at = all_.begins[self.docs] + self.starts
        self.keys = all_.keys[at]
        first, second = window_hashes(all_.hashes, at, window)
        second >>= np.uint64(32)
        order = np.argsort(first, kind="stable")
        a, b = first[order], second[order]
        if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
            order = np.lexsort((np.arange(len(first)), second, first))
            a, b = first[order], second[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        self.first, self.second = a[new], b[new]
        self.least = np.array(self.ranks, np.int64)[self.docs[order][new]]
        #: Whether a window is in several documents of the block.
        self.repeated = np.array(self.ranks, np.int64)[self.docs[order][np.concatenate([new[1:], [True]])]] > self.least
        self.bucket = bucket_of(self.first, n)
        #: Number of the distinct window for each occurrence.
        self.entry = np.empty(len(first), np.int64)
        self.entry[order] = np.cumsum(new) - 1


def packed_windows(block: int, pending: list[dict], n: int, window: int) -> pa.RecordBatch:
    c = Candidates(pending, n, window)
    rows = [
        {"bucket": b, "block": block, "first": packed(c.first[s], "<u8"), "second": packed(c.second[s], "<u4"), "least": narrow(c.least[s])}
        for b, s in bucketed(c.bucket)
    ]
    return pa.RecordBatch.from_pylist(rows, pa.schema([
        ("bucket", pa.int32()), ("block", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("least", pa.binary()),
    ]))


def block_windows(n: int, window: int):
    """Task: candidate windows of the blocks, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                # No name holds a block on while the next is read.
                yield packed_windows(batch.column("block")[at].as_py(), unzipped(batch.column("pending")[at].as_py()), n, window)

    return run


def earlier_elsewhere(group: pa.Table) -> pa.Table:
    """Group: the windows of a bucket. For each entry of a block whether a smaller document of another has it."""
    parts = {k: group.column(k).to_pylist() for k in ("first", "second", "least")}
    sizes = [len(x) // 8 for x in parts["first"]]
    first = np.frombuffer(b"".join(parts["first"]), "<u8")
    second = np.frombuffer(b"".join(parts["second"]), "<u4")
    least = np.concatenate([widened(x, size) for x, size in zip(parts["least"], sizes)])
    order = np.lexsort((least, second, first))
    a, b = first[order], second[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    smallest = least[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    earlier = np.zeros(len(first), bool)
    earlier[order] = smallest < least[order]
    bits, at = [], 0
    for size in sizes:
        bits.append(np.packbits(earlier[at : at + size]).tobytes())
        at += size
    return pa.table({"bucket": group.column("bucket"), "block": group.column("block"), "bits": pa.array(bits, pa.binary())})


def symbol(k: int, digits: int) -> str:
    """Digits of a number, each place with characters of its own, so that no match begins within a word."""
    return "".join([chr(1 + place * BASE + k // BASE**place % BASE) for place in range(digits)])


class Located:
    """Occurrences of confirmed passages, by automata over word symbols in shards of bounded size."""

    def __init__(self, c: Candidates, earlier: np.ndarray, window: int):
        self.c, self.window = c, window
        rank = np.array(c.ranks, np.int64)[c.docs]
        # First document of each occurrence's window; one below all for windows known from other blocks.
        owner = np.where(earlier, -LAST - 1, c.least)[c.entry]
        removed = owner < rank
        cut = (np.diff(c.docs) != 0) | (np.diff(c.starts) != 1) | (owner[1:] != owner[:-1])
        cut |= (c.keys[1:] != c.keys[:-1]) & (c.keys[1:] % np.uint64(CONTENT_CUT) == 0)
        begin = np.concatenate([[0], np.flatnonzero(cut) + 1])
        end = np.concatenate([begin[1:], [len(removed)]])
        begin, end = begin[removed[begin]], end[removed[begin]]
        seen: dict[bytes, tuple[int, int]] = {}
        for a, b in zip(begin.tolist(), end.tolist()):
            seen.setdefault(c.entry[a:b].tobytes(), (a, b))
        kept = np.array(list(seen.values()), np.int64).reshape(-1, 2)
        first = kept[:, 0]
        self.doc, self.start = c.docs[first].tolist(), c.starts[first].tolist()
        self.length, self.owner = (kept[:, 1] - first + window - 1).tolist(), owner[first].tolist()
        # Documents without a confirmed window have no passage.
        confirmed = earlier | c.repeated
        self.streamed = np.unique(c.docs[confirmed[c.entry]]).tolist()

    def shards(self) -> Iterator[list[int]]:
        shard, words = [], 0
        for k, length in enumerate(self.length):
            if shard and words + length > SHARD_WORDS:
                yield shard
                shard, words = [], 0
            shard.append(k)
            words += length
        if shard:
            yield shard

    def covered(self) -> list[np.ndarray]:
        """Per document the change of the number of removed passages at each word."""
        import ahocorasick

        c = self.c
        change = [np.zeros(len(w) + 1, np.int32) for w in c.words]
        number: dict[bytes, int] = {}
        for doc, start, length in zip(self.doc, self.start, self.length):
            for word in c.words[doc][start : start + length]:
                number.setdefault(word, len(number) + 1)
        digits = 3
        while BASE**digits <= len(number) + 1:
            digits += 1
        symbols = {word: symbol(k, digits) for word, k in number.items()}
        other = symbol(0, digits)
        streams = [(doc, "".join([symbols.get(w, other) for w in c.words[doc]])) for doc in self.streamed]
        for shard in self.shards():
            automaton = ahocorasick.Automaton()
            for k in shard:
                phrase = c.words[self.doc[k]][self.start[k] : self.start[k] + self.length[k]]
                automaton.add_word("".join([symbols[w] for w in phrase]), k)
            automaton.make_automaton()
            for doc, text in streams:
                rank, marks = c.ranks[doc], change[doc]
                for end, k in automaton.iter(text):
                    if self.owner[k] < rank:
                        stop = (end + 1) // digits
                        marks[stop - self.length[k]] += 1
                        marks[stop] -= 1
        return change


def finished(pending: list[dict], bits: dict[int, bytes], n: int, window: int) -> pa.RecordBatch:
    c = Candidates(pending, n, window)
    earlier = np.zeros(len(c.first), bool)
    for bucket, s in bucketed(c.bucket):
        count = s.stop - s.start
        earlier[s] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=count).astype(bool)
    rows = []
    for p, words, change in zip(c.pending, c.words, Located(c, earlier, window).covered()):
        removed = np.cumsum(change[:-1]) > 0
        kept = [w for w, gone in zip(words, removed.tolist()) if not gone]
        rows.append({"doc_id": p["doc_id"], "n_words": len(words), "n_removed": int(removed.sum()), "kept_sha256": digest(kept), "kept": b" ".join(kept)})
    return pa.RecordBatch.from_pylist(rows, pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()),
    ]))


def finish(n: int, window: int):
    """Task: blocks with the bits of their windows. Rows of the unfinished documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                bits = {x["bucket"]: x["bits"] for x in batch.column("replies")[at].as_py()}
                yield finished(unzipped(batch.column("pending")[at].as_py()), bits, n, window)

    return run


def without_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and ``kept``, the text left of rows that have repeats.

    ``kept`` is null where no window of the row is a candidate: all words stay. A null text has no words; texts
    with fewer words than a window keep all. Windows of rows with equal ids do not remove one another; a row without id
    ranks behind every id. One row out for each row in.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(n)).cast("int")
    rows = rows.withColumn("block", block)
    anchors = rows.select("block", "text").mapInArrow(block_anchors(n, window), "bucket int, keys binary, blocks binary")
    shared = anchors.groupBy("bucket").applyInArrow(shared_anchors, "block int, keys binary")
    blocks = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        split_block(window), f"block int, pending binary, done {DONE}"
    )
    blocks = cut_lineage(blocks)
    done = blocks.select(F.inline("done")).withColumn("kept", F.lit(None).cast("binary"))
    pending = blocks.where("pending is not null").select("block", "pending")
    windows = pending.mapInArrow(
        block_windows(n, window), "bucket int, block int, first binary, second binary, least binary"
    )
    replies = windows.groupBy("bucket").applyInArrow(earlier_elsewhere, "bucket int, block int, bits binary")
    # At most one reply for each candidate window of the block.
    replies = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("replies"))
    left = pending.join(replies, "block").select("pending", "replies")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
    return done.unionByName(left.mapInArrow(finish(n, window), schema))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(table(spark, folder, "documents")).drop("kept")


#: Windows as texts of words with one blank between them; the document a window first stands in by its smallest id.
ORACLE = r"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
windows AS MATERIALIZED (
    SELECT r, doc_id, s, sha256(array_to_string(w[s:s + 12], ' ')) AS said FROM (
        SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM docs WHERE len(w) > 12)
),
first AS (SELECT said, min(doc_id) AS owner FROM windows GROUP BY said),
gone AS (
    SELECT r, list(DISTINCT place) AS places FROM (
        SELECT r, unnest(range(s, s + 13)) AS place FROM windows JOIN first USING (said) WHERE owner < doc_id)
    GROUP BY r
),
left_over AS (
    SELECT doc_id, w, coalesce(len(places), 0) AS n,
        CASE WHEN places IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(places, i)),
            lambda i: w[i]) END AS kept
    FROM docs LEFT JOIN gone USING (r)
)
SELECT doc_id, len(w)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM left_over
"""
