"""Operator 6: benchmark decontamination by an FM-index for each training shard.

The phrases are the 13-word windows of the benchmark's items (a shorter item is one phrase).
A shard's text is its sequence of word numbers in the phrases' vocabulary. Words of no phrase
end a segment, and segments shorter than the shortest phrase are left out: no phrase can occur
there, so nothing is lost and the index stays small. All phrases are searched backwards at
once, their occurrences located by sampled suffix positions, and the spans merged.

The phrases go to the tasks in blocks of bounded size; each block is a further pass over the same rows.
Nothing is shuffled and no document leaves its row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftward.llm.common import byte_slices, columns_of, free_name, raw, table, texts
from siftward.llm.fm_index import FMIndex

WINDOW = 13
#: Text of benchmark items in one block, thereby the size of a broadcast.
BLOCK_BYTES = 8 << 20
#: Words of one index; a longer segment is cut, with an overlap.
SHARD_WORDS = 1 << 20

#: Lower case for A-Z; everything that belongs to no word becomes a blank.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Phrases:
    """Distinct windows of a block of items, by length, as rows of word numbers."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str] = []
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, text in items:
            found = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if not found:
                continue
            self.ids.append(item)
            size = min(window, len(found))
            for k in range(len(found) - size + 1):
                owners[tuple(found[k : k + size])].add(len(self.ids) - 1)
        self.by_length = {
            size: (
                np.array([p for p in owners if len(p) == size], np.int64),
                [sorted(owners[p]) for p in owners if len(p) == size],
            )
            for size in sorted({len(p) for p in owners})
        }
        self.shortest = min(self.by_length, default=window)


def segments(found: np.ndarray, shortest: int, longest: int) -> Iterator[tuple[int, int]]:
    """Runs of known words, of at least the shortest phrase; very long ones in overlapping parts."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], found != 0, [0]])))
    for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
        while stop - start > SHARD_WORDS:
            yield start, start + SHARD_WORDS
            start += SHARD_WORDS - longest + 1
        if stop - start >= shortest:
            yield start, stop


class Shard:
    """Segments of some documents, up to the size of one index."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.parts: list[np.ndarray] = []
        self.where: list[tuple[int, int, int]] = []
        self.size = 0

    def add(self, doc: int, found: np.ndarray) -> None:
        longest = max(self.phrases.by_length, default=1)
        for start, stop in segments(found, self.phrases.shortest, longest):
            self.where.append((self.size, doc, start))
            self.parts += [found[start:stop], np.zeros(1, found.dtype)]
            self.size += stop - start + 1

    def hits(self) -> Iterator[tuple[int, int, int, list[int]]]:
        """Document, first word and length of each occurrence, and the items it belongs to."""
        if not self.where:
            return
        index = FMIndex(np.concatenate(self.parts), len(self.phrases.vocabulary) + 1)
        starts, docs, offsets = (np.array(x) for x in zip(*self.where))
        for size, (patterns, owners) in self.phrases.by_length.items():
            low, high = index.search(patterns)
            counts = high - low
            which = np.repeat(np.arange(len(patterns)), counts)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]
            at = index.locate(rows)
            part = np.searchsorted(starts, at, side="right") - 1
            first = at - starts[part] + offsets[part]
            for doc, word, pattern in zip(docs[part].tolist(), first.tolist(), which.tolist()):
                yield doc, word, size, owners[pattern]
        self.parts, self.where, self.size = [], [], 0


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def find(batch: Iterator[list[bytes]], phrases: Phrases) -> list[dict]:
    """Words, merged spans and items of each text."""
    rows: list[dict] = []
    spans: dict[int, set[tuple[int, int]]] = defaultdict(set)
    items: dict[int, set[int]] = defaultdict(set)
    shard = Shard(phrases)

    def collect() -> None:
        for doc, word, size, owners in shard.hits():
            spans[doc].add((word, word + size))
            items[doc].update(owners)

    number = phrases.vocabulary.get
    for part in batch:
        for text in part:
            found = words(text)
            shard.add(len(rows), np.fromiter((number(w, 0) for w in found), np.int32, len(found)))
            rows.append({"n_words": len(found)})
            if shard.size >= SHARD_WORDS:
                collect()
    collect()
    for doc, row in enumerate(rows):
        row["spans"] = [{"first": a, "stop": b} for a, b in merged(list(spans.get(doc, ())))]
        row["items"] = sorted({phrases.ids[i] for i in items.get(doc, ())})
    return rows


FOUND = "struct<n_words: bigint, spans: array<struct<first: bigint, stop: bigint>>, items: array<string>>"
ARROW_FOUND = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))),
    ("items", pa.list_(pa.string())),
])


def blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in parts of bounded size; at most one partition of them is in the driver at once."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), raw(text).alias("t"))
    block: list[tuple[str, bytes]] = []
    size = 0
    for row in rows.toLocalIterator():
        if block and size + len(row.t) > limit:
            yield block
            block, size = [], 0
        block.append((row.i, bytes(row.t)))
        size += len(row.t)
    if block:
        yield block


def block_hits(spark: SparkSession, text: str, items: list[tuple[str, bytes]], window: int) -> Column:
    shared = spark.sparkContext.broadcast(items)

    @F.arrow_udf(FOUND)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        phrases = Phrases(shared.value, window)
        for batch in batches:
            rows = find((texts(x) for x in byte_slices(batch)), phrases)
            yield pa.array(rows, ARROW_FOUND)

    return search(raw(text))


def with_hits(
    docs: DataFrame, benchmark: DataFrame, column: str, text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add a column of ``n_words``, ``n_hit``, ``spans`` (of hit words, merged) and ``items``.

    A null or empty text has no words. An item without words is in no text; one without id is
    listed as the empty string; items of one id count once. Spans are first word and the
    word after the last, from 0.
    """
    spark = docs.sparkSession
    parts = [block_hits(spark, text, b, window) for b in blocks(benchmark, item, item_text, block_bytes)]
    if not parts:
        parts = [block_hits(spark, text, [], window)]
    names = [free_name(docs, f"{column}_{k}") for k in range(len(parts))]
    out = docs.withColumns(dict(zip(names, parts)))
    if len(parts) == 1:
        spans = F.col(names[0])["spans"]
    else:
        spans = merged_spans(F.array_sort(F.concat(*[F.col(n)["spans"] for n in names])))
    items = F.array_sort(F.array_distinct(F.concat(*[F.col(n)["items"] for n in names])))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])
    found = F.struct(
        F.col(names[0])["n_words"].alias("n_words"), n_hit.alias("n_hit"), spans.alias("spans"), items.alias("items")
    )
    return out.withColumn(column, found).drop(*names)


def merged_spans(ordered: Column) -> Column:
    """Sorted spans of several blocks as one list without overlaps."""
    none = F.array().cast("array<struct<first: bigint, stop: bigint>>")

    def add(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["first"].alias("first"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        return F.when(
            span["first"] <= last["stop"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(ordered, none, add)


def contaminated(found: str) -> Column:
    """The rule: any hit word, and at least a twentieth of the words."""
    hit = F.col(found)["n_hit"]
    return (hit > 0) & (20 * hit >= F.col(found)["n_words"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Documents that the rule does not call contaminated, with their columns."""
    name = free_name(docs, "hits")
    return with_hits(docs, benchmark, name, text).where(~contaminated(name)).select(*columns_of(docs))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = with_hits(docs, table(spark, folder, "benchmark"), "found")
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        contaminated("found").alias("contaminated"),
    )


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
#: Words of a text from 1; phrases are compared as texts of words with one blank between them.
ORACLE = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_SQL_WORDS} AS w FROM benchmark),
phrases AS MATERIALIZED (
    SELECT DISTINCT item, size, array_to_string(w[s:s + size - 1], ' ') AS phrase FROM (
        SELECT item, w, least({WINDOW}, len(w)) AS size, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS s
        FROM items WHERE len(w) > 0)
),
starts AS (
    SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM docs, (SELECT DISTINCT size FROM phrases)
    WHERE len(w) >= size
),
hits AS MATERIALIZED (
    SELECT r, s, p.size, item FROM (SELECT r, s, size, array_to_string(w[s:s + size - 1], ' ') AS phrase FROM starts) d
    JOIN phrases p ON p.size = d.size AND p.phrase = d.phrase
),
covered AS (
    SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS place FROM hits) GROUP BY r
),
found AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
