"""Operator 12: importance resampling of documents towards a target distribution over hashed n-grams.

A feature is a run of 1 or 2 consecutive words, its bucket the CRC-32 of its bytes. Two passes read the texts: the
first counts the buckets of documents and target, the second adds up the gains of each document's features. Both intern the
n-grams of a batch in an open-addressed NumPy table: its keys are xxhash64 of the bytes, equal keys are verified byte by
byte, and a slot stores an n-gram's bucket and count, so that a bucket is computed once for a distinct n-gram. The
slot ids of the occurrences then gather the gains.

The n-grams of a batch are never Python objects: the words of a text are laid out with one blank between them, so each
n-gram is a stretch of that buffer. Buckets are summed in tasks before they are exchanged; the gains are one array of
fixed size. The draw (Gumbel top-k) is a scan over ranges of the score, without a global sort in one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftward.llm.common import byte_slices, cut_lineage, raw, table, texts
from siftward.llm.decontamination import WORD_BYTES
from siftward.operators.skew import numbered

BUCKETS = 10_000
LONGEST = 2
SEED = 7
LEAST_WORDS = 20
DRAWN_PERCENT = 25
#: Text interned at once in a task; a longer text is taken in parts.
BATCH_BYTES = 1 << 20
#: Only a first word that the part before has counted.
CONTEXT, WHOLE = 1, 0

P1, P2, P3, P4, P5 = (
    np.uint64(p) for p in (
        11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261,
    )
)


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashes(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of stretches of a buffer that has 8 spare bytes at its end."""
    import xxhash

    at = starts.copy()
    left = sizes.copy()
    out = P5 + sizes.astype(np.uint64)
    # Unaligned words of 8 and 4 bytes at every place of the buffer.
    eights = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))
    fours = np.ndarray(len(buffer) - 7, "<u4", buffer, strides=(1,))
    for _ in range(3):
        rows = np.flatnonzero((left >= 8) & (sizes < 32))
        if not len(rows):
            break
        lane = rotated(eights[at[rows]] * P2, 31) * P1
        out[rows] = rotated(out[rows] ^ lane, 27) * P1 + P4
        at[rows] += 8
        left[rows] -= 8
    rows = np.flatnonzero((left >= 4) & (sizes < 32))
    out[rows] = rotated(out[rows] ^ (fours[at[rows]].astype(np.uint64) * P1), 23) * P2 + P3
    at[rows] += 4
    left[rows] -= 4
    for _ in range(3):
        rows = np.flatnonzero((left >= 1) & (sizes < 32))
        out[rows] = rotated(out[rows] ^ (buffer[at[rows]].astype(np.uint64) * P5), 11) * P1
        at[rows] += 1
        left[rows] -= 1
    out = (out ^ (out >> np.uint64(33))) * P2
    out = (out ^ (out >> np.uint64(29))) * P3
    out ^= out >> np.uint64(32)
    view = memoryview(buffer)
    for k in np.flatnonzero(sizes >= 32).tolist():
        out[k] = xxhash.xxh64_intdigest(view[starts[k] : starts[k] + sizes[k]])
    return out


def same_bytes(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the stretches at ``a`` and ``b``, of equal sizes, hold the same bytes."""
    same = np.ones(len(a), bool)
    eights = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))
    rows = np.arange(len(a))
    done = 0
    while len(rows):
        left = sizes[rows] - done
        # The last bytes that count, of the eight read here.
        unread = (8 - np.minimum(left, 8)).astype(np.uint64) * np.uint64(8)
        differ = (eights[a[rows] + done] ^ eights[b[rows] + done]) << unread
        same[rows[differ != 0]] = False
        rows = rows[(differ == 0) & (left > 8)]
        done += 8
    return same


class Interned:
    """Open-addressed table of the distinct n-grams of a batch.

    ``slots`` gives each occurrence's slot; ``filled`` the slots in use; ``bucket`` and ``count`` what they store.
    """

    def __init__(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, buckets: int, digest=hashes):
        keys = digest(buffer, starts, sizes)
        capacity = 1 << max(4, int(2 * len(starts)).bit_length())
        mask = np.uint64(capacity - 1)
        # The occurrence whose bytes a slot holds, or none.
        owner = np.full(capacity, -1, np.int64)
        self.slots = np.empty(len(starts), np.int64)
        waiting = np.arange(len(starts))
        place = (keys & mask).astype(np.int64)
        while len(waiting):
            free = owner[place] < 0
            # Of several that claim a free slot one is the last to write and owns it.
            owner[place[free]] = waiting[free]
            held = owner[place]
            match = (keys[held] == keys[waiting]) & (sizes[held] == sizes[waiting])
            known = match & (held != waiting)
            match[known] = same_bytes(buffer, starts[held[known]], starts[waiting[known]], sizes[waiting[known]])
            self.slots[waiting[match]] = place[match]
            waiting, place = waiting[~match], (place[~match] + 1) & (capacity - 1)
        self.filled = np.flatnonzero(owner >= 0)
        view = memoryview(buffer)
        first = starts[owner[self.filled]]
        stretches = zip(first.tolist(), (first + sizes[owner[self.filled]]).tolist())
        self.bucket = np.zeros(capacity, np.int64)
        self.bucket[self.filled] = [zlib.crc32(view[a:b]) % buckets for a, b in stretches]
        self.count = np.bincount(self.slots, minlength=capacity)


class Batch:
    """N-grams of some texts or parts of texts: ``row`` of each occurrence, its stretch of ``buffer``, words of each row."""

    def __init__(self, parts: list[tuple[int, bytes, int]], rows: int, longest: int):
        words = [part.translate(WORD_BYTES).split() for _, part, _ in parts]
        laid = b" ".join([b" ".join(w) for w in words if w])
        self.buffer = np.frombuffer(laid + bytes(8), np.uint8)
        counts = np.array([len(w) for w in words], np.int64)
        ends = np.flatnonzero(self.buffer[: len(laid)] == 32)
        ends = np.append(ends, len(laid)) if laid else ends
        starts = np.concatenate([[0], ends[:-1] + 1]) if laid else ends
        part_of = np.repeat(np.arange(len(parts)), counts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        place = np.arange(len(starts)) - first
        led = np.array([lead for _, _, lead in parts], np.int64)[part_of]
        row = np.array([r for r, _, _ in parts], np.int64)[part_of]
        found = []
        for n in range(longest):
            # A run of n + 1 words belongs to the part in which it ends.
            last = np.flatnonzero((place >= n) & (place >= led))
            found.append((row[last], starts[last - n], ends[last] - starts[last - n]))
        self.words = np.bincount(found[0][0], minlength=rows)
        self.row, self.starts, self.sizes = (np.concatenate(x) for x in zip(*found))


NOT_WORD = re.compile(rb"[\x00-/:-`{-\x7f]")


def parts_of(text: bytes, row: int, longest: int, limit: int = BATCH_BYTES) -> Iterator[tuple[int, bytes, int]]:
    """A text in parts of about ``limit`` bytes, cut between words: row, bytes and number of first words known from before."""
    at, context = 0, []
    while at < len(text) or not at:
        stop = len(text)
        if stop - at > limit:
            gap = NOT_WORD.search(text, at + limit)
            stop = gap.end() if gap else stop
        part = text[at:stop].lower()
        yield row, b" ".join([*context, part]), len(context)
        at = stop
        if at >= len(text):
            return
        context = (context + part.translate(WORD_BYTES).split())[1 - longest :] if longest > 1 else []


def batches_of(array: pa.Array, longest: int, limit: int) -> Iterator[tuple[int, int, Batch]]:
    """First row, number of rows, and n-grams of consecutive parts of a column of texts; a long text comes in several."""
    start = 0
    for part in byte_slices(array, limit):
        held = texts(part)
        if len(held) == 1:
            for piece in parts_of(held[0], 0, longest, limit):
                yield start, 1, Batch([piece], 1, longest)
        else:
            yield start, len(held), Batch([(k, t, WHOLE) for k, t in enumerate(held)], len(held), longest)
        start += len(held)


def bucket_counts(
    docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """``bucket`` and ``n``, the occurrences of its features in all texts. A task sends one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in batches_of(batch.column(0), longest, batch_bytes):
                kept = Interned(found.buffer, found.starts, found.sizes, buckets)
                # Bins of weights are doubles, exact up to 2^53 occurrences in a batch.
                total += np.bincount(kept.bucket[kept.filled], kept.count[kept.filled], buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counted = docs.select(raw(text).alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(counted: DataFrame, wanted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket: a thousand times the log of its share in the target over its share in the corpus, floored."""

    def dense(counts: DataFrame) -> np.ndarray:
        # One row a bucket at most.
        out = np.zeros(buckets, np.int64)
        rows = counts.toArrow()
        out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
        return out

    s, t = dense(counted), dense(wanted)
    above = (t + 1.0) * float(s.sum() + buckets)
    below = (s + 1.0) * float(t.sum() + buckets)
    return np.floor(1000.0 * np.log(above / below)).astype(np.int64)


FOUND = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("gain", pa.int64())])


def gathered(text: str | Column, gain: np.ndarray, longest: int = LONGEST, batch_bytes: int = BATCH_BYTES) -> Column:
    """Words, features and sum of gains of a text."""
    buckets = len(gain)

    @F.arrow_udf("struct<n_words: bigint, n_features: bigint, gain: bigint>")
    def gather(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            words, features, sums = (np.zeros(len(batch), np.int64) for _ in range(3))
            for start, rows, found in batches_of(batch, longest, batch_bytes):
                kept = Interned(found.buffer, found.starts, found.sizes, buckets)
                each = gain[kept.bucket][kept.slots]
                where = slice(start, start + rows)
                words[where] += found.words
                features[where] += np.bincount(found.row, minlength=rows)
                # Sums of whole numbers below 2^53 are exact in doubles.
                sums[where] += np.bincount(found.row, each, rows).astype(np.int64)
            yield pa.StructArray.from_arrays([pa.array(x) for x in (words, features, sums)], fields=list(FOUND))

    return gather(raw(text))


def floor_div(a: str, b: str) -> Column:
    """Quotient rounded down; 0 where the divisor is."""
    short = F.when(F.expr(f"{a} % {b} < 0"), 1).otherwise(0)
    return F.when(F.col(b) == 0, 0).otherwise(F.expr(f"{a} div nullif({b}, 0)") - short).cast("long")


def resampled(
    docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", percent: int = DRAWN_PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Per row: doc_id, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn).

    ``weight`` is the floored mean gain of the features, 0 without any. ``score`` adds Gumbel noise that depends on the
    seed and the id only, so the ``percent`` best of the texts with ``least_words`` words or more are a sample without
    replacement by weight. Ties go to the smaller id, rows without id last; equal rows are ranked in any order.
    Null texts have no words; rows of one id, or of none, are rows of their own. Without a target all gains
    favour rare features; an empty corpus gives no rows. Other columns are ignored.
    """
    counted = bucket_counts(docs, text, buckets, longest, batch_bytes)
    wanted = bucket_counts(target, target_text, buckets, longest, batch_bytes)
    gain = gains(counted, wanted, buckets)
    found = docs.select("doc_id", gathered(text, gain, longest, batch_bytes).alias("found")).select("doc_id", "found.*")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = found.withColumn("weight", floor_div("gain", "n_features")).withColumn("score", F.col("weight") + noise)
    # Stored with a number of its own each, so that rows alike in score and id can be told apart and spread.
    stored = cut_lineage(weighed.drop("gain").withColumn("_row", F.monotonically_increasing_id()))
    enough = stored.where(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    most = percent * enough.count() // 100
    placed = numbered(enough, order, "rank")
    short = stored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    rank = F.when(F.col("rank") <= most, F.col("rank")).alias("rank")
    return placed.unionByName(short).select("doc_id", "n_words", "n_features", "weight", "score", rank)


def op12_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Documents drawn towards the distribution of the benchmark's texts."""
    drawn = resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by its eight shifts a byte, once for each byte value; features by position, gains by bucket.
ORACLE = r"""
WITH RECURSIVE shifted(v, c, k) AS (
    SELECT range, range, 0 FROM range(256)
    UNION ALL
    SELECT v, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM shifted WHERE k < 8
),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY v) AS crcs FROM shifted WHERE k = 8),
spoken AS (
    SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
    UNION ALL
    SELECT 't', row_number() OVER (), item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
    FROM benchmark
),
texts AS MATERIALIZED (SELECT * FROM spoken),
occurrences AS (
    SELECT side, r, unnest(words) AS feature FROM texts
    UNION ALL
    SELECT side, r, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM texts
),
counted AS MATERIALIZED (SELECT side, r, feature, count(*) AS n FROM occurrences GROUP BY ALL),
bytes AS (
    SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM counted)
),
bucketed AS MATERIALIZED (
    SELECT feature,
           xor(4294967295, list_reduce(
               list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
               lambda c, b: xor(c // 256, crcs[xor(c, b) % 256 + 1]), 4294967295)) % 10000 AS bucket
    FROM bytes, crc_table
),
sums AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t
    FROM counted JOIN bucketed USING (feature) GROUP BY bucket
),
totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sums),
gains AS (
    SELECT bucket,
           floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain
    FROM sums, totals
),
gained AS (
    SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS gain
    FROM counted JOIN bucketed USING (feature) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r
),
scored AS (
    SELECT id AS doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
           CASE WHEN n_features IS NULL THEN 0 ELSE ((gain - ((gain % n_features) + n_features) % n_features) // n_features) END::BIGINT AS weight,
           ('0x' || substr(sha256('7:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM texts LEFT JOIN gained USING (r) WHERE side = 'd'
),
noisy AS (
    SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored
),
placed AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST) AS place,
           25 * count(*) OVER () // 100 AS most
    FROM noisy WHERE n_words >= 20
)
SELECT n.doc_id, n.n_features, n.weight, n.score, CASE WHEN p.place <= p.most THEN p.place END AS rank
FROM noisy n LEFT JOIN placed p ON n.doc_id = p.doc_id
"""
