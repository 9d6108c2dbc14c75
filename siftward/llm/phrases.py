"""Operator 13: phrase collocations by Toivonen's sampling.

1. A sample of the documents (by a hash of the text) is counted at a lowered threshold and proposes a family of
   frequent phrases.
2. A full pass counts the family and its negative border exactly: every phrase whose shorter parts are all in the family, so
   all words, pairs of proposed words, and triples of proposed pairs.
3. Border phrases that turn out frequent are failures of the proposal. They join the family, and a further full pass
   counts just the phrases that have thereby come to its border, until no failure is left. Every phrase with
   all parts frequent has then been counted over all documents, so the result does not depend on the sample.

The family may grow with the corpus and so is never sent anywhere whole. Tasks get a Bloom filter of fixed size: it misses no
phrase of the family, and one it wrongly holds only makes the border counted wider. A later filter holds all bits of the
one before, so "on the border now and not before" is exact and no phrase is counted in two passes.

Counts are summed in each batch and task before they are exchanged.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftward.llm.common import cut_lineage, raw, table

LONGEST = 3
LEAST_COUNT = 10
#: A candidate inside a longer one that has at least this share (per cent) of its occurrences is dropped.
CONTAINED_PERCENT = 50
TOP = 2000
#: Parts of a language whose best phrases are found apart.
TOP_PARTS = 16
MILLION = 1_000_000
UNKNOWN = "und"
#: One document in so many is in the sample, which takes for frequent what occurs so often in it.
SAMPLE_ONE_IN, SAMPLE_COUNT = 8, 2
#: Size of a filter, 8 MiB, sent to each executor; bits set for a phrase.
FILTER_BITS, FILTER_HASHES = 1 << 26, 2
#: Text taken at once in a task, and phrases of it spelt out at once.
BATCH_BYTES, GIVEN_OUT = 3 << 20, 50_000

#: Lower case for A-Z, a line feed for all that ends a piece, a blank for a tab.
PIECE_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256)
)
GAP = re.compile(rb"[ \n]")
END, NOTHING = b"\n", b""


class Filter:
    """Bloom filter over hashes of words and pairs with their language; travels as an array of 64-bit words.

    The number of bits is a power of two.
    """

    def __init__(self, words: np.ndarray | None = None, bits: int = FILTER_BITS):
        self.words = np.zeros(bits // 64, np.uint64) if words is None else words
        self.bits = 64 * len(self.words)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
        steps = np.arange(FILTER_HASHES, dtype=np.uint64)[:, None]
        return (low + steps * (high | np.uint64(1))) & np.uint64(self.bits - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        places = self.places(hashes)
        return ((self.words[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1)).all(0)

    def add(self, hashes: np.ndarray) -> None:
        places = self.places(hashes).ravel()
        np.bitwise_or.at(self.words, places >> np.uint64(6), np.uint64(1) << (places & np.uint64(63)))


def word_hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh3_64_intdigest(lang)
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of pairs by the hashes of their words, so that a pair need not be spelt out."""
    mixed = (first ^ (second * np.uint64(0x9E3779B97F4A7C15) + (second >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(31))


def parts_of(text: bytes, limit: int = BATCH_BYTES) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about ``limit`` bytes, and how many first words of a part belong to the one before.

    Pieces stay whole where one ends within a part; a longer one is cut between words.
    """
    text = text.translate(PIECE_BYTES)
    at, context = 0, []
    while len(text) - at > limit:
        stop = text.rfind(END, at, at + limit) + 1
        if not stop or stop <= at:
            gap = GAP.search(text, at + limit)
            if not gap:
                break
            stop = gap.end()
        part = text[at:stop]
        yield b" ".join([*context, part]), len(context)
        open_words = part[part.rfind(END) + 1 :].split(b" ") if END in part else [*context, *part.split(b" ")]
        context = [w for w in open_words if w][1 - LONGEST :]
        at = stop
    yield b" ".join([*context, text[at:]]), len(context)


def batches_of(langs: list, held: Iterator, limit: int = BATCH_BYTES) -> Iterator[tuple[bytes, bytes, int]]:
    """Language, text and context of bounded batches: short texts of one language together, parts of long ones alone."""
    waiting: dict[bytes, list[bytes]] = defaultdict(list)
    sizes: dict[bytes, int] = defaultdict(int)
    for lang, value in zip(langs, held):
        lang = UNKNOWN.encode() if lang is None else lang
        text = value.as_buffer().to_pybytes() if value.is_valid else b""
        if len(text) > limit:
            for part, context in parts_of(text, limit):
                yield lang, part, context
            continue
        waiting[lang].append(text)
        sizes[lang] += len(text)
        if sizes[lang] > limit:
            yield lang, END.join(waiting.pop(lang)).translate(PIECE_BYTES), 0
            sizes[lang] = 0
        elif sum(sizes.values()) > 2 * limit:
            lang = max(sizes, key=sizes.get)
            yield lang, END.join(waiting.pop(lang)).translate(PIECE_BYTES), 0
            sizes[lang] = 0
    for lang, some in waiting.items():
        yield lang, END.join(some).translate(PIECE_BYTES), 0


def counted_batch(
    lang: bytes, text: bytes, context: int, now: Filter | None, before: Filter | None
) -> Iterator[tuple[list[bytes], int, np.ndarray]]:
    """Phrases, their length and counts in a batch: those on the border of ``now`` that were not on that of ``before``.

    Without ``now`` only words are counted. Pairs and triples are numbers until they are given out, some at a time.
    """
    tokens = pc.split_pattern(pa.array([text.replace(END, b" \n ")], pa.large_binary()), pattern=b" ").flatten()
    words = tokens.dictionary_encode()
    ids, spelt = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
    del tokens, words
    # What is no word: the end of a piece, and nothing between two blanks.
    none = [k for k, w in enumerate(spelt) if w in (END, NOTHING)]
    ids = ids[ids != next((k for k in none if spelt[k] == NOTHING), -1)]
    own = np.ones(len(ids), bool)
    # Words known from the part before; nothing else is in front of them.
    own[:context] = False

    if before is None:
        times = np.bincount(ids[own], minlength=len(spelt))
        times[none] = 0
        used = np.flatnonzero(times)
        for k in range(0, len(used), GIVEN_OUT):
            part = used[k : k + GIVEN_OUT]
            yield [spelt[w] for w in part.tolist()], 1, times[part]
    if now is None or len(ids) < 2:
        return

    hashes = word_hashes(lang, spelt)
    word_now = now.holds(hashes)
    word_before = before.holds(hashes) if before else np.zeros(len(spelt), bool)
    word_now[none] = word_before[none] = False
    a, b = ids[:-1], ids[1:]
    eligible, counted = word_now[a] & word_now[b], word_before[a] & word_before[b]
    size = len(spelt)

    def given(codes: np.ndarray, words: int) -> Iterator[tuple[list[bytes], int, np.ndarray]]:
        found, times = np.unique(codes, return_counts=True)
        for k in range(0, len(found), GIVEN_OUT):
            part = found[k : k + GIVEN_OUT]
            ends = [(part // size**n % size).tolist() for n in range(words - 1, -1, -1)]
            yield [b" ".join([spelt[w] for w in phrase]) for phrase in zip(*ends)], words, times[k : k + GIVEN_OUT]

    new = eligible & ~counted & own[1:]
    yield from given(a[new] * size + b[new], 2)

    # Whether each pair, where it stands, is in the family now, and was before.
    pair_now, pair_before = np.zeros(len(a), bool), np.zeros(len(a), bool)
    at = np.flatnonzero(eligible)
    both = pair_hashes(hashes[a[at]], hashes[b[at]])
    pair_now[at] = now.holds(both)
    if before:
        # What the filter does not hold now it did not hold before.
        known = counted[at] & pair_now[at]
        pair_before[at[known]] = before.holds(both[known])
    new = pair_now[:-1] & pair_now[1:] & ~(pair_before[:-1] & pair_before[1:]) & own[2:]
    # Words of a batch are far fewer than two million, so three of them fit 63 bits.
    yield from given((ids[:-2][new] * size + ids[1:-1][new]) * size + ids[2:][new], 3)


def border_counts(
    docs: DataFrame, now: Filter | None, before: Filter | None, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """``lang``, ``phrase``, ``size`` and exact ``n`` of all phrases that are on the border of ``now`` only."""
    context = docs.sparkSession.sparkContext
    shared = [None if f is None else context.broadcast(f.words) for f in (now, before)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [None if s is None else Filter(s.value) for s in shared]
        for batch in batches:
            held = batches_of(batch.column("lang").to_pylist(), iter(batch.column("text")), batch_bytes)
            for lang, text, known in held:
                for phrases, size, counts in counted_batch(lang, text, known, *filters):
                    columns = [pa.array([lang] * len(phrases), pa.binary()), pa.array(phrases, pa.binary())]
                    columns += [pa.array(np.full(len(phrases), size, np.int32)), pa.array(counts)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "size", "n"])

    rows = docs.select(F.col("lang").cast("string").cast("binary").alias("lang"), raw("text").alias("text"))
    counted = rows.mapInArrow(count, "lang binary, phrase binary, size int, n long")
    return counted.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def filter_of(phrases: DataFrame, base: Filter | None) -> Filter:
    """A filter that holds these phrases and all that ``base`` holds. Each task sends the words of its bits only."""
    bits = base.bits if base else FILTER_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Filter(bits=bits)
        for batch in batches:
            by_lang: dict[bytes, list[bytes]] = defaultdict(list)
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                by_lang[lang].append(phrase)
            for lang, some in by_lang.items():
                words = [p.split(b" ") for p in some]
                first = word_hashes(lang, [w[0] for w in words])
                two = np.array([len(w) == 2 for w in words])
                second = word_hashes(lang, [w[-1] for w in words])
                found.add(np.where(two, pair_hashes(first, second), first))
        used = np.flatnonzero(found.words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int64)), pa.array(found.words[used].view(np.int64))], ["place", "bits"]
        )

    marked = phrases.select("lang", "phrase").mapInArrow(mark, "place long, bits long")
    # At most one row for each 64 bits of the filter.
    rows = marked.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64) if base is None else base.words.copy()
    words[rows.column("place").to_numpy()] |= rows.column("bits").to_numpy().view(np.uint64)
    return Filter(words)


def proposed(docs: DataFrame, one_in: int = SAMPLE_ONE_IN, least: int = SAMPLE_COUNT) -> Filter:
    """The family a sample proposes: phrases frequent in it whose parts are so too, level by level."""
    sample = docs.where(F.pmod(F.xxhash64("lang", raw("text")), F.lit(one_in)) == 0)
    words = border_counts(sample, None, None).where(F.col("n") >= least)
    family = filter_of(words, None)
    # The border of the frequent words is all pairs of them; triples wait for the full pass.
    pairs = border_counts(sample, family, None).where((F.col("size") == 2) & (F.col("n") >= least))
    return filter_of(pairs, family)


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT,
    one_in: int = SAMPLE_ONE_IN, sample_count: int = SAMPLE_COUNT, batch_bytes: int = BATCH_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to three words with ``least`` occurrences or more, with their exact ``n``; and words by language.

    ``lang`` and ``phrase`` are bytes. Null texts are empty, null languages ``und``.
    """
    docs = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    before, now = None, proposed(docs, one_in, sample_count)
    found: list[DataFrame] = []
    totals = None
    while True:
        counted = border_counts(docs, now, before, batch_bytes)
        if totals is None:
            counted = cut_lineage(counted.where((F.col("size") == 1) | (F.col("n") >= least)))
            totals = cut_lineage(counted.where("size = 1").groupBy("lang").agg(F.sum("n").alias("n")))
            frequent = counted.where(F.col("n") >= least)
        else:
            frequent = cut_lineage(counted.where(F.col("n") >= least))
        found.append(frequent)
        # Triples have nothing longer on their border.
        parts = frequent.where(F.col("size") < LONGEST)
        wider = filter_of(parts, now)
        if (wider.words == now.words).all():
            break
        before, now = now, wider
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return cut_lineage(whole), totals


def cuts(size: int) -> list[int]:
    return list(range(1, size))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, top: int = TOP,
    contained: int = CONTAINED_PERCENT, one_in: int = SAMPLE_ONE_IN, sample_count: int = SAMPLE_COUNT, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are split at blanks and tabs within pieces between punctuation or line ends, lower case for A-Z. A phrase's score
    is a million times a^2 / (l * r), floored, of its lowest-scoring cut, with l and r the counts of the parts. A
    candidate inside a longer one with at least ``contained`` per cent of its count is dropped. An empty table,
    or one without a phrase often enough, gives no rows. Repeated rows count each time; ids and other columns are ignored.
    """
    phrases, totals = frequent_phrases(docs, text, lang, least, one_in, sample_count, batch_bytes)
    words = F.split(F.col("phrase").cast("string"), " ")
    candidates = phrases.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("words"))

    def joined(start: int, length: Column | int) -> Column:
        return F.array_join(F.slice("words", start, length), " ").cast("binary")

    sides = [
        F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), (joined(1, k) if side == "l" else joined(k + 1, LONGEST)).alias("part"))
        for k in cuts(LONGEST) for side in ("l", "r")
    ]
    parts = candidates.select("lang", "phrase", "size", "a", F.inline(F.array(*sides))).where("k < size")
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("n_part"))
    # Every part of a frequent phrase is frequent, so all are found.
    valued = parts.join(known, ["lang", "part"]).groupBy("lang", "phrase", "size", "a", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("n_part"))).alias("l"),
        F.max(F.when(F.col("side") == "r", F.col("n_part"))).alias("r"),
    )
    # Whole numbers of 38 digits: exact for counts below 10^16.
    wide = {c: F.col(c).cast("decimal(19,0)").cast("decimal(38,0)") for c in ("a", "l", "r")}
    ratio = F.expr("(a_ * a_ * 1000000BD) div (l_ * r_)")
    scored = valued.withColumns({f"{c}_": v for c, v in wide.items()}).withColumn("score", ratio.cast("long"))
    lowest = scored.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = lowest.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")
    inside = candidates.where(F.col("size") == LONGEST).select(
        "lang", F.explode(F.array_distinct(F.array(joined(1, 2), joined(2, 2)))).alias("phrase"), F.col("a").alias("longer")
    )
    longest = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(longest, ["lang", "phrase"], "left").where(
        (F.col("size") == LONGEST) | F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a"))
    )
    # The best of each part of a language first, so that few rows of it meet in one task, however many parts came before.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)))
    for key in (["lang", "part"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        parted = parted.withColumn("rank", place).where(F.col("rank") <= top)
    best = parted
    return best.join(totals, "lang").select(
        F.col("lang").cast("string").alias("lang"), F.col("rank").cast("long").alias("rank"),
        F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score",
    )


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


ORACLE = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
spoken AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
occurrences AS (
    SELECT lang, 1 AS size, unnest(words) AS phrase FROM spoken
    UNION ALL
    SELECT lang, 2, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM spoken
    UNION ALL
    SELECT lang, 3, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))
    FROM spoken
),
counted AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM occurrences GROUP BY ALL),
candidates AS MATERIALIZED (
    SELECT lang, size, phrase, string_split(phrase, ' ') AS words, f AS a FROM counted WHERE size > 1 AND f >= 10
),
parts AS (
    SELECT lang, size, phrase, a, k, array_to_string(words[1:k], ' ') AS lp, array_to_string(words[k + 1:], ' ') AS rp
    FROM candidates, range(1, 3) AS cuts(k) WHERE k < size
),
valued AS (
    SELECT p.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * p.a * p.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM parts p JOIN counted x ON x.lang = p.lang AND x.phrase = p.lp AND x.size = k
    JOIN counted y ON y.lang = p.lang AND y.phrase = p.rp AND y.size = p.size - k
),
lowest AS (
    SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
inside AS (
    SELECT lang, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase, a AS longer
    FROM candidates WHERE size = 3
),
dropped AS (
    SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN inside i USING (lang, phrase) WHERE 100 * i.longer >= 50 * c.a
),
placed AS (
    SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase ASC) AS rank
    FROM lowest ANTI JOIN dropped USING (lang, phrase)
),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN totals USING (lang) WHERE rank <= 2000
"""
