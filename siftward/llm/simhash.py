"""Operator 3: SimHash near-duplicates by an inverted index on byte positions, with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes, so
they share at least 4 bytes at equal positions. Single bytes would make posting lists of a
256th of all fingerprints each, hence quadratic work. Each fingerprint is therefore posted under
every set of 4 positions with its bytes there (70 postings of 32 bits): exactly the pairs with 4 or
more shared bytes meet. For each pair that meets, shared bytes are tallied, pairs below the minimum
dropped, and the differing bits counted.

Equal fingerprints are one entry. Posting lists with one or two entries, nearly all, are
settled by their counts alone. Short lists are paired by a join. Members of long lists (large groups of
near copies) are not paired: each is posted under every value within 2 bits of it, and two
fingerprints share such a value exactly if they differ in at most 4 bits; all of a value's
members are linked to its smallest, which links the same groups with one link a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftward.llm.common import byte_slices, columns_of, cut_lineage, keyed, met, once, raw, table, texts
from siftward.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
MOST_BITS = 4
BYTES = 8
#: Longer posting lists are linked by common near values instead of pairs.
PAIRED_LIST = 32
CHUNK_SHINGLES = 1 << 16
#: Fingerprints of a task that makes 70 postings, or 2081 near values, of each.
POSTED_ROWS, CROWDED_ROWS = 20_000, 500


class Fingerprints:
    """SimHash of the word shingles of a text: lower case A-Z, repeats counted."""

    def __init__(self, shingle: int = SHINGLE_WORDS, seed: int = SEED):
        import xxhash

        self.shingle, self.seed, self.hash = shingle, seed, xxhash.xxh64_intdigest

    def of(self, text: bytes) -> int:
        """As a signed 64-bit number; 0 without words."""
        words = text.lower().split()
        if not words:
            return 0
        size = min(self.shingle, len(words))
        total = len(words) - size + 1
        ones = np.zeros(64, np.int64)
        for at in range(0, total, CHUNK_SHINGLES):
            stop = min(at + CHUNK_SHINGLES, total)
            parts = (words[at + k : stop + k] for k in range(size))
            seed, digest = self.seed, self.hash
            hashes = [digest(x, seed) for x in map(b" ".join, zip(*parts))]
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little")
            ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
        set_ = np.packbits(2 * ones > total, bitorder="little")
        return int(set_.view("<i8")[0])


def fingerprint(text: str | Column, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> Column:
    """Fingerprint of a text column as a long; of a null or empty text 0."""

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        maker = Fingerprints(shingle, seed)
        for batch in batches:
            yield pa.array([maker.of(t) for part in byte_slices(batch) for t in texts(part)], pa.int64())

    return simhash(raw(text))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def postings(prints: DataFrame, shared: int) -> DataFrame:
    """``fp`` under every set of ``shared`` byte positions: its number and the bytes there."""
    masks = [
        signed(sum(0xFF << 8 * p for p in positions)) for positions in combinations(range(BYTES), shared)
    ]
    keys = F.array(*[
        F.struct(F.lit(k).cast("tinyint").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes"))
        for k, m in enumerate(masks)
    ])
    return prints.select("fp", F.inline(keys))


def shared_bytes(a: str, b: str) -> Column:
    """How many of the 8 positional bytes of two fingerprints are equal."""
    differ = F.col(a).bitwiseXOR(F.col(b))
    equal = [(F.shiftrightunsigned(differ, 8 * k).bitwiseAND(F.lit(0xFF)) == 0).cast("int") for k in range(BYTES)]
    return reduce(lambda x, y: x + y, equal)


def verified(pairs: DataFrame, most_bits: int) -> DataFrame:
    """Pairs (a, b) with enough shared bytes and few enough differing bits."""
    tallied = pairs.where(shared_bytes("a", "b") >= BYTES - most_bits)
    return tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits)


def near_values(prints: DataFrame, bits: int) -> DataFrame:
    """``fp`` under every value that differs from it in at most ``bits`` bits."""
    flips = [signed(sum(1 << b for b in places)) for n in range(bits + 1) for places in combinations(range(64), n)]
    # The table of flips is of a fixed size.
    flip = F.explode(F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: F.col("fp").bitwiseXOR(x)))
    return prints.select("fp", flip.alias("value"))


def spread(prints: DataFrame, rows: int) -> DataFrame:
    """Fingerprints in tasks of about so many: a few MB of them would be a task or two, whatever they become."""
    return prints.repartition(prints.count() // rows + 1, "fp")


def links(prints: DataFrame, most_bits: int = MOST_BITS, paired: int = PAIRED_LIST) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints ``fp`` as all pairs within ``most_bits`` bits would."""
    if most_bits != 4:
        raise ValueError("lists of long groups are built for 4 differing bits")
    posted = postings(spread(prints, POSTED_ROWS), BYTES - most_bits)
    counted = posted.groupBy("c", "bytes").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")
    )
    lists = cut_lineage(counted.where("n > 1"))
    twos = verified(lists.where("n = 2").select("a", "b"), most_bits)
    more = lists.where("n > 2").select("c", "bytes", "n")
    if more.isEmpty():
        return twos
    members = cut_lineage(met(posted, more, ["c", "bytes"]))
    short = members.where(F.col("n") <= paired)
    left = short.select("c", "bytes", F.col("fp").alias("a"))
    right = short.select("c", "bytes", F.col("fp").alias("b"))
    # A row meets at most ``paired`` others.
    pairs = verified(met(left, right, ["c", "bytes"]).where("a < b").select("a", "b"), most_bits)
    crowded = members.where(F.col("n") > paired).select("fp").distinct()
    values = near_values(spread(cut_lineage(crowded), CROWDED_ROWS), most_bits // 2)
    least = values.groupBy("value").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    starred = met(values, cut_lineage(least.select("value", "m")), "value").where("fp <> m")
    return twos.union(pairs).union(starred.select(F.col("m").alias("a"), F.col("fp").alias("b")).distinct())


def rooted(prints: DataFrame) -> DataFrame:
    """``fp`` and ``root``, the smallest fingerprint reached by links, of each distinct fingerprint."""
    entries = cut_lineage(prints.select("fp").distinct())
    roots = cut_lineage(components(links(entries)))
    found = met(entries, roots.withColumnRenamed("node", "fp"), "fp", "left")
    return cut_lineage(found.select("fp", F.coalesce("root", "fp").alias("root")))


def grouped(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, ``fp`` and ``component_id``, the smallest id among all documents reached by links.

    One row for each row. Null ids are never the smallest; a group with null ids only has a null component.
    Texts without words have the fingerprint zero and are one group.
    """
    prints = cut_lineage(docs.select("doc_id", fingerprint(text).alias("fp")))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    known = cut_lineage(met(rooted(prints), least, "fp"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut_lineage(met(known, cut_lineage(smallest), "root").select("fp", "component_id"))
    return met(prints, classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, text: str = "text") -> DataFrame:
    """Of each group the row with the smallest id, or one of its rows where none has an id; columns as they are.

    Rows are told apart by all their columns, so it does not matter whether an id stands on several rows. Which of the
    rows of one id (or without one) stays is decided by a hash; of equal rows it is one.
    """
    rows, key = keyed(docs)
    bare = F.col("doc_id").isNull().alias("bare")
    prints = cut_lineage(rows.select(*(F.col(k).alias(n) for k, n in zip(key, "ab")), "doc_id", bare, fingerprint(text).alias("fp")))
    least = prints.groupBy("fp").agg(F.min(F.struct("bare", "doc_id", "a", "b")).alias("least"))
    known = cut_lineage(met(least, rooted(prints), "fp"))
    smallest = known.groupBy("root").agg(F.min("least").alias("kept"))
    classes = met(known, cut_lineage(smallest), "root").select("fp", "kept.a", "kept.b").toDF("fp", "kept_a", "kept_b")
    marked = met(prints.select("fp", "a", "b"), cut_lineage(classes), "fp")
    stays = (F.col("a") == F.col("kept_a")) & (F.col("b") == F.col("kept_b"))
    others = cut_lineage(marked.where(~stays).select("a", "b").distinct().toDF(*key))
    repeated = marked.where(stays).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
    repeated = cut_lineage(repeated.toDF(*key))
    if repeated.isEmpty():
        return met(rows, others, key, "left_anti").select(*columns_of(docs))
    single = met(rows, others.union(repeated), key, "left_anti")
    return single.select(*columns_of(docs)).union(once(rows, key, repeated).select(*columns_of(docs)))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = grouped(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
