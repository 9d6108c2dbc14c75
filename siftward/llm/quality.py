"""Operator 10: quality rules with line labels by a conditional random field.

Base rules count symbols, repeated lines and words in repeated windows. Texts that pass them are
labelled line by line; the share of words in content lines decides. Everything is one
Arrow function over whole texts, without a shuffle.

The field is fitted on a bounded, documented sample of documents with a quality label: in a
good document the lines are content, save those equal to an earlier one; in a bad document
none is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftward.llm.common import byte_slices, cut_lineage, one_row_each, raw, table, texts, within
from siftward.llm.line_crf import SYMBOLS, LineField, line_masks

#: Labelled documents of each kind for the fit, and lines of them all; the only bounds in this operator.
SAMPLE_DOCUMENTS, SAMPLE_LINES = 1500, 400_000
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Least share (per cent) of words in content lines.
CONTENT_SHARE = 50
SPACE = b" \t\n\v\f\r"

FOUND = (
    "n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, "
    "n_repeat_words: bigint, n_content_words: bigint"
)


def lines_of(text: bytes) -> list[tuple[bytes, list[bytes], bool]]:
    """Lines with a word: bytes, words, and whether an earlier line is equal."""
    out, seen = [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            out.append((line, words, line in seen))
            seen.add(line)
    return out


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more. Windows are compared by exact ranks, doubled in length."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ranks = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == n:
        return 0
    size = 1
    while size < window:
        add = min(size, window - size)
        pairs = ranks[: len(ranks) - add] * (n + 1) + ranks[add:]
        distinct, ranks = np.unique(pairs, return_inverse=True)
        size += add
        if len(distinct) == len(ranks):
            return 0
    twice = np.bincount(ranks)[ranks] > 1
    change = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int((np.cumsum(change) > 0).sum())


def measures(text: bytes, field: LineField) -> dict[str, int]:
    lines = lines_of(text)
    words = text.split()
    labels = field.decode(line_masks(lines))
    return {
        "n_words": len(words),
        "word_chars": len(text.translate(None, SPACE).decode("utf-8", "replace")),
        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": sum(seen for _, _, seen in lines),
        "n_repeat_words": repeated_words(words),
        "n_content_words": sum(len(w) for (_, w, _), y in zip(lines, labels) if y),
    }


def sampled(docs: DataFrame, labels: DataFrame, documents: int) -> DataFrame:
    """Texts and labels of at most so many documents of each quality, those first by a hash of the id.

    A document labelled more than once counts as good only if every label says so. Of several rows of an id one is
    taken (``one_row_each``).
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    parts = [
        known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents) for q in (0, 1)
    ]
    ids = parts[0].unionByName(parts[1])
    # At most two times ``documents`` ids.
    return one_row_each(docs, ids)


def fit_field(docs: DataFrame, labels: DataFrame, documents: int = SAMPLE_DOCUMENTS, lines: int = SAMPLE_LINES) -> LineField:
    """The field for these documents; without labels one that calls every line content.

    Documents are taken in the order of a hash of their ids until they have ``lines`` lines; longer ones are left out.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for part in byte_slices(batch.column("text")):
                good = batch.column("quality").slice(start, len(part)).to_pylist()
                start += len(part)
                masks, wanted = [], []
                for text, quality in zip(texts(part), good):
                    lines = lines_of(text)
                    masks.append(line_masks(lines))
                    wanted.append([int(quality > 0 and not seen) for _, _, seen in lines])
                columns = [pa.array(masks, pa.list_(pa.int32())), pa.array(wanted, pa.list_(pa.int32()))]
                ids = batch.column("doc_id").slice(start - len(part), len(part)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "masks", "wanted"])

    rows = sampled(docs, labels, documents).select("doc_id", "text", "quality")
    described = cut_lineage(rows.mapInArrow(describe, "doc_id long, masks array<int>, wanted array<int>"))
    described = described.withColumn("size", F.size("masks"))
    found = within(described, "size", lines, F.xxhash64("doc_id"), F.col("doc_id")).select("masks", "wanted").toArrow()
    masks = [np.asarray(x, np.int64) for x in found.column("masks").to_pylist()]
    wanted = [np.asarray(x, np.int64) for x in found.column("wanted").to_pylist()]
    return LineField.fit(masks, wanted)


def quality(spark: SparkSession, text: str | Column, field: LineField) -> Column:
    """The measures of a text as a struct; a null text has no words."""
    weights, step = field.weights, field.step

    @F.arrow_udf(f"struct<{FOUND}>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = LineField(weights, step)
        for batch in batches:
            yield pa.array([measures(t, model) for part in byte_slices(batch) for t in texts(part)], ARROW_FOUND)

    return measured(raw(text))


ARROW_FOUND = pa.struct([(x.split(":")[0].strip(), pa.int64()) for x in FOUND.split(",")])


def with_verdict(docs: DataFrame, field: LineField, text: str = "text", share: int = CONTENT_SHARE) -> DataFrame:
    """Per row: doc_id, the measures, ``base_failed`` and ``kept``; one row for each row, whatever its id.

    ``base_failed``: fewer than 20 words, or over 30 per cent of them in repeated windows.
    ``kept``: not that, and at least ``share`` per cent of the words in content lines.
    """
    found = docs.select("doc_id", quality(docs.sparkSession, text, field).alias("found")).select("doc_id", "found.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    content = 100 * F.col("n_content_words") >= share * F.col("n_words")
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & content)


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return with_verdict(docs, fit_field(docs, table(spark, folder, "labels")))
