"""Operator 1: token counts by batch encoding in an Arrow function that returns lengths only.

Long texts are split at safe boundaries: a blank, or other white space, with no white space
before it. The tokenizer starts a new piece there whatever stands to the left, so the
counts of the pieces add up to the count of the text. Pieces repeat, so each is encoded once
and its length remembered within bounds; batches for the encoder are balanced by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftward.llm.common import byte_slices, raw, table, texts
from siftward.llm.encoding import (
    PIECE,
    Cache,
    chunks,
    for_worker,
    safe_blanks,
    splits_at_blanks,
    vocabulary,
)

CONTEXT_TOKENS = 1024


class Lengths:
    """Token counts of texts with one tokenizer, without begin, end or added tokens."""

    def __init__(self, encoder, split: bool):
        self.encoder, self.split = encoder, split
        self.plain = Cache(self.encoded)
        self.after_blank = Cache(lambda parts: self.encoded([b" " + p for p in parts]))

    def encoded(self, pieces: list[bytes]) -> list[int]:
        batch = [p.decode("utf-8", "replace") for p in pieces]
        return [len(x.ids) for x in self.encoder.encode_batch_fast(batch, add_special_tokens=False)]

    def count(self, batch: list[bytes]) -> list[int]:
        if not self.split:
            return self.encoded(batch)
        totals = [0] * len(batch)
        parts: list[tuple[int, list[bytes]]] = []
        heads: list[tuple[int, bytes]] = []
        held = 0
        for i, text in enumerate(batch):
            if not text:
                continue
            if safe_blanks(text):
                for chunk in chunks(text):
                    part = chunk.split(b" ")
                    heads.append((i, part[0]))
                    parts.append((i, part))
                    held += len(chunk)
                    if held > 4 << 20:
                        self.add(totals, heads, parts)
                        held = 0
            else:
                pieces = (m.group().encode() for m in PIECE.finditer(text.decode("utf-8", "replace")))
                while some := list(islice(pieces, 200_000)):
                    known = self.plain.of(set(some))
                    totals[i] += sum(map(known.__getitem__, some))
        self.add(totals, heads, parts)
        return totals

    def add(self, totals: list[int], heads: list, parts: list) -> None:
        known = self.plain.of({h for _, h in heads if h})
        for i, head in heads:
            totals[i] += known[head] if head else 0
        known = self.after_blank.of(set().union(*(islice(p, 1, None) for _, p in parts)))
        for i, part in parts:
            totals[i] += sum(map(known.__getitem__, islice(part, 1, None)))
        heads.clear()
        parts.clear()


def token_count(spark: SparkSession, text: str | Column, path: str) -> Column:
    """Number of tokens of a text column by the tokenizers file at ``path``; null counts as empty."""
    source = vocabulary(spark, path)
    split = splits_at_blanks(source.value)

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = for_worker(source, Lengths, split)
        for batch in batches:
            counts: list[int] = []
            for part in byte_slices(batch):
                counts += counter.count(texts(part))
            yield pa.array(counts, pa.int64())

    return lengths(raw(text))


def count_tokens(
    docs: DataFrame, path: str, limit: int = CONTEXT_TOKENS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: key, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit``).

    One row out for each row in, whatever its key: repeated and null keys stay. A null text is
    empty: no bytes, no tokens. Other columns are ignored. Texts of any length are
    read whole; a text without white space is one piece.
    """
    counted = docs.select(
        F.col(key).alias("doc_id"),
        F.octet_length(raw(text)).cast("long").alias("n_bytes"),
        token_count(docs.sparkSession, text, path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
