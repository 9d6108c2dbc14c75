"""Corpus pipeline: stages in order, each written as Parquet and read again as the next one's input.

All stages but the last return the columns of ``documents``; the last returns a digest of
each document's token ids, read back from the files it wrote. Nulls, empty and repeated rows are
treated as the operators' docstrings say; an empty table goes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftward.llm.common import cut_lineage, table
from siftward.llm.decontamination import decontaminated
from siftward.llm.mixing import Mix, mixed_documents
from siftward.llm.simhash import one_of_each_group
from siftward.llm.token_store import store_tokens
from siftward.llm.toxicity import train, without_toxic

#: As many tokens as come in. Sources are levelled towards nine tenths of the greatest entropy, as far as none has to be
#: passed over more than twice: scarce sources are repeated up to that and cannot cut the others.
MIX = Mix(entropy=0.9, repeats=2.0)
TOKENIZER = "word_bpe_49k.json"
#: Workers still hold memory of the stages before, so they keep fewer words and stems than the operator's own.
CACHE = (100_000, 300_000)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go; it is fitted on the labelled ones among them."""
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's part of the mixture; a document is a row for each time it is taken."""
    return mixed_documents(docs, MIX)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary shards; the rows are read from them."""
    return store_tokens(docs, public_tokenizers.path(TOKENIZER), CACHE)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixture", source_mixture),
    ("token_ids", token_ids),
]

#: The stages need a fitted classifier and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
