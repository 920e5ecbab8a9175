"""A training-data pipeline over the documents table, stage by stage.

Every stage takes (spark, docs, folder) and returns a DataFrame, which is written and read again as the next one's
documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayframe.llm import jaccard, line_dedup, mixing, packing, quality
from assayframe.llm.common import documents
from assayframe.session import store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Quality rules: failing lines go, then documents that fail the base rules or lost too much."""
    return quality.clean(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Line dedup: lines equal or near to an earlier one go, and documents left without words."""
    return line_dedup.without_repeats(docs, line_dedup.LEAST_WORDS, line_dedup.LEAST_NEAR_WORDS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """N-gram Jaccard join on five words at 0.8: the first document of each class stays."""
    return jaccard.one_of_each(docs, gram_words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Mixing: documents in the amounts that the sources' target weights ask for."""
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Packing: the pieces of all documents in sequences of equal length."""
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", clean_lines),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the mix's draws or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if i < len(STAGES) - 1:
            docs = store(docs)
    return docs
