"""The named queries of the corpus operators: (spark, folder) -> DataFrame, each over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from assayframe.llm import (
    conversation_repair, embedding_dedup, exact_dedup, filter_audit, jaccard, licenses, line_dedup, mixing, packing, quality, secrets, suffix_dedup,
    token_files,
)
from assayframe.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def over(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(documents(spark, folder))


def over_table(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(spark.read.parquet(f"{folder}/{name}.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_dedup": over(suffix_dedup.dedup),
        "op2_mixing": over(mixing.mixed_documents),
        "op3_licenses": over(licenses.find_licenses),
        "op4_quality": over(quality.judge),
        "op5_line_dedup": over(lambda docs: line_dedup.repeated_lines(docs, line_dedup.LEAST_WORDS, line_dedup.LEAST_NEAR_WORDS)),
        "op6_token_files": over(token_files.token_files),
        "op7_exact_dedup": over(exact_dedup.exact_duplicates),
        "op8_jaccard": over(jaccard.near_duplicates),
        "op9_packing": over(packing.packed_documents),
        "op10_secrets": over(secrets.find_secrets),
        "op11_embedding_dedup": over_table("embeddings", embedding_dedup.near_vectors),
        "op12_conversation_repair": over_table("conversations", conversation_repair.repaired_conversations),
        "op13_filter_audit": filter_audit.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": exact_dedup.ORACLE_SQL, "op11_embedding_dedup": embedding_dedup.ORACLE_SQL,
            "op13_filter_audit": filter_audit.ORACLE_SQL}
