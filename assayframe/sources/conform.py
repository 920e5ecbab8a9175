"""Bring each source to the canonical five columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayframe import schemas as S
from assayframe.functions import numeric as N, text as X
from assayframe.operators import clean, combine


def canonical(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Rename, then keep the canonical columns; the target is kept only when present."""
    out = df.withColumnsRenamed(renames or {})
    return out.select(*S.CONDITIONS, *([S.TARGET] if S.TARGET in out.columns else []))


def paper1(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("smiles").alias(S.SUBJECT), F.col("T").cast("double").alias(S.TEMPERATURE),
        F.lit(None).cast("string").alias(S.ADDITIVE), F.lit(None).cast("double").alias(S.CONCENTRATION),
        F.col("pCMC").alias(S.TARGET),
    )


def paper4(df: DataFrame, *, value: str = "log_cmc_um") -> DataFrame:
    return df.select(
        F.col("String").alias(S.SUBJECT), F.col("T_C").cast("double").alias(S.TEMPERATURE),
        F.lit(None).cast("string").alias(S.ADDITIVE), F.lit(None).cast("double").alias(S.CONCENTRATION),
        N.log_micro_to_neg_log(F.col(f"`{value}`")).alias(S.TARGET),
    )


def expert(df: DataFrame, *, missing_temperature: str = "fill", decimal_comma: bool = True) -> DataFrame:
    """Clean, collapse replicates, keep the canonical columns."""
    rows = clean.clean_replicates(df, missing_temperature=missing_temperature, decimal_comma=decimal_comma)
    return canonical(combine.aggregate_replicates(rows))


def expert_by_drop(df: DataFrame) -> DataFrame:
    """The other policy: rows without target or temperature are dropped, nothing is filled."""
    parsed = df.select(
        F.col("smiles").alias(S.SUBJECT),
        N.parse_number(F.col("temp_raw"), decimal_comma=True).alias(S.TEMPERATURE),
        X.blank_to_null(F.col("additive_raw")).alias(S.ADDITIVE),
        N.parse_number(F.col("conc_raw"), decimal_comma=True).alias(S.CONCENTRATION),
        S.TARGET,
    )
    return clean.drop_null(parsed, [S.TARGET, S.TEMPERATURE])


def flatten_samples(df: DataFrame) -> DataFrame:
    """Nested samples to flat rows; a null additive record gives two null columns."""
    return df.select(
        S.SUBJECT, S.TEMPERATURE, F.col("additive.smiles").alias(S.ADDITIVE),
        F.col("additive.concentration").alias(S.CONCENTRATION),
    )


def nest_samples(df: DataFrame) -> DataFrame:
    record = F.struct(F.col(S.ADDITIVE).alias("smiles"), F.col(S.CONCENTRATION).alias("concentration"))
    return df.select(S.SUBJECT, S.TEMPERATURE, F.when(F.col(S.ADDITIVE).isNotNull(), record).alias("additive"))


def inline_samples(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A handful of nested samples given in code, flattened."""
    return flatten_samples(spark.createDataFrame(rows, S.NESTED_SAMPLE_SCHEMA))
