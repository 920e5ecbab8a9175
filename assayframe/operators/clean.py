"""Cleaning, filtering and the row-count audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayframe import schemas as S
from assayframe.functions import numeric as N, text as X

REQUIRED_RAW = ["tail_raw", "molecular_weight", "surfactant_type"]


def drop_null(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(subset))


def incomplete(present: Column, required: Column) -> Column:
    return present.isNotNull() & required.isNull()


def drop_incomplete(df: DataFrame, present: str = S.ADDITIVE, required: str = S.CONCENTRATION) -> DataFrame:
    return df.where(~incomplete(F.col(present), F.col(required)))


def fill_mean(df: DataFrame, column: str = S.TEMPERATURE, digits: int = 6) -> DataFrame:
    """Nulls become the column mean, rounded because the column may serve as a grouping key.

    The mean is a scalar subquery: one partial aggregate, one value handed to the tasks.
    """
    mean = df.select(F.round(F.avg(column), digits)).scalar()
    return df.withColumn(column, F.coalesce(F.col(column), mean))


def fill_constant(df: DataFrame, column: str = S.TEMPERATURE, value: float = S.DEFAULT_TEMPERATURE) -> DataFrame:
    return df.fillna({column: value})


def annotated(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def missing(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    return df.where(F.col(target).isNull()).drop(target)


def parse_replicates(df: DataFrame, *, decimal_comma: bool = True) -> DataFrame:
    """Typed columns from the raw text columns; helper columns are dropped."""
    return df.select(
        "sample_id",
        F.col("smiles").alias(S.SUBJECT), "counterion",
        X.blank_to_null(F.col("additive_raw")).alias(S.ADDITIVE),
        N.parse_number(F.col("conc_raw"), decimal_comma=decimal_comma).alias(S.CONCENTRATION),
        N.parse_number(F.col("temp_raw"), decimal_comma=decimal_comma).alias(S.TEMPERATURE),
        F.col("tail_raw").cast("smallint").alias("tail_c_number"),
        "surfactant_type", "molecular_weight", "cmc", S.TARGET,
    )


def clean_replicates(df: DataFrame, *, missing_temperature: str = "fill", decimal_comma: bool = True) -> DataFrame:
    """Drop rows without subject facts, parse, settle missing temperatures, drop incomplete additives.

    The fill mean is taken after the first drop and before the second.
    """
    if missing_temperature not in ("fill", "drop"):
        raise ValueError("missing_temperature is 'fill' or 'drop'")
    parsed = parse_replicates(drop_null(df, REQUIRED_RAW), decimal_comma=decimal_comma)
    settled = fill_mean(parsed) if missing_temperature == "fill" else drop_null(parsed, [S.TEMPERATURE])
    return drop_incomplete(settled)


def cleaning_funnel(df: DataFrame) -> DataFrame:
    """Rows in, dropped by each rule, filled, and out - all from one pass over the raw rows."""
    gone = F.lit(False)
    for name in REQUIRED_RAW:
        gone = gone | F.col(name).isNull()
    additive = X.blank_to_null(F.col("additive_raw"))
    conc = N.parse_number(F.col("conc_raw"), decimal_comma=True)
    temp = N.parse_number(F.col("temp_raw"), decimal_comma=True)
    short = incomplete(additive, conc)
    counts = df.select(gone.alias("gone"), short.alias("short"), temp.isNull().alias("untempered")).agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(F.col("gone")).alias("dropped_missing_facts"),
        F.count_if(~F.col("gone") & F.col("untempered")).alias("filled_temperature"),
        F.count_if(~F.col("gone") & F.col("short")).alias("dropped_incomplete_additive"),
        F.count_if(~F.col("gone") & ~F.col("short")).alias("rows_out"),
    )
    names = counts.columns
    pairs = ", ".join(f"{i}, '{name}', {name}" for i, name in enumerate(names))
    return counts.selectExpr(f"stack({len(names)}, {pairs}) AS (step, rule, n_rows)")
