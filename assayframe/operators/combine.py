"""Joins, unions and the null-safe aggregations that merge measurement tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from assayframe import schemas as S
from assayframe.functions import text as X
from assayframe.operators.skew import skew_join

REPLICATE_KEYS = [S.SUBJECT, "counterion", S.ADDITIVE, S.CONCENTRATION, S.TEMPERATURE]


def first_by(column: str, order: str) -> F.Column:
    """First non-null value in the order of a stable row key."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


def aggregate_replicates(df: DataFrame, order: str = "sample_id") -> DataFrame:
    """One row per condition: mean and sample deviation of the measured values, first of the facts."""
    grouped = df.groupBy(*REPLICATE_KEYS).agg(
        first_by("tail_c_number", order).alias("tail_c_number"),
        first_by("surfactant_type", order).alias("surfactant_type"),
        first_by("molecular_weight", order).alias("molecular_weight"),
        F.avg("cmc").alias("cmc"),
        F.coalesce(F.stddev_samp("cmc"), F.lit(0.0)).alias("cmc_std"),
        F.avg(S.TARGET).alias(S.TARGET),
        F.coalesce(F.stddev_samp(S.TARGET), F.lit(0.0)).alias("pcmc_std"),
    )
    # The counterion-free identifier depends on a key alone, so it needs no aggregate buffer.
    return grouped.withColumn("smiles_no_counterion", X.first_part(F.col(S.SUBJECT)))


def merge_mean(df: DataFrame, keys: Sequence[str] = tuple(S.CONDITIONS), target: str = S.TARGET) -> DataFrame:
    """One row per key; null is a key value of its own, an all-null group stays null."""
    return df.groupBy(*keys).agg(F.avg(target).alias(target))


def aggregate_targets(df: DataFrame, keys: Sequence[str], targets: Sequence[str], order: str) -> DataFrame:
    """Mean of every target column, first non-null of every other column."""
    rest = [c for c in df.columns if c not in keys and c not in targets and c != order]
    return df.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in targets], *[first_by(c, order).alias(c) for c in rest],
    )


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("at least one source must be selected")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_selected(named: dict[str, DataFrame], selected: Sequence[str]) -> DataFrame:
    """Union of the selected sources with a provenance column; absent columns become null."""
    unknown = [name for name in selected if name not in named]
    if unknown:
        raise ValueError(f"unknown sources: {unknown}")
    return union_sources([named[name].withColumn("source", F.lit(name)) for name in selected])


def distinct_keys(df: DataFrame, key: str, alias: str) -> DataFrame:
    return df.select(F.col(key).alias(alias)).distinct()


def drop_known(test: DataFrame, train: DataFrame, key: str = S.SUBJECT, train_key: str | None = None,
               normalize: bool = False) -> DataFrame:
    """Test rows whose key never occurs in training; null counts as a value."""
    shape = X.normalize_key if normalize else (lambda c: c)
    known = train.select(shape(F.col(train_key or key)).alias("_known")).distinct()
    return test.join(known, shape(test[key]).eqNullSafe(known["_known"]), "left_anti")


def leakage_report(test: DataFrame, train: DataFrame, key: str = S.SUBJECT, train_key: str | None = None) -> DataFrame:
    """Test rows per key that also occurs in training. Counts first, so the join moves one row per key."""
    counts = test.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    known = distinct_keys(train, train_key or key, "_known")
    return counts.join(known, counts[key].eqNullSafe(known["_known"]), "left_semi")


def attach(samples: DataFrame, features: DataFrame, on: str | list[str], salt_by: Sequence[str] | None = None) -> DataFrame:
    """Feature columns by key; samples without a feature row disappear. One key may hold most samples."""
    return skew_join(samples, features, [on] if isinstance(on, str) else list(on), "inner", _row_id(samples, salt_by))


def _row_id(samples: DataFrame, salt_by: Sequence[str] | None) -> list[str] | None:
    """Columns that tell rows of one key apart: those given, the row id where there is one, or all."""
    return list(salt_by) if salt_by else ["sample_id"] if "sample_id" in samples.columns else None


def attach_two_roles(samples: DataFrame, features: DataFrame, main_key: str, other_key: str,
                     feature_key: str, vector: str, salt_by: Sequence[str] | None = None) -> DataFrame:
    """The same feature table for two keys: required for the main one, optional for the other.

    The other key is often null or one of few values: its rows are dealt over many tasks, and a null key is joined with nothing.
    """
    main = features.select(F.col(feature_key).alias(main_key), F.col(vector).alias(f"{vector}_all"))
    other = features.select(F.col(feature_key).alias(other_key), F.col(vector).alias(f"{vector}_additive"))
    by = _row_id(samples, salt_by)
    return skew_join(skew_join(samples, main, [main_key], "inner", by), other, [other_key], "left", by)


def features_by_distinct(df: DataFrame, key: str, features: dict[str, F.Column], salt_by: Sequence[str] | None = None) -> DataFrame:
    """Evaluate features once per distinct key, then join them back."""
    table = df.select(key).distinct().withColumns(features)
    return skew_join(df, table, [key], "inner", _row_id(df, salt_by))


def observed_points(grid: DataFrame, measured: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Measured rows for each requested key; a null key part matches only null. Measured rows of a hot key are spread, its few
    requests repeated."""
    seen = measured.select(*keys, *[F.col(c).alias(f"observed_{c}") for c in measured.columns if c not in keys])
    return skew_join(seen, grid, list(keys), "inner", null_safe=True).select(
        *grid.columns, *[c for c in seen.columns if c not in keys])
