"""Regression metrics, summaries, scaler statistics and covariances as plain aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from assayframe import schemas as S
from assayframe.functions import numeric as N


def r2_of(ss_res: Column, ss_tot: Column) -> Column:
    """1 - res/tot; a constant truth scores 1 when met exactly and 0 otherwise."""
    return F.when(ss_tot > 0, 1 - ss_res / ss_tot).when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def regression_metrics(scored: DataFrame, truth: str = S.TARGET, prediction: str = "predicted_pcmc",
                       by: Sequence[str] = ()) -> DataFrame:
    """n, MAE, MSE, RMSE and R2 of annotated, scored rows, per group."""
    t, p = F.col(truth), F.col(prediction)
    error = t - p
    rows = scored.where(t.isNotNull() & p.isNotNull())
    aggregates = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop(t).alias("_var"),
    )
    return aggregates.select(
        *by, "n", "mae", "mse", F.sqrt("mse").alias("rmse"), r2_of(F.col("mse"), F.col("_var")).alias("r2"))


def fold_summary(folds: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    return folds.groupBy(*by).agg(*[
        a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])


def numeric_summary(df: DataFrame, column: str = S.TARGET, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(column).alias("n"), F.min(column).alias("min"), F.max(column).alias("max"),
        F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def fit_scalers(train: DataFrame, temperature: str = S.TEMPERATURE, concentration: str = S.CONCENTRATION) -> DataFrame:
    """One row of scaling statistics; the concentration is fitted on present values only."""
    return train.agg(
        F.avg(temperature).alias("temp_mean"), N.safe_std(F.stddev_pop(temperature)).alias("temp_std"),
        F.coalesce(F.avg(concentration), F.lit(0.0)).alias("conc_mean"),
        N.safe_std(F.stddev_pop(concentration)).alias("conc_std"))


def scale_with_mask(df: DataFrame, scalers: DataFrame, temperature: str = S.TEMPERATURE,
                    concentration: str = S.CONCENTRATION) -> DataFrame:
    return df.withColumn("_fit", scalers.select(F.struct("*")).scalar()).withColumns({
        "temp_scaled": N.scaled(F.col(temperature), F.col("_fit.temp_mean"), F.col("_fit.temp_std")),
        "conc_scaled": N.scaled(F.col(concentration), F.col("_fit.conc_mean"), F.col("_fit.conc_std")),
        "additive_mask": N.text_mask(F.col(S.ADDITIVE)),
        "conc_mask": N.number_mask(F.col(concentration)),
    }).drop("_fit")


def moments(df: DataFrame, vector: str, weight: str | None = None) -> DataFrame:
    """Weighted count, sums and cross products of a vector column: rows (i, j, n, si, sj, sij), i <= j.

    Each task folds its rows into one Gram matrix, so the shuffle carries d * d / 2 rows per task,
    whatever the number of rows. A null or infinite entry fails the job: impute before.
    """
    source = df.select(F.col(vector).alias("x"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = total = None
        count = 0.0
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["x"].to_numpy()).astype(float)
            if not np.isfinite(x).all():
                raise ValueError("a vector has a missing or infinite entry; impute it first")
            w = batch["w"].to_numpy(dtype=float)
            xw = x * w[:, None]
            gram = xw.T @ x if gram is None else gram + xw.T @ x
            total = xw.sum(axis=0) if total is None else total + xw.sum(axis=0)
            count += w.sum()
        if gram is not None:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i, "j": j, "n": count, "si": total[i], "sj": total[j], "sij": gram[i, j]})

    parts = source.mapInPandas(fold, "i int, j int, n double, si double, sj double, sij double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])


def covariance(df: DataFrame, vector: str, weight: str | None = None, *, standardize: bool = True) -> DataFrame:
    """Population covariance of every feature pair (i <= j), of standardized features by default."""
    m = moments(df, vector, weight)
    cov = m.select("i", "j", (F.col("sij") / F.col("n") - (F.col("si") / F.col("n")) * (F.col("sj") / F.col("n"))).alias("cov"))
    if not standardize:
        return cov
    spread = cov.where(F.col("i") == F.col("j")).select(F.col("i").alias("f"), N.safe_std(F.sqrt(F.greatest("cov", F.lit(0.0)))).alias("s"))
    a, b = spread.alias("a"), spread.alias("b")
    return cov.join(a, F.col("i") == F.col("a.f")).join(b, F.col("j") == F.col("b.f")).select(
        "i", "j", (F.col("cov") / (F.col("a.s") * F.col("b.s"))).alias("cov"))
