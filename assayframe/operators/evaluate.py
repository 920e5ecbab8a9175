"""Predictors and feature sets by name, and train / test evaluation over them."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from assayframe import schemas as S
from assayframe.functions import encode as E
from assayframe.operators import features as FT, fitted, metrics as M, models, neighbors, splits

Predictor = Callable[[DataFrame, DataFrame, dict], DataFrame]


def _constant(train: DataFrame, asked: DataFrame, params: dict) -> DataFrame:
    return models.predict_constant(asked, float(params.get("value", 0.0)))


def _mean(train: DataFrame, asked: DataFrame, params: dict) -> DataFrame:
    return models.predict_mean(train, asked)


def _knn(train: DataFrame, asked: DataFrame, params: dict) -> DataFrame:
    return neighbors.knn_predict(train, asked, keep=asked.columns, k=int(params.get("k", 5)))


def _learner(name: str) -> Predictor:
    def predict(train: DataFrame, asked: DataFrame, params: dict) -> DataFrame:
        model = models.fit(models.condition_features(train), name, params=params)
        return models.score(model, models.condition_features(asked), asked.columns)

    return predict


PREDICTORS: dict[str, Predictor] = {
    "constant": _constant, "mean": _mean, "knn": _knn, **{name: _learner(name) for name in models.LEARNERS},
}

# Feature sets add columns to sample rows; a set may drop rows whose features cannot be had.
FEATURES: dict[str, Callable[[DataFrame], DataFrame]] = {"expert": E.expert_features}

# Feature sets that change what a predictor does. The others ignore features or bring their own.
SUPPORTED: dict[str, set[str]] = fitted.USES


def predictor(name: str) -> Predictor:
    if name not in PREDICTORS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(PREDICTORS))}")
    return PREDICTORS[name]


def supported_features(model: str, features: Sequence[str]) -> list[str]:
    """The requested feature sets the model can use; the others are left out with a warning."""
    predictor(model)
    kept = [f for f in features if f in SUPPORTED.get(model, set(FT.SETS))]
    if len(kept) < len(features):
        warnings.warn(f"{model} does not use: {', '.join(sorted(set(features) - set(kept)))}", stacklevel=2)
    return kept


def add_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    for name in features:
        if name not in FEATURES:
            raise ValueError(f"unknown feature set {name!r}; known: {', '.join(sorted(FEATURES))}")
        df = FEATURES[name](df)
    return df


def both_sides(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


def held_out(df: DataFrame, key: str = "sample_id", fraction: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train rows and the pool of both sides, from one table split by key."""
    pool = splits.holdout(df, key, fraction).withColumnRenamed("split", "side")
    return pool.where(F.col("side") == "train").drop("side"), pool


def side_metrics(train: DataFrame, pool: DataFrame, model: str, params: dict | None = None, features: Sequence[str] | None = None,
                 tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Fit on ``train``, score both sides of ``pool`` in one pass, one metric row per side. With ``features`` a learner sees the
    conditions and these sets, otherwise its default columns."""
    if features is not None and model in models.LEARNERS:
        scored = fitted.score(fitted.fit(train, model, features, params, tables), pool)
    else:
        scored = predictor(model)(train, pool, params or {})
    return M.regression_metrics(scored, by=["side"])


def train_test(model: str, train: DataFrame | None = None, test: DataFrame | None = None, *, features: Sequence[str] = (),
               params: dict | None = None, tables: Mapping[str, DataFrame] | None = None, path: str | None = None,
               key: str = "sample_id") -> DataFrame | None:
    """Errors by side, in one of four ways: ``train`` alone fits and saves; ``test`` alone loads what was saved under ``path``; the
    same table twice is split by key, a fifth for the test; two tables are taken as they are. A fitted model is saved if ``path`` is given."""
    if train is None and test is None:
        raise ValueError("give a training table, a test table, or both")
    if train is None:
        if path is None:
            raise ValueError("a test alone needs the path of a saved model")
        return M.regression_metrics(fitted.score(models.load(path), test.withColumn("side", F.lit("test"))), by=["side"])
    if test is train:
        train, pool = held_out(train, key)
    else:
        pool = None if test is None else both_sides(train, test)
    model_ = fitted.fit(train, model, features, params, tables, row_id=key)
    if path is not None:
        models.save(model_, path)
    return None if pool is None else M.regression_metrics(fitted.score(model_, pool), by=["side"])


def experiment_row(train: DataFrame, pool: DataFrame, model: str, params: dict | None = None, *, features: Sequence[str] = (),
                   train_set: str = "", test_set: str = "", tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Features, model, settings, and the errors on both sides, as one row. Learners get the features, the others what they use."""
    if model in models.LEARNERS:
        long = side_metrics(train, pool, model, params, features, tables)
    else:
        long = side_metrics(add_features(train, features), add_features(pool, features), model, params)
    pick = lambda side, m: F.max(F.when(F.col("side") == side, F.col(m))).alias(f"{side}_{m}")
    return long.agg(pick("train", "mae"), pick("train", "r2"), pick("test", "mae"), pick("test", "r2")).select(
        F.lit("+".join(features) or "none").alias("features"), F.lit(model).alias("model"),
        F.lit(",".join(f"{k}={v}" for k, v in (params or {}).items())).alias("params"),
        F.lit(train_set).alias("train_set"), "train_mae", "train_r2", F.lit(test_set).alias("test_set"), "test_mae", "test_r2")
