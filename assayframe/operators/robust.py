"""A linear head under the Huber loss, by iteratively reweighted least squares.

Each step gives every row the weight ``min(1, delta / |residual|)`` and solves the weighted normal equations. A step is one pass: tasks
fold their rows into a weighted Gram matrix, and the driver solves a system of the size of the vector, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, functions as F

from assayframe import schemas as S
from assayframe.operators.features import FeatureStage
from assayframe.operators.folds import folded, vectors_of
from assayframe.session import store

DELTA = 0.5
STEPS = 40
#: Ridge per row: keeps the system solvable where features repeat each other or never vary.
RIDGE = 1e-6


@dataclass
class Head:
    weights: np.ndarray
    intercept: float
    delta: float
    steps: int

    def predicted(self, vector: str) -> Column:
        return F.aggregate(F.zip_with(F.col(vector), F.lit(self.weights.tolist()), lambda a, b: a * b), F.lit(float(self.intercept)), lambda s, x: s + x)


def _design(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = vectors_of(batch.column(0))
    return np.concatenate([x, np.ones((len(x), 1))], axis=1), batch.column(1).to_numpy(zero_copy_only=False)


def _rows(df: DataFrame, vector: str, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull() & F.col(vector).isNotNull()).select(F.col(vector).alias("x"), F.col(target).cast("double").alias("y"))


def fit(df: DataFrame, vector: str, target: str = S.TARGET, delta: float = DELTA, steps: int = STEPS, ridge: float = RIDGE) -> Head:
    """Fit on the rows with a target; the vector has no missing entries. ``steps`` passes at most, fewer once nothing moves."""
    rows = store(_rows(df, vector, target))
    width = rows.select(F.size("x")).first()
    if width is None:
        raise ValueError("there are no rows with a target to fit on")
    at = np.zeros(width[0] + 1)
    for step in range(1, steps + 1):
        first = step == 1

        def fold(batch: pa.RecordBatch, at: np.ndarray = at, first: bool = first) -> np.ndarray:
            x, y = _design(batch)
            size = np.abs(y - x @ at)
            weight = np.ones(len(y)) if first else np.minimum(1.0, delta / np.maximum(size, 1e-300))
            part = (x * weight[:, None]).T @ np.concatenate([x, y[:, None]], axis=1)
            return np.concatenate([part, np.full((1, part.shape[1]), len(y))])

        total = folded(rows, fold)
        gram, right, n = total[:-1, :-1], total[:-1, -1], total[-1, -1]
        penalty = ridge * n * np.eye(len(at))
        penalty[-1, -1] = 0.0  # the intercept is free
        new = np.linalg.solve(gram + penalty, right)
        moved, at = np.abs(new - at).max(), new
        if moved <= 1e-12 * max(1.0, np.abs(at).max()):
            break
    return Head(at[:-1], float(at[-1]), delta, step)


def gradient(df: DataFrame, vector: str, head: Head, target: str = S.TARGET) -> np.ndarray:
    """The mean gradient of the Huber loss, of the weights and then of the intercept: near zero where the head is optimal."""
    at, delta = np.append(head.weights, head.intercept), head.delta

    def fold(batch: pa.RecordBatch) -> np.ndarray:
        x, y = _design(batch)
        return np.append(x.T @ np.clip(y - x @ at, -delta, delta), len(y))

    total = folded(_rows(df, vector, target), fold)[0]
    return -total[:-1] / total[-1]


class LinearHead(FeatureStage):
    """A fitted head as a stage of a saved pipeline: it reads an array column."""

    vector = Param(Params._dummy(), "vector", "array column", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "weights", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)

    def __init__(self, head: Head | None = None, vector: str = "features"):
        super().__init__()
        self._set(vector=vector)
        if head is not None:
            self._set(weights=head.weights.tolist(), intercept=head.intercept)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        head = Head(np.array(self.getOrDefault(self.weights)), self.getOrDefault(self.intercept), DELTA, 0)
        return dataset.withColumn("predicted_pcmc", head.predicted(self.getOrDefault(self.vector)))
