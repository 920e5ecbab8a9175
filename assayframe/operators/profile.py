"""Sweep one condition while the others stay fixed, for any number of samples at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from assayframe import schemas as S


def linspace(start: float, stop: float, num: int, digits: int = 6) -> list[float]:
    return [round(float(x), digits) for x in np.linspace(start, stop, num)]


def grid(samples: DataFrame, values: Sequence[float], column: str = S.TEMPERATURE, step: str = "step") -> DataFrame:
    """Each sample once per value. The values are literals of the plan: rows are multiplied in place."""
    points = F.array(*[F.struct(F.lit(i).alias(step), F.lit(float(v)).alias(column)) for i, v in enumerate(values)])
    rest = [c for c in samples.columns if c != column]
    return samples.select(*rest, F.explode(points).alias("_p")).select(*rest, "_p.*")


def band(prediction: Column, width: float = 0.1) -> dict[str, Column]:
    return {"band_low": prediction - width, "band_high": prediction + width}


def sweep_summary(scored: DataFrame, keys: Sequence[str], prediction: str = "predicted_pcmc") -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.count(prediction).alias("n_points"), F.min(prediction).alias("min_pcmc"),
        F.max(prediction).alias("max_pcmc"), F.avg(prediction).alias("mean_pcmc"))
