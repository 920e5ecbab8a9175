"""Principal components over a vector column: impute, standardize, find the leading directions, score.

One pass adds up the moments of every position. Then blocks of directions are multiplied with the covariance, a pass each, until the
leading ones stand still (subspace iteration with Rayleigh-Ritz steps). A block as wide as the vector settles that in one
pass; wider vectors keep to the block, so neither a task nor the driver holds a matrix of features by features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayframe.functions import numeric as N
from assayframe.operators.folds import first_vector, folded, vectors_of

#: Directions in a block.
BLOCK = 256
MAX_PASSES = 200
TOLERANCE = 1e-10
SEED = 42


@dataclass
class Stats:
    """Per position: rows with a value, their mean, and the deviation over all rows after mean imputation (1 if it is constant)."""

    rows: int
    present: np.ndarray
    mean: np.ndarray
    std: np.ndarray


@dataclass
class Components:
    """Fitted components of the kept positions, the largest first; ``residuals`` are the lengths of ``C v - value * v``."""

    names: list[str]
    keep: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    total: float
    residuals: np.ndarray
    passes: int


def _finite(column: pa.Array) -> np.ndarray:
    x = vectors_of(column)
    x[~np.isfinite(x)] = np.nan
    return x


def vector_stats(df: DataFrame, vector: str) -> Stats | None:
    """All positions in one pass; none for a table without vectors. Sums are taken from a row's values, so large offsets cancel nothing."""
    first = first_vector(df, vector)
    if first is None:
        return None
    shift = np.where(np.isfinite(first), first, 0.0)

    def fold(batch: pa.RecordBatch) -> np.ndarray:
        x = _finite(batch.column(0)) - shift
        there, x = ~np.isnan(x), np.nan_to_num(x)
        return np.stack([there.sum(axis=0), x.sum(axis=0), (x * x).sum(axis=0), np.full(x.shape[1], len(x))])

    count, one, two, rows = folded(df.where(F.col(vector).isNotNull()).select(vector), fold)
    mean = np.divide(one, count, out=np.zeros_like(one), where=count > 0)
    spread = np.sqrt(np.maximum(two - one * mean, 0.0) / rows)
    return Stats(int(rows[0]), count.astype(int), mean + shift, np.where(spread > 1e-9 * np.maximum(1.0, np.abs(mean)), spread, 1.0))


def standardize(df: DataFrame, vector: str, *, scale: bool = True) -> DataFrame:
    """Infinite and missing entries become the mean of their position; then centre, and divide by the
    population deviation (1 for a constant position). Positions without any value are dropped."""
    stats = vector_stats(df, vector)
    if stats is None:
        return df
    fitted = F.array(*[F.struct(F.lit(float(m)).alias("mean"), F.lit(float(s) if scale else 1.0).alias("std"), F.lit(bool(p)).alias("there"))
                       for m, s, p in zip(stats.mean, stats.std, stats.present)])
    centred = lambda x, f: F.struct(f["there"].alias("there"), (F.coalesce(N.finite_or(x, None) - f["mean"], F.lit(0.0)) / f["std"]).alias("z"))
    made = F.transform(F.filter(F.zip_with(vector, fitted, centred), lambda v: v["there"]), lambda v: v["z"])
    return df.withColumn(vector, made)


def fit(df: DataFrame, vector: str, names: Sequence[str], n_components: int = 10, *, exclude: Sequence[str] = (), scale: bool = True,
        block: int = BLOCK) -> Components:
    """The leading components of all rows with a vector. Excluded names and positions without a value take no part."""
    unknown = set(exclude) - set(names)
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
    stats = vector_stats(df, vector)
    if stats is None:
        raise ValueError("there are no vectors to fit on")
    keep = np.array([i for i, n in enumerate(names) if n not in exclude and stats.present[i] > 0], int)
    mean, std = stats.mean[keep], stats.std[keep] if scale else np.ones(len(keep))
    wide, rows = len(keep), df.where(F.col(vector).isNotNull()).select(vector)
    k = min(n_components, wide)
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((wide, min(wide, max(block, 2 * k)))))[0]
    for passes in range(1, MAX_PASSES + 1):
        def fold(batch: pa.RecordBatch, basis: np.ndarray = basis) -> np.ndarray:
            z = np.nan_to_num((_finite(batch.column(0))[:, keep] - mean) / std)
            return np.concatenate([z.T @ (z @ basis), (z * z).sum(axis=0)[:, None]], axis=1)

        moved = folded(rows, fold) / stats.rows
        image, total = moved[:, :-1], float(moved[:, -1].sum())
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        order = np.argsort(values)[::-1]
        values, turn = values[order], turn[:, order]
        vectors = basis @ turn
        residuals = np.linalg.norm(image @ turn[:, :k] - vectors[:, :k] * values[:k], axis=0)
        if basis.shape[1] == wide or residuals.max() <= TOLERANCE * max(values[0], 1e-300):
            break
        basis = np.linalg.qr(image)[0]
    largest = np.abs(vectors[:, :k]).argmax(axis=0)
    vectors = vectors[:, :k] * np.where(vectors[largest, np.arange(k)] >= 0, 1.0, -1.0)
    return Components([names[i] for i in keep], keep, mean, std, vectors, np.maximum(values[:k], 0.0), total, residuals, passes)


def scores(df: DataFrame, vector: str, fitted: Components, keep: Sequence[str]) -> DataFrame:
    """The place of every row with a vector on each component."""
    columns = [f"PC{j + 1}" for j in range(fitted.vectors.shape[1])]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.nan_to_num((_finite(batch.column(len(keep)))[:, fitted.keep] - fitted.mean) / fitted.std) if batch.num_rows else np.empty((0, len(fitted.keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *[pa.array(c) for c in (z @ fitted.vectors).T]], names=[*keep, *columns])

    rows = df.where(F.col(vector).isNotNull()).select(*keep, vector)
    kept = rows.schema.fields[:len(keep)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{c} double" for c in columns])
    return rows.mapInArrow(project, schema)


def loadings(df: DataFrame, fitted: Components) -> DataFrame:
    """One row per feature; features x components values, bounded by the number of columns."""
    names = [f"PC{j + 1}" for j in range(fitted.vectors.shape[1])]
    schema = "feature string, " + ", ".join(f"{n} double" for n in names)
    return df.sparkSession.createDataFrame([(c, *map(float, line)) for c, line in zip(fitted.names, fitted.vectors)], schema)


def variance(df: DataFrame, fitted: Components) -> DataFrame:
    ratio = (fitted.values / max(fitted.total, 1e-300)).tolist()
    table = [(f"PC{i + 1}", i + 1, v, sum(ratio[: i + 1])) for i, v in enumerate(ratio)]
    return df.sparkSession.createDataFrame(table, "component string, position int, ratio double, cumulative double")


def checks(scored: DataFrame, fitted: Components) -> DataFrame:
    """What must hold of the scores and is found from them by plain aggregates, one row per component: their mean, the largest covariance with
    another component, the variance beside the component's value, and the residual of the component; all but rounding are 0."""
    k = fitted.vectors.shape[1]
    pc = [F.col(f"PC{j + 1}") for j in range(k)]
    row = scored.agg(*[F.avg(c).alias(f"m{j}") for j, c in enumerate(pc)],
                     *[F.covar_pop(pc[i], pc[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    cov = lambda i, j: row[f"c{min(i, j)}_{max(i, j)}"]
    rows = [(f"PC{i + 1}", float(row[f"m{i}"]), max((abs(cov(i, j)) for j in range(k) if j != i), default=0.0), cov(i, i) - float(fitted.values[i]),
             float(fitted.residuals[i])) for i in range(k)]
    return scored.sparkSession.createDataFrame(rows, "component string, mean double, other double, variance_gap double, residual double")


def top_loadings(table: DataFrame, components: Sequence[str] = ("PC1", "PC2"), k: int = 12) -> DataFrame:
    """The k features with the largest absolute loading of each component."""
    parts = [
        table.select(F.lit(c).alias("component"), "feature", F.abs(c).alias("abs_loading"))
        .orderBy(F.desc("abs_loading"), "feature").limit(k)
        for c in components
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
