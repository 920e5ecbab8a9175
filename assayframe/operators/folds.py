"""Matrices added up over tasks: each task folds its rows into one, and only its lines are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F


def vectors_of(column: pa.Array) -> np.ndarray:
    """A list column of one length as rows, missing entries as NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def folded(df: DataFrame, fold: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum over all batches of ``fold`` of a batch, a matrix of one shape; none for a table without rows.

    The lines of a task's sum travel as rows, so what meets in a task is one line for each task. The whole sum comes to the
    driver: its size is that of the matrix, whatever the number of rows.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = np.atleast_2d(fold(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total))], names=["line", "v"])

    lines = df.mapInArrow(add, "line long, v array<double>").groupBy("line").agg(
        vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).toPandas().sort_values("line")
    return np.stack(lines["v"].to_numpy()) if len(lines) else None


def first_vector(df: DataFrame, vector: str) -> np.ndarray | None:
    row = df.where(F.col(vector).isNotNull()).select(vector).first()
    return None if row is None else np.array([np.nan if x is None else x for x in row[0]], np.float64)
