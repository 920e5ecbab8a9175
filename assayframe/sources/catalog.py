"""Named sources: name -> function(spark, folder) -> canonical DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession

from assayframe.operators import combine, validate
from assayframe.sources import conform, standins as V

Source = Callable[[SparkSession, str], DataFrame]


def expert(spark: SparkSession, folder: str) -> DataFrame:
    return conform.expert(V.expert_raw(spark, folder))


def paper1(spark: SparkSession, folder: str) -> DataFrame:
    return conform.paper1(V.paper1(spark, folder))


def paper4(spark: SparkSession, folder: str) -> DataFrame:
    return conform.paper4(V.paper4(spark, folder))


def lab(spark: SparkSession, folder: str) -> DataFrame:
    return conform.canonical(V.lab(spark, folder))


def everything(spark: SparkSession, folder: str) -> DataFrame:
    parts = [expert(spark, folder), paper1(spark, folder), paper4(spark, folder)]
    return combine.merge_mean(combine.union_sources(parts))


SOURCES: dict[str, Source] = {
    "expert": expert, "paper1": paper1, "paper4": paper4, "lab": lab, "everything": everything,
}


def load(spark: SparkSession, folder: str, name: str, *, strict: bool = False) -> DataFrame:
    """A source by name. With ``strict`` reading a row that breaks a constraint fails, in the same pass."""
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(sorted(SOURCES))}")
    rows = SOURCES[name](spark, folder)
    return validate.enforce(rows) if strict else rows


def load_observed(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, Observation]:
    """A source by name, and the counts of its broken constraints once it has been read."""
    return validate.observed(load(spark, folder, name), annotated=True)


def register(name: str, source: Source) -> None:
    SOURCES[name] = source


def create_views(spark: SparkSession, folder: str) -> None:
    """One temporary view per named source, for SQL users."""
    for name, source in SOURCES.items():
        source(spark, folder).createOrReplaceTempView(name)
