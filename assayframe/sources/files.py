"""File scans with explicit schemas, and sinks."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayframe import schemas as S
from assayframe.session import store


def read_measurements_csv(spark: SparkSession, path: str, schema: T.StructType = S.MEASUREMENT_SCHEMA) -> DataFrame:
    """CSV with a header, bound to the columns of ``schema`` by name.

    A missing column is read as null if ``schema`` allows nulls in it; otherwise it is an error.
    """
    header = spark.read.option("header", True).csv(path)
    present = set(header.columns)
    lacking = [f.name for f in schema.fields if not f.nullable and f.name not in present]
    if lacking:
        raise ValueError(f"required columns are missing in {path}: {', '.join(lacking)}")
    return header.select(*[
        (F.col(f"`{f.name}`") if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


CORRUPT = "_corrupt"


def scan_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = S.MEASUREMENT_SCHEMA) -> DataFrame:
    """Every record of CSV files with headers: the columns of ``schema``, and ``rejected``, null for a good record.

    Columns are bound by name, path by path, so files may have them in any order and others besides; a column that ``schema`` lets
    be null may be missing. A record is rejected as ``malformed`` (a value that is not of its type, too few or too many values) or
    ``incomplete`` (no value where one is required); its text stays in ``record``.
    """
    parts = []
    for path in [paths] if isinstance(paths, str) else paths:
        header = spark.read.option("header", True).csv(path).columns
        kinds = {f.name: f.dataType for f in schema.fields}
        lacking = [f.name for f in schema.fields if not f.nullable and f.name not in header]
        if lacking:
            raise ValueError(f"required columns are missing in {path}: {', '.join(lacking)}")
        bound = T.StructType([*[T.StructField(c, kinds.get(c, T.StringType())) for c in header], T.StructField(CORRUPT, T.StringType())])
        rows = spark.read.schema(bound).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
        parts.append(rows.select(CORRUPT, *[(F.col(f"`{f.name}`") if f.name in header else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    required = [F.col(f.name).isNull() for f in schema.fields if not f.nullable]
    incomplete = functools.reduce(lambda a, b: a | b, required, F.lit(False))
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed").when(incomplete, "incomplete")
    record = F.when(F.col(CORRUPT).isNotNull(), F.col(CORRUPT)).when(incomplete, F.to_csv(F.struct(*[f.name for f in schema.fields])))
    return every.select(*[f.name for f in schema.fields], reason.alias("rejected"), record.alias("record"))


def good_and_rejected(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the rejected records with their reason, from one pass over the files."""
    kept = store(scanned)
    return kept.where("rejected IS NULL").drop("rejected", "record"), kept.where("rejected IS NOT NULL").select("rejected", "record")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_predictions(scored: DataFrame, path: str, prediction: str = "predicted_pcmc", fmt: str = "parquet") -> None:
    """The four input columns and the prediction, nothing else."""
    write_table(scored.select(*S.CONDITIONS, F.col(prediction).alias("predicted_pcmc")), path, fmt)
