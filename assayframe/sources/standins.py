"""Measurement-shaped tables derived from the star-schema parquet files.

Each function reads only the columns it needs; joins carry no hint, so Spark's own size check
(``spark.sql.autoBroadcastJoinThreshold`` and the adaptive re-plan) decides on broadcasting.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayframe.functions import numeric as N, text as X
from assayframe.session import widen


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def wide_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose single rows are costly to process (long texts): read by all cores."""
    return widen(table(spark, folder, name))


def mol(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    kind, run = F.col("p_type"), F.repeat(F.lit("C"), F.col("p_size"))
    smiles = (
        F.when(kind == "STANDARD", F.concat(run, F.lit("OS(=O)(=O)[O-].[Na+]")))
        .when(kind == "ECONOMY", F.concat(run, F.lit("[N+](C)(C)C.[Br-]")))
        .when(kind == "MEDIUM", F.concat(run, F.lit("[N+](C)(C)CC(=O)[O-]")))
        .when(kind == "SMALL", F.concat(run, F.lit("OCCOCCO")))
        .when(kind == "LARGE", F.concat(run, F.lit("C(=O)[O-].[K+]")))
        .otherwise(F.concat(F.lit("[Br-]."), run, F.lit("[n+]1ccccc1")))
    )
    counterion = (
        F.when(kind == "STANDARD", "[Na+]").when(kind == "ECONOMY", "[Br-]")
        .when(kind == "LARGE", "[K+]").when(kind == "PROMO", "[Br-]")
    )
    return part.select(
        F.col("p_partkey").alias("mol_id"),
        smiles.alias("smiles"),
        counterion.alias("counterion"),
        F.when(F.col("p_size") % 13 != 0, F.col("p_size").cast("string")).alias("tail_raw"),
        F.when(F.col("p_partkey") % 50 != 1, F.lower(kind)).alias("surfactant_type"),
        F.col("p_retailprice").alias("molecular_weight"),
    )


def meas_raw(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    step = (F.lit(20) + F.lit(5) * (F.col("l_quantity").cast("int") % 8)).cast("string")
    priced = F.col("l_suppkey") % 20 != 0
    joined = line.join(mol(spark, folder), F.col("l_partkey") == F.col("mol_id"))
    return joined.select(
        F.concat_ws(
            "|", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"),
            F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        ).alias("sample_id"),
        F.col("l_linenumber").alias("line_no"),
        "mol_id", "smiles", "counterion", "tail_raw", "surfactant_type", "molecular_weight",
        F.when(F.col("l_tax") == 0.08, F.lit("UNK"))
        .when(F.col("l_tax") == 0.07, F.concat(step, F.lit(",5")))
        .otherwise(step).alias("temp_raw"),
        F.when(F.col("l_returnflag") == "A", "[Na+].[Cl-]")
        .when(F.col("l_returnflag") != "N", "").alias("additive_raw"),
        F.when(F.col("l_returnflag") == "A",
               F.when(F.col("l_discount") == 0.0, "UNK").otherwise(F.col("l_discount").cast("string")),
               ).alias("conc_raw"),
        F.when(priced, F.log10("l_extendedprice")).alias("pcmc"),
        F.when(priced, 1 / F.col("l_extendedprice")).alias("cmc"),
    )


def expert_raw(spark: SparkSession, folder: str) -> DataFrame:
    """The dirty replicate rows, in the raw source's own columns."""
    return meas_raw(spark, folder).where(F.col("line_no") >= 4).withColumn("ph", F.lit(None).cast("string"))


def meas(spark: SparkSession, folder: str) -> DataFrame:
    raw = meas_raw(spark, folder).where(F.col("line_no") >= 4)
    return raw.select(
        "sample_id", "mol_id", F.col("smiles").alias("surfactant_smiles"),
        N.parse_number(F.col("temp_raw"), decimal_comma=True).alias("temperature"),
        X.blank_to_null(F.col("additive_raw")).alias("additive_smiles"),
        N.parse_number(F.col("conc_raw"), decimal_comma=True).alias("additive_concentration"),
        "pcmc",
    )


def _measured(spark: SparkSession, folder: str, line_no: int) -> DataFrame:
    return meas_raw(spark, folder).where(
        (F.col("line_no") == line_no) & F.col("pcmc").isNotNull() & (F.col("temp_raw") != "UNK")
    )


def paper1(spark: SparkSession, folder: str) -> DataFrame:
    return _measured(spark, folder, 1).select(
        "smiles", N.parse_number(F.col("temp_raw"), decimal_comma=True).alias("T"),
        F.col("pcmc").alias("pCMC"),
    )


def paper4(spark: SparkSession, folder: str) -> DataFrame:
    return _measured(spark, folder, 2).select(
        F.col("smiles").alias("String"), (F.lit(6.0) - F.col("pcmc")).alias("log_cmc_um"),
        N.parse_number(F.col("temp_raw"), decimal_comma=True).alias("T_C"),
    )


def lab(spark: SparkSession, folder: str) -> DataFrame:
    foreign = F.col("additive_raw") == ""
    return _measured(spark, folder, 3).select(
        "sample_id", "mol_id",
        F.when(F.col("mol_id") % 10 == 0, F.concat(F.lit("CC(C)"), F.col("smiles")))
        .otherwise(F.col("smiles")).alias("surfactant_smiles"),
        N.parse_number(F.col("temp_raw"), decimal_comma=True).alias("temperature"),
        F.when(foreign, "[Mg+2].[Cl-].[Cl-]").otherwise(F.col("additive_raw")).alias("additive_smiles"),
        F.when(foreign, F.lit(0.01)).otherwise(F.col("conc_raw").try_cast("double"))
        .alias("additive_concentration"),
        "pcmc",
    )


def descr(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("mol_id"), F.col("embedding").cast("array<double>").alias("fp"),
    )


def predlog(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").alias("input_key"),
        F.round(F.col("value") / 100, 4).alias("predicted_pcmc"),
        F.when(kind == "view", "Good").when(kind == "click", "Overestimated")
        .when(kind == "purchase", "Underestimated").when(kind == "error", "Bad")
        .otherwise("").alias("feedback"),
    )
