"""Column names, explicit schemas and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

SUBJECT = "surfactant_smiles"
TEMPERATURE = "temperature"
ADDITIVE = "additive_smiles"
CONCENTRATION = "additive_concentration"
TARGET = "pcmc"

CONDITIONS = [SUBJECT, TEMPERATURE, ADDITIVE, CONCENTRATION]
CANONICAL = [*CONDITIONS, TARGET]

SAMPLE_SCHEMA = T.StructType([
    T.StructField(SUBJECT, T.StringType(), False),
    T.StructField(TEMPERATURE, T.DoubleType(), False),
    T.StructField(ADDITIVE, T.StringType(), True),
    T.StructField(CONCENTRATION, T.DoubleType(), True),
])

MEASUREMENT_SCHEMA = T.StructType([
    *SAMPLE_SCHEMA.fields,
    T.StructField(TARGET, T.DoubleType(), True),
])

# A sample as a nested record; a null additive stands for "no additive".
NESTED_SAMPLE_SCHEMA = T.StructType([
    T.StructField(SUBJECT, T.StringType(), False),
    T.StructField(TEMPERATURE, T.DoubleType(), False),
    T.StructField("additive", T.StructType([
        T.StructField("smiles", T.StringType(), False),
        T.StructField("concentration", T.DoubleType(), True),
    ]), True),
])

# Raw replicate table: the measured columns arrive as text, with sentinels.
RAW_SCHEMA = T.StructType([
    T.StructField("sample_id", T.StringType()),
    T.StructField("smiles", T.StringType()),
    T.StructField("counterion", T.StringType()),
    T.StructField("tail_raw", T.StringType()),
    T.StructField("surfactant_type", T.StringType()),
    T.StructField("molecular_weight", T.DoubleType()),
    T.StructField("temp_raw", T.StringType()),
    T.StructField("additive_raw", T.StringType()),
    T.StructField("conc_raw", T.StringType()),
    T.StructField("ph", T.StringType()),
    T.StructField("pcmc", T.DoubleType()),
    T.StructField("cmc", T.DoubleType()),
])

PAPER1_SCHEMA = T.StructType([
    T.StructField("smiles", T.StringType()),
    T.StructField("T", T.DoubleType()),
    T.StructField("pCMC", T.DoubleType()),
])

PAPER4_SCHEMA = T.StructType([
    T.StructField("String", T.StringType()),
    T.StructField("log_cmc_um", T.DoubleType()),
    T.StructField("T_C", T.DoubleType()),
])

PREDICTION_LOG_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField(SUBJECT, T.StringType()),
    T.StructField(TEMPERATURE, T.DoubleType()),
    T.StructField(ADDITIVE, T.StringType()),
    T.StructField(CONCENTRATION, T.DoubleType()),
    T.StructField("predicted_pcmc", T.DoubleType()),
    T.StructField("predicted_cmc_m", T.StringType()),
    T.StructField("feedback", T.StringType()),
    T.StructField("actual_pcmc", T.DoubleType()),
])

# Fixed values of the data model.
MISSING_SENTINEL = "UNK"
DEFAULT_TEMPERATURE = 25.0
SUBJECT_CLASSES = ["zwitterionic", "anionic", "cationic", "nonionic"]
ANION_MARKS = ["[o-]"]
CATION_MARKS = ["[n+]", "[nh3+]", "[nh2+]", "[nh+]"]
FEEDBACK_VALUES = ["", "Good", "Overestimated", "Underestimated", "Bad"]
ACTUAL_RANGE = (0.0, 10.0)
SEED = 42
