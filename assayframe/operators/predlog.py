"""The prediction log: rows, feedback, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from assayframe import schemas as S
from assayframe.functions import numeric as N


def log_rows(scored: DataFrame, *, log_id: str, ts: str, prediction: str, carry: list[str] = S.CONDITIONS) -> DataFrame:
    """Scored rows in log form: time, carried inputs, rounded value, molar value as text, feedback still blank."""
    p = F.col(prediction)
    return scored.select(
        F.col(log_id).cast("string").alias("id"), F.col(ts).cast("timestamp").alias("ts"), *carry,
        F.round(p, 4).alias("predicted_pcmc"), N.scientific(N.from_neg_log10(p)).alias("predicted_cmc_m"),
        F.lit("").alias("feedback"), F.lit(None).cast("double").alias("actual_pcmc"),
    )


def append(rows: DataFrame, path: str) -> None:
    """Append only; earlier rows are neither read nor rewritten."""
    rows.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, schema=S.PREDICTION_LOG_SCHEMA) -> DataFrame:
    """The log, or an empty table of the same schema when none exists yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def formatted(log: DataFrame) -> DataFrame:
    """The log for display: ``ts`` becomes the text ``logged_at``."""
    return log.select(*[
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("logged_at") if c == "ts" else F.col(f"`{c}`") for c in log.columns])


def newest_first(log: DataFrame, ts: str = "ts", log_id: str = "id") -> DataFrame:
    return log.orderBy(F.desc(ts), log_id)


def valid_edit(feedback: str = "feedback", actual: str = "actual_pcmc") -> F.Column:
    low, high = S.ACTUAL_RANGE
    domain = F.col(feedback).isNull() | F.col(feedback).isin(S.FEEDBACK_VALUES)
    return domain & (F.col(actual).isNull() | F.col(actual).between(low, high))


def latest_edits(edits: DataFrame, log_id: str = "id", edited_at: str = "edited_at") -> DataFrame:
    """The latest valid edit of each row, by time and then by value."""
    best = F.max(F.struct(edited_at, "feedback", "actual_pcmc"))
    return edits.where(valid_edit()).groupBy(log_id).agg(best.alias("_e")).select(log_id, "_e.feedback", "_e.actual_pcmc", f"_e.{edited_at}")


def merge_feedback(log: DataFrame, edits: DataFrame, log_id: str = "id", edited_at: str | None = None) -> DataFrame:
    """Feedback columns from the valid edits; every other column of the log stays as it is.

    Of several edits of one row the latest by ``edited_at`` counts; without that column, the greatest by value.
    """
    values = F.struct("feedback", "actual_pcmc")
    latest = F.max_by(values, F.struct(*[edited_at] * bool(edited_at), values))
    good = edits.where(valid_edit()).groupBy(log_id).agg(latest.alias("_edit"))
    return log.join(good, log_id, "left").withColumns({
        "feedback": F.coalesce("_edit.feedback", "feedback"),
        "actual_pcmc": F.coalesce("_edit.actual_pcmc", "actual_pcmc"),
    }).drop("_edit")


def drift(log: DataFrame, inputs: list[str], prediction: str = "predicted_pcmc") -> DataFrame:
    """Inputs scored more than once and how far their predictions lie apart."""
    return log.groupBy(*inputs).agg(
        F.count(F.lit(1)).alias("n_predictions"), F.min(prediction).alias("min_pcmc"),
        F.max(prediction).alias("max_pcmc"), (F.max(prediction) - F.min(prediction)).alias("spread"),
    ).where(F.col("n_predictions") > 1)
