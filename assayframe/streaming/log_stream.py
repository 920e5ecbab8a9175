"""The prediction log as a stream: files of events in, log partitions out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from assayframe.operators import predlog

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_events(spark: SparkSession, folder: str, schema: T.StructType = EVENT_SCHEMA, max_files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def append_log(events: DataFrame, to_log: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch and write it under its batch id, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        to_log(batch).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


EDIT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("feedback", T.StringType()), T.StructField("actual_pcmc", T.DoubleType()),
    T.StructField("edited_at", T.TimestampType()),
])


def append_edits(edits: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Feedback as a stream: each micro-batch leaves the latest valid edit of every row it edits, under its batch id.

    The latest by edit time is the greatest of all batches, in whatever order they come, so a late edit never undoes a newer one, and a batch
    that is repeated replaces its own part. What is kept grows with the edits, not with the log, and no state is held between batches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        predlog.latest_edits(batch, edited_at="edited_at").write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return edits.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edited_log(spark: SparkSession, log: DataFrame, target: str) -> DataFrame:
    """The log with the latest edits of all batches so far."""
    return predlog.merge_feedback(log, predlog.read(spark, target, EDIT_SCHEMA), edited_at="edited_at")
