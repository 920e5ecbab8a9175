import os
import shutil

import pytest
from pyspark.sql import functions as F

from assayframe import schemas as S
from assayframe.operators import predlog
from assayframe.plans import queries as Q
from assayframe.streaming import log_stream


def test_missing_log_is_empty_with_schema(spark, tmp_path):
    log = predlog.read(spark, str(tmp_path / "none"))
    assert log.count() == 0 and log.columns == S.PREDICTION_LOG_SCHEMA.fieldNames()


def test_append_keeps_earlier_rows(spark, folder, tmp_path):
    path = str(tmp_path / "log")
    rows = Q.event_log(spark, folder)
    predlog.append(rows.limit(5), path)
    predlog.append(rows.limit(3), path)
    assert spark.read.parquet(path).count() == 8


def test_written_rows_are_read_with_time_and_inputs(spark, tmp_path):
    scored = spark.createDataFrame(
        [(1, "2024-05-01 10:00:00", "CCO", 20.0, None, None, 2.0), (2, "2024-05-02 09:30:00", "CCC", 25.0, "[Na+]", 0.1, 3.0)],
        "k int, at string, surfactant_smiles string, temperature double, additive_smiles string, additive_concentration double, p double")
    path = str(tmp_path / "log")
    predlog.append(predlog.log_rows(scored, log_id="k", ts="at", prediction="p"), path)
    rows = predlog.formatted(predlog.newest_first(predlog.read(spark, path))).collect()
    assert [(r["id"], r["logged_at"]) for r in rows] == [("2", "2024-05-02 09:30:00"), ("1", "2024-05-01 10:00:00")]
    assert [tuple(rows[0][c] for c in S.CONDITIONS), tuple(rows[1][c] for c in S.CONDITIONS)] == [
        ("CCC", 25.0, "[Na+]", 0.1), ("CCO", 20.0, None, None)]


def test_stream_equals_batch_and_resumes(spark, folder, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.makedirs(inbox)
    to_log = lambda df: predlog.log_rows(df.withColumn("p", F.col("value") / 100), log_id="event_id", ts="ts", prediction="p", carry=["user_id"])
    shutil.copy(os.path.join(folder, "events.parquet"), os.path.join(inbox, "a.parquet"))
    schema = spark.read.parquet(inbox).schema
    for _ in range(2):  # the second run finds nothing new
        log_stream.append_log(log_stream.read_events(spark, inbox, schema), to_log, out, state).awaitTermination(120)
    batch = Q.event_log(spark, folder)
    stream = spark.read.parquet(out).select(*batch.columns)
    assert stream.count() == batch.count()
    assert stream.exceptAll(batch).count() == 0


def test_feedback_domain(spark):
    log = spark.createDataFrame([("1", "", None), ("2", "", None), ("3", "Good", 1.0)], "id string, feedback string, actual_pcmc double")
    edits = spark.createDataFrame([("1", "Bad", 10.0), ("2", "Awful", 1.0), ("3", None, 11.0)], "id string, feedback string, actual_pcmc double")
    out = {r["id"]: (r["feedback"], r["actual_pcmc"]) for r in predlog.merge_feedback(log, edits).collect()}
    assert out == {"1": ("Bad", 10.0), "2": ("", None), "3": ("Good", 1.0)}


def test_drift_needs_a_repeat(spark):
    log = spark.createDataFrame([("a", 0.3722), ("a", 0.4295), ("b", 1.0)], "k string, predicted_pcmc double")
    rows = predlog.drift(log, ["k"]).collect()
    assert len(rows) == 1 and rows[0]["spread"] == pytest.approx(0.0573)


def test_latest_of_several_edits_counts_once(spark):
    log = spark.createDataFrame([("1", "", None), ("2", "", None)], "id string, feedback string, actual_pcmc double")
    edits = spark.createDataFrame([("1", "Good", 9.0, 1), ("1", "Bad", 2.0, 2), ("1", "Bad", 2.0, 2)],
                                  "id string, feedback string, actual_pcmc double, at int")
    rows = [tuple(r) for r in predlog.merge_feedback(log, edits, edited_at="at").orderBy("id").collect()]
    assert rows == [("1", "Bad", 2.0), ("2", "", None)]


def test_edits_as_a_stream_equal_the_batch(spark, tmp_path):
    """Edits out of order, repeated, invalid, and a batch that is written again: the result of one batch over all edits."""
    log = spark.createDataFrame([(str(i), "", None) for i in range(5)], "id string, feedback string, actual_pcmc double")
    batches = [[("1", "Good", 9.0, "2024-01-05"), ("2", "Bad", 1.0, "2024-01-02"), ("3", "Awful", 2.0, "2024-01-09")],
               [("1", "Bad", 2.0, "2024-01-03"), ("2", "Good", 3.0, "2024-01-08"), ("9", "Good", 1.0, "2024-01-01")],
               [("1", "Bad", 2.0, "2024-01-05"), ("1", "Good", 9.0, "2024-01-05"), ("4", None, 11.0, "2024-01-02")]]
    inbox, target, state = (str(tmp_path / n) for n in ("in", "edits", "state"))
    frame = lambda rows: spark.createDataFrame(rows, "id string, feedback string, actual_pcmc double, day string").select(
        "id", "feedback", "actual_pcmc", F.to_timestamp("day").alias("edited_at"))
    assert log_stream.edited_log(spark, log, target).count() == 5  # before any edit
    every = None
    for rows in batches:
        frame(rows).coalesce(1).write.mode("append").parquet(inbox)
        every = frame(rows) if every is None else every.unionByName(frame(rows))
        log_stream.append_edits(log_stream.read_events(spark, inbox, log_stream.EDIT_SCHEMA), target, state).awaitTermination(120)
        streamed = sorted(map(tuple, log_stream.edited_log(spark, log, target).collect()))
        assert streamed == sorted(map(tuple, predlog.merge_feedback(log, every, edited_at="edited_at").collect()))
    assert streamed == [("0", "", None), ("1", "Good", 9.0), ("2", "Good", 3.0), ("3", "", None), ("4", "", None)]
    shutil.rmtree(state)  # a stream that has lost its place reads all edits again
    log_stream.append_edits(log_stream.read_events(spark, inbox, log_stream.EDIT_SCHEMA), target, state).awaitTermination(120)
    assert sorted(map(tuple, log_stream.edited_log(spark, log, target).collect())) == streamed
