"""What the plans must and must not contain, so that they hold at any data size."""

import pytest

from assayframe.operators import clean, neighbors as NB
from assayframe.plans import queries as Q
from assayframe.sources import catalog, standins as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = ["merged_everything", "dedup_against_train", "leakage_report", "observed_points_nullsafe", "features_by_distinct_key", "profile_grid",
        "holdout_split", "quantile_bins", "scale_with_mask", "gated_feature_vector", "one_hot_learned", "qgram_documents", "merge_feedback",
        "feature_covariance", "residuals_by_class", "standardize_features", "attach_descriptors_two_role"]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_row_at_a_time_python(spark, folder, name):
    text = plan(Q.QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_grid_search_is_an_equi_join(spark):
    df = spark.createDataFrame([(float(i), "", f"{i}", 1.0) for i in range(50)], "a double, cat string, id string, v double")
    asked = df.selectExpr("id AS query_id", "a", "cat")
    text = plan(NB.estimate(asked, df, by=[], dims=["a"], category="cat", value="v", row_id="id", k=3))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "WindowGroupLimit" in text


def test_scan_reads_only_what_is_needed(spark, folder):
    text = plan(clean.annotated(V.meas(spark, folder)).select("sample_id"))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "lineitem" in line)
    assert "l_shipdate" not in scan and "l_tax" not in scan and "l_linestatus" not in scan
    assert "GreaterThanOrEqual(l_linenumber,4)" in scan


def test_merge_uses_partial_hash_aggregation(spark, folder):
    text = plan(catalog.everything(spark, folder))
    assert "partial_avg" in text and "SortAggregate" not in text


@pytest.mark.parametrize("name", ["features_descr_chen", "features_expert_lingo"])
def test_lookups_read_written_samples_and_tables(spark, folder, name):
    """The joins that make samples and molecule tables (and what they broadcast) run once, not in each lookup."""
    text = plan(Q.QUERIES[name](spark, folder))
    assert "FileScan" not in text and "Scan ExistingRDD" in text
