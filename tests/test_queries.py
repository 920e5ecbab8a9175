"""Every query with SQL text gives the same rows on both engines; the others run and keep their shape."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import rows_of

from assayframe.plans import oracles  # noqa: E402
from assayframe.plans.queries import QUERIES  # noqa: E402

CHECKS = oracles.build()
ROWS_ONLY = {"cv_rf", "predict_rf", "predict_gbt", "predict_embedding_head", "predict_missing", "external_validation_rf",
             "rf_feature_sets", "pca_scores", "pca_loadings", "pca_variance", "top_loadings"}


@pytest.fixture(scope="module")
def other(folder):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_is_checked_or_listed():
    assert set(QUERIES) - set(CHECKS) == ROWS_ONLY
    assert not set(CHECKS) - set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_rows(spark, folder, other, name):
    df = entry.queries()[name](spark, folder)
    result = other.execute(CHECKS[name])
    columns = [d[0] for d in result.description]
    rows = df.collect()
    assert rows
    assert rows_of(df.columns, rows) == rows_of(columns, result.fetchall())


def test_entry_is_the_merge(spark):
    df = entry.entry(spark)
    assert df.columns == ["surfactant_smiles", "temperature", "additive_smiles", "additive_concentration", "pcmc"]
    assert df.count() == 2454
