import os

import pytest
from pyspark.sql import functions as F

from assayframe import session


def tables(spark):
    folder = session.shared_folder(spark).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.startswith("table-")}


def test_stored_tables_last_until_the_end_of_a_scratch(spark):
    kept = session.store(spark.range(3))
    before = tables(spark)
    with session.scratch(spark):
        inner = session.store(spark.range(5).withColumn("x", F.col("id") * 2))
        assert len(tables(spark) - before) == 1 and inner.count() == 5
        with session.scratch(spark):
            session.store(spark.range(1))
        assert len(tables(spark) - before) == 1 and inner.agg(F.sum("x")).first()[0] == 20
    assert tables(spark) == before and kept.count() == 3
    with pytest.raises(ZeroDivisionError), session.scratch(spark):
        session.store(spark.range(2))
        raise ZeroDivisionError
    assert tables(spark) == before
