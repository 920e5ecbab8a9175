"""The salted join against the plain one, the sketch's promise, and how rows are dealt."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayframe.operators import skew


def sides(spark, hot=0.9, n=20_000):
    left = spark.range(n).select(F.col("id").alias("row"), F.when(F.col("id") % 1000 < int(1000 * hot), F.lit("hot")).when(
        F.col("id") % 1000 == 999, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"), (F.col("id") % 3).alias("two"))
    right = left.select("key", "two").distinct().withColumn("value", F.concat_ws("/", "key", "two")).where("key IS NULL OR key = 'hot' OR two < 2")
    return left.repartition(6), right


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_same_rows_as_the_plain_join(spark, how, null_safe):
    left, right = sides(spark)
    condition = [(left[c].eqNullSafe(right[c]) if null_safe else left[c] == right[c]) for c in ("key", "two")]
    plain = left.join(right, condition[0] & condition[1], how).select(left["row"], left["key"], left["two"], *(["value"] if how in ("inner", "left") else []))
    made = skew.skew_join(left, right, ["key", "two"], how, salt_by=["row"], null_safe=null_safe)
    assert rows(made.select(plain.columns)) == rows(plain)


def test_one_key_on_nine_tenths_of_the_rows_is_dealt_evenly(spark):
    left, right = sides(spark, n=80_000)
    hot = skew.hot_keys(left, ["key"])
    assert 1 <= len(hot) <= 1.5 / skew.HOT_SHARE
    salted, _ = skew.salted(left, right, ["key"], ["row"], hot, 64)
    dealt = [r["count"] for r in salted.repartition(8, "key", "_salt").groupBy(F.spark_partition_id()).count().collect()]
    plain = [r["count"] for r in left.repartition(8, "key").groupBy(F.spark_partition_id()).count().collect()]
    assert max(dealt) < 2 * sorted(dealt)[len(dealt) // 2] and max(plain) > 0.9 * 80_000


def test_every_key_above_the_share_is_found(spark):
    """Hot keys of falling weight among many keys met once, in any order of the rows."""
    n = 200_000
    df = spark.range(n).select(F.when(F.col("id") % 7 == 0, F.floor(F.col("id") % 200 / 4)).otherwise(F.col("id") + 1000).alias("k")).repartition(5)
    counts = df.groupBy("k").count().where(F.col("count") > skew.HOT_SHARE * n).select(skew.key_hash(["k"]).alias("h"))
    wanted = {r["h"] for r in counts.collect()}
    assert wanted and wanted <= set(skew.hot_keys(df, ["k"]))


def test_no_hot_key_leaves_the_plan_alone(spark):
    left = spark.range(5000).withColumnRenamed("id", "key")
    made = skew.skew_join(left, left.withColumn("value", F.col("key") * 2), ["key"], "left")
    assert "_salt" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.where("value <> 2 * key OR value IS NULL").count() == 0


def test_empty_sides_and_clashing_names(spark):
    left = spark.createDataFrame([], "key long, value string")
    right = spark.createDataFrame([(1, "x")], "key long, `odd name` string")
    assert skew.skew_join(left, right, ["key"], "left").collect() == []
    some = spark.createDataFrame([(1, "a"), (None, "b")], "key long, `odd name` string").withColumnRenamed("odd name", "left name")
    assert rows(skew.skew_join(some, right, ["key"], "left")) == Counter([(1, "a", "x"), (None, "b", None)])
    with pytest.raises(ValueError):
        skew.skew_join(left, right, ["key"], "full")
