"""What the corpus operators share: reading, words, and running totals without a hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Bits of a hash that name a bucket of :func:`running_start`.
BUCKET_BITS = 12


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def running_start(df: DataFrame, groups: list[str], order: Column, tie: str, value: str, into: str) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows of the same group that come earlier.

    Rows of a group are in the order of the 64-bit hash ``order``, then of ``tie``. Leading bits of the hash
    cut each group into buckets of even size; a window runs inside each bucket and a table of bucket sums
    (at most ``2 ** BUCKET_BITS`` rows a group) carries the totals on, so a group with a third of all rows
    is still spread over thousands of windows.
    """
    keyed = df.withColumn("_order", order).withColumn(
        "_bucket", F.shiftrightunsigned(F.col("_order"), 64 - BUCKET_BITS))
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(*groups, "_bucket").agg(F.sum(value).alias("_sum"))
    bases = sums.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).cast("long").alias("_base"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_order", tie).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)] + [F.col("_bucket") == F.col("_b")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return local.join(bases, condition).withColumn(into, F.col("_base") + F.col("_local")).drop(
        "_order", "_bucket", "_b", "_base", "_local", *[f"_g{i}" for i in range(len(groups))])
