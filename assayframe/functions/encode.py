"""Encoders: one-hot, vector columns, imputation, q-gram counts, feature sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayframe import schemas as S
from assayframe.functions import grams, numeric as N, text as X
from assayframe.operators.splits import shuffled_rank


def one_hot_fixed(c: Column, levels: Sequence[str], prefix: str) -> dict[str, Column]:
    """0/1 per level plus a null indicator."""
    out = {f"{prefix}_{level}": F.when(c == level, 1).otherwise(0) for level in levels}
    out[f"{prefix}_nan"] = F.when(c.isNull(), 1).otherwise(0)
    return out


def _level_key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def learn_levels(train: DataFrame, column: str) -> DataFrame:
    """The training levels of a column, null included, each with a stable 0-based index."""
    levels = train.select(_level_key(F.col(column)).alias("level_key")).distinct()
    return shuffled_rank(levels, "level_key", rank="level_index", total="n_levels")


def one_hot_learned(df: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """The hot position of each row (``level_index``) and the width; an unseen level has none.

    Kept sparse: the dense form is ``dense_one_hot``. The level table joins by key, so it may grow.
    """
    levels = learn_levels(train, column)
    width = train.select(_level_key(F.col(column)).alias("k")).agg(F.count_distinct("k")).scalar()
    tagged = df.withColumn("level_key", _level_key(F.col(column)))
    return tagged.join(levels.drop("n_levels"), "level_key", "left").drop("level_key").withColumn("n_levels", width)


def dense_one_hot(index: Column, width: int) -> Column:
    return F.array(*[F.when(index == i, 1.0).otherwise(0.0) for i in range(width)])


def expand_vector(df: DataFrame, vector: str, width: int, prefix: str) -> DataFrame:
    """Array column to ``width`` columns; a null array gives nulls."""
    rest = [c for c in df.columns if c != vector]
    return df.select(*rest, *[F.get(F.col(vector), F.lit(i)).alias(f"{prefix}_{i}") for i in range(width)])


def feature_columns(df: DataFrame, exclude: Sequence[str] = (S.TARGET,)) -> list[str]:
    """Numeric columns only, minus the excluded ones."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-finite values count as missing; missing values become the column mean."""
    cleaned = df.withColumns({c: N.finite_or(F.col(c), None) for c in columns})
    means = cleaned.select(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
    return cleaned.withColumn("_fit", means).withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_fit.{c}")) for c in columns}).drop("_fit")


#: Rows of one task in which q-grams of different keys are added up: at most ``buckets`` counts for each.
KEYS_PER_TASK = 1 << 14


def key_tasks(df: DataFrame, key: str) -> int:
    """Tasks for a table whose rows are told apart by ``key``: the session's shuffle setting, and more where the rows are many."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.select(key).count() // KEYS_PER_TASK))


def qgram_counts(df: DataFrame, key: str, column: str, q: int = 4, buckets: int = 256) -> DataFrame:
    """Hashed q-gram counts: (key, bucket, n). Long texts are taken in pieces, so no row holds all grams of a text at once. A task counts
    the pieces of an Arrow batch by key and sends one list for each, so a frequent key (or null) sends at most ``buckets`` counts per
    batch; the lists are dealt by key over so many tasks that what one adds up does not grow with the table."""
    pieces = df.select(F.col(key).alias("key"), F.explode(X.overlapping_pieces(F.col(column), q - 1)).alias("piece"))
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("counts", T.ArrayType(T.LongType()))])
    lists = pieces.mapInArrow(lambda batches: grams.bucket_counts(batches, q, buckets), schema)
    one = lists.repartition(key_tasks(df, key), "key").select("key", F.explode("counts").alias("c"))
    return one.groupBy(F.col("key").alias(key), (F.col("c") % buckets).cast("int").alias("bucket")).agg(
        F.sum(F.expr(f"c div {buckets}")).alias("n"))


def expert_features(df: DataFrame, key: str = S.SUBJECT) -> DataFrame:
    return df.withColumns({
        "tail_c_number": X.leading_run_length(F.col(key)),
        "surfactant_class": X.subject_class(F.col(key)),
    })


def clean_vector(c: Column, fallback: float = 0.0) -> Column:
    """Infinite entries become ``fallback``, NaN entries become null."""
    return F.transform(c, lambda x: N.finite_or(x, fallback))
