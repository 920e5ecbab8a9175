"""Joins whose left side may hold a third of all rows under one key.

A frequent-items sketch (Misra-Gries counters, kept per task and merged) names every key above a share of the rows in
one pass. Rows of these keys are dealt over many tasks by a salt, and the right side's rows of the same few keys are repeated
for each salt. All other keys, and a side without such a key, are joined as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key is hot above this share of the rows: at most ``1 / HOT_SHARE`` keys are.
HOT_SHARE = 1 / 1024


def key_hash(on: list[str]) -> Column:
    """A 64-bit hash of a key, null like any other value. It only decides how rows travel, so collisions do no harm."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in on])


def hot_keys(df: DataFrame, on: list[str], share: float = HOT_SHARE) -> list[int]:
    """Hashes of all keys that hold more than ``share`` of the rows, and perhaps of some that hold a little less.

    The sketch's counts are off by at most ``3.5 / counters`` of the rows, which is under a quarter of ``share``; so at most
    ``4 / (3 * share)`` numbers reach the driver, whatever the size of the table.
    """
    counters = 1 << (int(14 / share) - 1).bit_length()
    listed = int(1.5 / share)
    sketch = df.select(key_hash(on).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(key, {listed}, {counters})").alias("top"))
    row = sketch.first()
    return [x["item"] for x in row["top"] or [] if x["count"] > share * row["n"]]


def salted(left: DataFrame, right: DataFrame, on: list[str], salt_by: list[str], hot: list[int], salts: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: rows of hot keys spread by a hash of ``salt_by`` on the left, repeated on the right."""
    is_hot = key_hash(on).isin(hot)
    spread = F.pmod(F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in salt_by]), F.lit(salts)).cast("int")
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("_salt", F.when(is_hot, spread).otherwise(0)), right.withColumn("_salt", F.explode(every))


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salt_by: list[str] | None = None,
              null_safe: bool = False, share: float = HOT_SHARE) -> DataFrame:
    """``left`` joined with ``right`` on equal columns ``on``, which appear once; ``how`` is inner, left, left_semi or left_anti.

    ``salt_by`` are columns of the left side that tell the rows of one key apart (all columns, if not given). With ``null_safe`` null keys
    equal each other; otherwise they match nothing, and many of them are dealt out like a hot key. No right row is taken twice, as
    a left row has one salt.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how={how!r}")
    hot = hot_keys(left, on, share)
    keys = list(on)
    if hot:
        salts = max(2, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        left, right = salted(left, right, on, salt_by or left.columns, hot, salts)
        keys = [*on, "_salt"]
    named = right.select(*[F.col(f"`{c}`").alias(f"_right_{i}") for i, c in enumerate(keys)], *[f"`{c}`" for c in right.columns if c not in keys])
    condition = None
    for i, c in enumerate(keys):
        one = left[f"`{c}`"].eqNullSafe(named[f"_right_{i}"]) if null_safe else left[f"`{c}`"] == named[f"_right_{i}"]
        condition = one if condition is None else condition & one
    return left.join(named, condition, how).drop("_salt", *[f"_right_{i}" for i in range(len(keys))])
