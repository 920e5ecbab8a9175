"""Reproducible splits: rows are ordered by md5(seed | key), the same on every engine and layout.

Exact global ranks come without a global sort: rows are bucketed by the first hex digits of the md5,
ranked inside their bucket, and shifted by the row count of the earlier buckets. md5 of a unique key
spreads evenly, so no bucket runs hot however skewed the data are, and the table of bucket counts
has at most 16 ** HEX_DIGITS rows per group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayframe import schemas as S
from assayframe.session import store

HEX_DIGITS = 4


def order_hash(key: Column, seed: Column | int = S.SEED) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("|", seed.cast("string"), key.cast("string")))


def shuffled_rank(df: DataFrame, key: str, *, seed: Column | int = S.SEED, within: Sequence[str] = (),
                  rank: str = "rank", total: str = "n_total", hex_digits: int = HEX_DIGITS) -> DataFrame:
    """0-based exact rank in md5 order, over all rows or inside each ``within`` group, and the group size."""
    tagged = df.withColumn("_h", order_hash(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, hex_digits))
    counts = tagged.groupBy(*within, "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *within, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*within)).alias(total))
    place = F.row_number().over(Window.partitionBy(*within, "_b").orderBy("_h", key))
    return (
        tagged.withColumn("_place", place).join(offsets, [*within, "_b"])
        .withColumn(rank, F.col("_before") + F.col("_place") - 1)
        .drop("_h", "_b", "_place", "_before")
    )


def holdout(df: DataFrame, key: str, fraction: float = 0.2, *, rounding: str = "floor", seed: int = S.SEED) -> DataFrame:
    """``split`` is 'test' for the first ``fraction`` of the shuffled rows, else 'train'."""
    if rounding not in ("floor", "ceil"):
        raise ValueError("rounding is 'floor' or 'ceil'")
    share = F.col("n_total").cast("double") * F.lit(fraction)
    size = F.floor(share) if rounding == "floor" else F.ceil(share)
    return shuffled_rank(df, key, seed=seed).withColumn(
        "split", F.when(F.col("rank") < size, "test").otherwise("train")).drop("rank", "n_total")


def kfold(df: DataFrame, key: str, k: int = 5, *, seed: int = S.SEED) -> DataFrame:
    return shuffled_rank(df, key, seed=seed).withColumn("fold", (F.col("rank") % k).cast("int")).drop("rank", "n_total")


#: Bits of a value's order code that one pass of the selection settles.
DIGIT_BITS = 16
#: Values that are fetched at the end; more are cut down by another pass.
LAST_VALUES = 1 << 16
CODE = "code long, n long"


def order_codes(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles; -0.0 counts as 0.0, and NaN is above all."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def code_value(code: int) -> float:
    bits = np.int64(code)
    return float((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def _histogram(values: DataFrame, shift: int, kept: np.ndarray | None, kept_shift: int) -> DataFrame:
    """Rows for each code without its last ``shift`` bits, of codes that begin with one of ``kept``. Each task adds up its own."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            new = order_codes(batch.column(0).to_numpy(zero_copy_only=False))
            if kept is not None:
                new = new[np.isin(new >> kept_shift, kept)]
            found, n = np.unique(new >> shift, return_counts=True)
            codes, where = np.unique(np.concatenate([codes, found]), return_inverse=True)
            sums = np.bincount(where, np.concatenate([sums, n]).astype(np.float64), len(codes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], names=["code", "n"])

    return values.mapInArrow(count, CODE).groupBy("code").agg(F.sum("n").alias("n"))


def at_ranks(df: DataFrame, column: str, ranks: Callable[[int], Sequence[int]]) -> tuple[int, dict[int, float]]:
    """The number of values of a column, and those at the 0-based ``ranks`` of that number, exact: a radix selection.

    A pass counts the rows by the leading bits of their order codes and keeps the few beginnings that hold a wanted rank; the
    next one looks at the next bits of rows with these beginnings only. At most ``2 ** DIGIT_BITS`` counts for each wanted rank
    travel, whatever the values are; four passes settle all bits, and fewer do where few values are left.
    """
    values = store(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")))
    kept, kept_shift, shift, total, wanted = None, 64, 64 - DIGIT_BITS, 0, {}
    while True:
        rows = _histogram(values, shift, kept, kept_shift).toPandas().sort_values("code")
        codes, sums = rows["code"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        if kept is None:
            total = int(sums.sum())
            wanted = {r: r for r in ranks(total)} if total else {}  # rank, and rank among the rows that are looked at
        if not wanted:
            return total, {}
        ends = np.cumsum(sums)
        held = {r: int(np.searchsorted(ends, at, "right")) for r, at in wanted.items()}
        if shift == 0:
            return total, {r: code_value(codes[i]) for r, i in held.items()}
        places = sorted(set(held.values()))
        before = dict(zip(places, np.cumsum([0, *sums[places][:-1]]).tolist()))  # rows of kept beginnings that come earlier
        wanted = {r: before[i] + wanted[r] - int(ends[i] - sums[i]) for r, i in held.items()}
        kept, kept_shift = codes[places], shift
        shift = 0 if sums[places].sum() <= LAST_VALUES else shift - DIGIT_BITS


def exact_quantiles(df: DataFrame, column: str, fractions: Sequence[float]) -> DataFrame:
    """One row (fraction, value): linear-interpolated quantiles, exact without a sort; see :func:`at_ranks`."""
    ends = lambda n: {q: (math.floor((n - 1) * q), math.ceil((n - 1) * q)) for q in fractions}
    n, found = at_ranks(df, column, lambda n: {r for pair in ends(n).values() for r in pair})
    rows = [(float(q), found[a] + (found[b] - found[a]) * ((n - 1) * q - a)) for q, (a, b) in ends(n).items()] if n else []
    return df.sparkSession.createDataFrame(rows, "fraction double, value double")


def quantile_edges(df: DataFrame, column: str = S.TARGET, bins: int = 4, digits: int = 9) -> DataFrame:
    """One row with the sorted array of distinct bin edges, the extremes included."""
    edges = exact_quantiles(df, column, [i / bins for i in range(bins + 1)])
    return edges.agg(F.array_sort(F.collect_set(F.round("value", digits))).alias("edges"))


def with_quantile_bin(df: DataFrame, column: str = S.TARGET, bins: int = 4, digits: int = 9) -> DataFrame:
    """Right-closed quantile bin, lowest value included, duplicate edges dropped."""
    tagged = df.withColumn("_edges", quantile_edges(df, column, bins, digits).scalar())
    below = F.size(F.filter("_edges", lambda e: e < F.round(F.col(column), digits)))
    return tagged.withColumn("bin", F.greatest(F.lit(0), below - 1).cast("int")).drop("_edges")


def stratified_kfold(df: DataFrame, key: str, k: int = 5, *, stratum: str = "bin", seed: int = S.SEED) -> DataFrame:
    ranked = shuffled_rank(df, key, seed=seed, within=[stratum])
    return ranked.withColumn("fold", ((F.col("rank") + F.col(stratum)) % k).cast("int")).drop("rank", "n_total")


def nested_split(df: DataFrame, key: str, k: int = 5, fraction: float = 0.2, *, stratum: str = "bin",
                 fold: str = "fold", seed: int = S.SEED) -> DataFrame:
    """Each row once per outer fold it trains in, with its inner part: 'val' or 'train'."""
    outer = df.withColumn("outer_fold", F.explode(F.array(*[F.lit(i) for i in range(k)]))).where(
        F.col("outer_fold") != F.col(fold))
    ranked = shuffled_rank(outer, key, seed=F.lit(seed) + F.col("outer_fold") + 1, within=["outer_fold", stratum])
    size = F.floor(F.col("n_total").cast("double") * F.lit(fraction))
    return ranked.withColumn("part", F.when(F.col("rank") < size, "val").otherwise("train")).drop("rank", "n_total")
