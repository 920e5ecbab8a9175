"""Filter interaction audit: what each filter removes, in every order of the filters, by Lehmer-rank difference arrays.

A document is its mask, the set of filters that it fails. In an order of the filters it is removed at the first one of its mask. The
orders that begin with the same filters are one interval of the lexicographic ranks (Lehmer codes), so the orders in which a mask is
removed at a given step are few intervals: one for each beginning of filters outside the mask that ends with one of the mask.
Masks are counted per part first; each count is added at the start of its intervals and taken off at their ends, and one
running sum over the ranks gives the totals of every order at once. No document is ever paired with an order.

The filters run over batches of whole texts as bytes. Texts are named by SHA-256, so repeats are found without moving
texts; copies of a text are counted per part before they meet, and so are the masks of a part, however large.

Edge cases: a null text is empty (it fails the first filter, and the last one after an earlier empty text), a null source is the part
``''``. A null ``doc_id`` is smaller than none and larger than none, and has no labels. Repeated rows count as
often as they are there; rows of one ``doc_id`` are not repeats of each other. A document has a label if any of its label rows
says so. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Fixed values.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 50, 65, 5
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"
CONTINUED = bytes(range(0x80, 0xC0))

ORDERS = ["".join(p) for p in permutations(FILTERS)]


def failed(text: bytes) -> int:
    """The mask of the filters on a text alone: bit 0 for the first one. ``split`` parts at ASCII white space."""
    words = text.split()
    points = len(text) - _count(text, CONTINUED)
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
            | (100 * _count(text, CAPITALS) > MAX_CAPITALS_PERCENT * points) << 2 | (_count(text, MARKS) > 0) << 3)


def _count(text: bytes, members: bytes) -> int:
    return len(text) - len(text.translate(None, members))


def intervals() -> list[tuple[int, int, int, int]]:
    """``(mask, step, rank, sign)``: where a mask's removals at a step begin (+1) and end (-1) among the ranks of the orders."""
    n, out = len(FILTERS), []

    def grow(first: tuple[int, ...], rank: int) -> None:
        step = len(first) + 1
        rest = [f for f in range(n) if f not in first]
        width = math.factorial(n - step)
        for lehmer, f in enumerate(rest):
            start = rank + lehmer * width
            for mask in range(1 << n):
                if mask >> f & 1 and not any(mask >> g & 1 for g in first):
                    out.extend([(mask, step, start, 1), (mask, step, start + width, -1)])
            if step < n:
                grow((*first, f), start)

    grow((), 0)
    return out


def masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, name`` per document: the filters on its text alone, and the SHA-256 of its text."""
    kind = dict(docs.dtypes)["doc_id"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, names = [], []
            for text in batch.column("text"):
                text = text.as_buffer() if text.is_valid else None
                text = text.to_pybytes() if text is not None else b""
                found.append(failed(text))
                names.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(np.array(found, np.int32)), pa.array(names, pa.binary())],
                names=["doc_id", "part", "mask", "name"])

    read = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(judged, f"doc_id {kind}, part string, mask int, name binary")


def counted(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per ``part`` and ``mask``, repeats included: ``n, good, toxic``."""
    marked = labels.groupBy(F.col("doc_id").alias("_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    both = judged.join(marked, judged["doc_id"] == marked["_id"], "left").select(
        "doc_id", "part", "mask", "name", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    alike = ["name", "part", "mask", "good", "toxic"]
    rows = both.groupBy("doc_id", *alike).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("doc_id").isNotNull()
    groups = rows.groupBy(*alike).agg(
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("without_id"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("name"))
    earliest = F.when(F.col("first.doc_id") == F.col("_least"), F.col("first.n")).otherwise(0)
    parted = groups.withColumn("_least", least).select(
        "part", "mask", "good", "toxic", "n", (F.col("without_id") + earliest).alias("once"), (F.col("n") - earliest).alias("again"))
    last = F.lit(1 << FILTERS.index("E"))
    each = parted.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), F.col("once").alias("n")), F.struct(F.col("mask").bitwiseOR(last).alias("mask"), F.col("again").alias("n")))).alias("m"))
    return each.where("m.n > 0").groupBy("part", F.col("m.mask").alias("mask")).agg(
        F.sum("m.n").alias("n"), F.sum(F.col("m.n") * F.col("good")).alias("good"), F.sum(F.col("m.n") * F.col("toxic")).alias("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from :func:`counted` rows."""
    spark = counts.sparkSession
    has = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    n_if = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    totals = counts.groupBy("part").agg(
        F.sum("n").alias("total"), F.array(*[n_if(has(i)) for i in range(len(FILTERS))]).alias("failing"),
        F.array(*[n_if(F.col("mask") == 1 << i) for i in range(len(FILTERS))]).alias("alone"))
    ends = F.broadcast(spark.createDataFrame(intervals(), "mask int, step int, rank int, sign int"))  # a fixed table of 32 masks
    changes = counts.join(ends, "mask").groupBy("part", "step", "rank").agg(
        *[F.sum(F.col(c) * F.col("sign")).alias(c) for c in ("n", "good", "toxic")])
    every = totals.select("part", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")])
    dense = changes.where(F.col("rank") < len(ORDERS)).unionByName(every).groupBy("part", "step", "rank").agg(
        *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    upto = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = dense.select("part", "step", "rank", *[F.sum(c).over(upto).alias(o) for c, o in (
        ("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))])
    order = F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.col("rank") + 1)
    steps = removed.join(totals, "part").withColumn("filter_order", order).withColumn("filter", F.substr("filter_order", F.col("step"), F.lit(1)))
    place = F.expr(f"instr('{FILTERS}', filter)")
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(so_far)).alias("kept"), "removed",
        (F.element_at("failing", place) - F.col("removed")).alias("redundant"), F.element_at("alone", place).alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Audit the five filters over all documents; see :func:`audit`."""
    return audit(counted(masks(docs), labels))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs),
marked AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT d.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
     100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
     coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM worded d LEFT JOIN marked m ON d.doc_id = m.doc_id),
counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails),
f AS (SELECT unnest(range(1, 6)) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
played AS (
  SELECT c.*, o, coalesce(list_position(list_transform(o, lambda i: fails[i]), true), 6) AS gone
  FROM counts c, orders),
steps AS (
  SELECT part, o, s.i AS step, o[s.i] AS filter,
    coalesce(sum(n) FILTER (gone > s.i), 0) AS kept, coalesce(sum(n) FILTER (gone = s.i), 0) AS removed,
    coalesce(sum(n) FILTER (gone < s.i AND fails[o[s.i]]), 0) AS redundant,
    coalesce(sum(n) FILTER (fails[o[s.i]] AND len(list_filter(fails, lambda x: x)) = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (gone = s.i), 0) AS good_lost, coalesce(sum(toxic) FILTER (gone = s.i), 0) AS toxic_lost
  FROM played, f s GROUP BY part, o, s.i)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step::INT AS step,
  kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM steps
"""
