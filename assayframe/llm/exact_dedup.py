"""Exact dedup by deterministic block naming.

Each text is cut into blocks of a fixed number of characters. The distinct blocks are sorted and numbered;
then adjacent pairs of numbers are sorted and numbered again, level by level, until every document has one
number. Equal numbers of the same level mean equal texts: nothing is decided by a hash alone.

Edge cases: a null text counts as empty, and all empty texts are equal. Rows that repeat both ``doc_id`` and text
are rows of one group, of which one stays. A null ``doc_id`` loses against any other. An empty table gives an
empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from assayframe.llm.common import text_of
from assayframe.session import store

BLOCK_CHARS = 1024
MISSING = -1


def blocks(text: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters; an empty text is one empty piece."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def number(distinct: DataFrame, *order: str) -> DataFrame:
    """Number distinct rows: hash partitions, each sorted, each row named by partition and place.

    Partition and place depend on the rows alone, so a task that runs again gives the same numbers;
    the result must be stored before it is joined.
    """
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, size: int = BLOCK_CHARS, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: ``row, doc_id, text_sha256, level, name``; equal texts have equal (level, name).

    The blocks' text moves once, to be made distinct. Documents refer to a block by its fingerprint, and the
    names are joined by it; where a fingerprint stands for several blocks, all joins use the blocks themselves.
    """
    texts = docs.select("doc_id", text_of().alias("text"))
    cut = texts.select(F.explode(blocks(F.col("text"), size)).alias("block")).distinct()
    names = store(number(cut, "block").select(fingerprint(F.col("block")).alias("key"), "name"))
    keys = F.transform(blocks(F.col("text"), size), lambda block: fingerprint(block))
    if not names.groupBy("key").count().where("count > 1").isEmpty():
        names = store(number(cut, "block").withColumnRenamed("block", "key"))
        keys = blocks(F.col("text"), size)
    rows = store(texts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"),
        keys.alias("keys")))

    named = rows.select("row", F.size("keys").alias("width"), F.posexplode("keys").alias("pos", "key")).join(
        names, "key").select("row", "width", "pos", "name")
    longest = rows.agg(F.max(F.size("keys"))).first()[0] or 0
    named = store(named) if longest > 1 else named
    done, level = [named.where("width = 1").select("row", F.lit(0).alias("level"), "name")], 0
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        side = [F.max(F.when(F.col("pos") % 2 == i, F.col("name"))) for i in (0, 1)]
        pairs = named.where("width > 1").groupBy("row", "width", (F.col("pos") / 2).cast("int").alias("half")).agg(
            side[0].alias("first"), F.coalesce(side[1], F.lit(MISSING)).alias("second"))
        pairs = store(pairs.select("row", ((F.col("width") + 1) / 2).cast("int").alias("width"),
                                   F.col("half").alias("pos"), "first", "second"))
        names = store(number(pairs.select("first", "second").distinct(), "first", "second"))
        named = pairs.join(names, ["first", "second"]).select("row", "width", "pos", "name")
        named = store(named) if longest > 1 else named
        done.append(named.where("width = 1").select("row", F.lit(level).alias("level"), "name"))
    found = done[0]
    for more in done[1:]:
        found = found.unionAll(more)
    return rows.drop("keys").join(found, "row")


def exact_duplicates(docs: DataFrame, size: int = BLOCK_CHARS, **options) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``; the largest ``doc_id`` stays.

    Groups are counted with a partial aggregate; the counts join back on the group's number, where adaptive
    execution splits a group that holds a large share of the rows.
    """
    named = store(identities(docs, size, **options))
    groups = named.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "row")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    return named.join(groups, ["level", "name"]).select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keeper.row")).alias("kept"), "text_sha256")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
