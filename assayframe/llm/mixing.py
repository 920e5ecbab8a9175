"""Mixing sources to target weights, in blocks.

The words of a source are one stream, cut into blocks of a fixed length. Each output shard draws how many of its
slots go to each source from a multinomial distribution; the slots of a source, counted over the shards, are
mapped through a pseudorandom permutation of the source's block numbers (a new one for each pass over the
source), and the blocks are joined by number. What the draws give a source beyond its share is left
out, and what they miss is drawn in closing shards, so the total of each source is its target to within a block.

Edge cases: a null text has no words and is never taken; a null source is a source like any other, the last in
order. Repeated rows are separate documents. A source without words has target 0. An empty table gives an empty
result. The driver holds a few numbers per source, never anything per document or block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from assayframe.llm.common import WORD, running_start, text_of
from assayframe.session import store

BLOCK_WORDS = 64
SHARD_SLOTS = 1024
SEED = 20
#: Weights by rank of the source, repeating, and the most times a source is repeated.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_TIMES = 3.0


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source",
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))


def targets(rows: DataFrame, weights=WEIGHTS, share: float = 1.0, most: float = MAX_TIMES) -> DataFrame:
    """One row per source: ``source, rank, source_size, target``.

    A target is ``least(most * size, level * weight)``; the level is where the targets add up to the share.
    Sources in the order in which they reach their limit have falling levels, so the level is read off running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    everything = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = sources.withColumn("weight", weight).withColumn("limit", most * F.col("source_size")).withColumns({
        "_left": share * F.sum("source_size").over(everything)
        - F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_weights": F.sum("weight").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    }).withColumn("_level", F.col("_left") / F.col("_weights"))
    level = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("limit"), F.struct(
        F.col("limit") / F.col("weight"), "rank", F.col("_level").alias("level")))).over(everything)["level"]
    return capped.withColumn("target", F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit")))).select(
        "source", "rank", "source_size", "target")


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Map each index below ``size`` to another, one to one for each key: a Feistel network walked until in range."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for turn in range(4):
            mixed = (right + key[todo] + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            left, right = right, left ^ (mixed & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = out >= size.astype(np.uint64)
    return out.astype(np.int64)


def plan_of(source_rows: list, block: int) -> pd.DataFrame:
    """Blocks and wanted slots of each source, by rank."""
    plan = pd.DataFrame([(r["rank"], r["source_size"], r["target"]) for r in source_rows], columns=["rank", "size", "target"])
    plan = plan.sort_values("rank").reset_index(drop=True)
    plan["blocks"] = -(-plan["size"] // block)
    plan["slots"] = np.minimum(
        np.rint(plan["target"] * plan["blocks"] / np.maximum(plan["size"], 1)), MAX_TIMES * plan["blocks"]).astype(np.int64)
    return plan


def slots(spark, plan: pd.DataFrame, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: ``shard, slot, rank, block``, one row per slot, in the order of the output."""
    total = int(plan["slots"].sum())
    n_shards, wanted, blocks = -(-total // shard_slots), plan["slots"].to_numpy(), plan["blocks"].to_numpy()
    chances = wanted / max(total, 1)

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            shards = part["id"].to_numpy()
            drawn = np.array([np.random.default_rng([seed, shard]).multinomial(
                min(shard_slots, total - shard * shard_slots), chances) for shard in shards])
            at, rank = np.nonzero(drawn)
            yield pd.DataFrame({"rank": rank, "shard": shards[at], "n": drawn[at, rank]})

    draws = store(spark.range(n_shards).mapInPandas(draw, "rank long, shard long, n long"))
    # The shards of a source are spread over all buckets of the running sum, in their order.
    in_order = F.shiftleft(F.col("shard"), 63 - max(n_shards, 1).bit_length())
    runs = running_start(draws, ["rank"], in_order, "shard", "n", "first").select("rank", "shard", "n", "first")
    wanted_rows = spark.createDataFrame(plan[["rank", "slots"]], "rank long, slots long")
    missed = draws.groupBy("rank").agg(F.sum("n").alias("drawn")).join(wanted_rows, "rank", "right").select(
        "rank", F.coalesce("drawn", F.lit(0)).alias("drawn"), "slots").where("slots > drawn")
    closing = missed.select("rank", "slots", F.explode(F.sequence("drawn", F.col("slots") - 1, F.lit(shard_slots))).alias("first"))
    runs = runs.unionByName(closing.select(
        "rank", F.lit(n_shards).cast("long").alias("shard"), F.least(F.col("slots") - F.col("first"), F.lit(shard_slots)).alias("n"), "first"))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n = part["n"].to_numpy()
            rank = np.repeat(part["rank"].to_numpy(), n)
            slot = np.repeat(part["first"].to_numpy() - np.cumsum(n) + n, n) + np.arange(n.sum())
            shard, here = np.repeat(part["shard"].to_numpy(), n), slot < wanted[rank]
            rank, slot, shard = rank[here], slot[here], shard[here]
            size = blocks[rank]
            key = (np.uint64(seed) << np.uint64(40)) ^ (rank.astype(np.uint64) << np.uint64(8)) ^ (slot // size).astype(np.uint64)
            block = permuted(slot % size, size, key * np.uint64(0xD6E8FEB86659FD93))
            yield pd.DataFrame({"shard": shard, "slot": slot, "rank": rank, "block": block})

    return runs.mapInPandas(place, "shard long, slot long, rank long, block long")


def mix(rows: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """From stored ``row, doc_id, source, size``: the documents with their targets, and their pieces.

    A piece is the part of a document inside one block: ``row, block, words, times`` (``times``: how often it is taken, also 0).
    """
    sources = store(targets(rows))
    plan = plan_of(sources.collect(), block)
    taken = slots(rows.sparkSession, plan, seed).groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    ranked = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = store(running_start(ranked, ["rank"], F.xxhash64("row"), "row", "size", "start"))
    block_of = lambda c: F.floor(c / block).cast("long")
    end = F.col("start") + F.col("size")
    pieces = placed.where("size > 0").select(
        "row", "rank", "start", end.alias("end"),
        F.explode(F.sequence(block_of(F.col("start")), block_of(end - 1))).alias("block"))
    pieces = pieces.select("row", "rank", "block", "start", (
        F.least("end", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)).alias("words"))
    return placed, pieces.join(taken, ["rank", "block"], "left").select(
        "row", "block", "start", "words", F.coalesce("times", F.lit(0)).alias("times"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``."""
    placed, pieces = mix(store(sizes(docs)))
    taken = pieces.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return placed.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixture(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents, in the columns of ``docs``: copy number ``k`` of a document has the words of its blocks
    that are taken more than ``k`` times, with the white space before them; a copy without words is left out."""
    kept = store(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*docs.columns).alias("_doc")))
    rows = store(kept.select(
        F.col("_row").alias("row"), "_doc.doc_id", "_doc.source",
        F.regexp_count(F.coalesce("_doc.text", F.lit("")), F.lit(WORD)).cast("long").alias("size")))
    _, pieces = mix(rows, block)
    # All blocks of a document are in a row, so a word finds its block by place.
    times = pieces.groupBy("row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("block", "times"))), lambda b: b["times"]).alias("times"),
        F.first("start").alias("start"), F.max("times").alias("most")).where("most > 0")
    words = F.regexp_extract_all(F.col("_doc.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    copies = kept.join(times, kept["_row"] == times["row"]).select(
        "_doc", "times", "start", words.alias("words"), F.explode(F.sequence(F.lit(0), F.col("most").cast("int") - 1)).alias("copy"))
    place = lambda i: (F.floor((F.col("start") + i) / block) - F.floor(F.col("start") / block)).cast("int")
    text = F.array_join(F.filter("words", lambda w, i: F.get("times", place(i)) > F.col("copy")), "")
    out = copies.select("_doc", text.alias("text")).where("text <> ''")
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"_doc.`{c}`") for c in docs.columns])
