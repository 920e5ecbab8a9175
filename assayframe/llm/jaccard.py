"""N-gram Jaccard join by vertical partitioning.

All n-grams stand in one global order, from rare to common; the order is cut into fragments. A document is its set of
n-grams. Two documents can link only if they share an n-gram among the first few of both (the first fragment: a
prefix of each document), and at places that leave room for the needed overlap. For such pairs the prefixes alone give a bound
that rules out most; for the rest the n-grams that both have are counted fragment by fragment and summed per pair.

The order comes from all words and n-grams of all documents, counted in tables of ``2 ** BUCKET_BITS`` hash buckets:
an n-gram is as common as the least of its own count and its words' counts, ties go by hash. The tables have one size
whatever the input, and steer only the work: any order gives the same links. Documents of equal words are one node.

No group emits all its pairs: each member of a group that shares an n-gram is first compared to the group's most
common member (the least changed copy), and afterwards only members still in different components are paired, in
the places that can still link.

Edge cases: a null text and one without words have no n-grams and link with nothing. A text shorter than an n-gram is one
n-gram. Repeated rows are copies. An empty table gives an empty result. Nodes are 64-bit hashes; n-grams are 64-bit
hashes within a document and 52 bits with their level in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayframe.llm import ngrams
from assayframe.llm.graph import components
from assayframe.session import store

GRAM_WORDS = 3
PERCENT = 90
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Buckets of one row of a counts table, and levels of one doubling of a count.
PART_BUCKETS = 1 << 14
LEVEL_STEPS = 32
LEVEL_SHIFT = 52
FRAGMENTS = 8
MASK = np.uint64(BUCKETS - 1)


def counted(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, node, n`` of every document; and of every task its counts of words and n-grams, as rows ``part, counts``."""
    kind = dict(docs.dtypes)["doc_id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, id_type = [np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)], None
        for batch in batches:
            id_type = batch.column("doc_id").type
            for row, rows, words, n_words in ngrams.slices(batch.column("text")):
                grams, node, size = ngrams.Grams(words, n_words, n), [], []
                ends, at = np.cumsum(n_words), np.cumsum(grams.sizes)
                distinct = []
                for i in range(rows):
                    node.append(ngrams.identity(words[ends[i] - n_words[i]:ends[i]]))
                    own = np.unique(grams.hashes[at[i] - grams.sizes[i]:at[i]])
                    size.append(len(own))
                    distinct.append(own)
                for table, found in zip(tables, (words, np.concatenate(distinct))):
                    table += np.bincount((found & MASK).astype(np.int64), minlength=BUCKETS).astype(np.int32)
                yield made(batch.column("doc_id").slice(row, rows), node, size, [None] * rows, [None] * rows)
        if id_type is not None:
            parts = [t[i:i + PART_BUCKETS].tobytes() for t in tables for i in range(0, BUCKETS, PART_BUCKETS)]
            none = [None] * len(parts)
            yield made(pa.nulls(len(parts), id_type), none, none, list(range(len(parts))), parts)

    def made(ids, node, size, part, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(part, pa.int32()),
                                           pa.array(counts, pa.binary())], names=["doc_id", "node", "n", "part", "counts"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(count, f"doc_id {kind}, node long, n long, part int, counts binary")


def levels(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The logarithm of each bucket's count, of words and of n-grams. The driver gets two tables of fixed size."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(data, np.int32).astype(np.int64)
        found = [np.floor(np.log2(s + 1.0) * LEVEL_STEPS).astype(np.uint16).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(found, pa.binary())], names=["part", "counts"])

    added = counts.select("part", "counts").where("part IS NOT NULL").repartition("part").mapInArrow(add, "part int, counts binary")
    both = np.zeros(2 * BUCKETS, np.uint16)
    for part, data in added.collect():
        both[part * PART_BUCKETS:(part + 1) * PART_BUCKETS] = np.frombuffer(data, np.uint16)
    return both[:BUCKETS], both[BUCKETS:]


class Order:
    """The global order: an n-gram's place is its level, then its hash."""

    def __init__(self, words: np.ndarray, grams: np.ndarray):
        self.words, self.grams = words, grams
        mass = np.bincount(grams, weights=np.exp2(grams / LEVEL_STEPS))
        self.pivots = np.unique(np.searchsorted(np.cumsum(mass), np.arange(1, FRAGMENTS) * mass.sum() / FRAGMENTS))

    def places(self, grams: ngrams.Grams) -> np.ndarray:
        level = self.grams[(grams.hashes & MASK).astype(np.int64)]
        of_word = self.words[(grams.words & MASK).astype(np.int64)]
        for member in grams.members:
            level = np.minimum(level, of_word[member])
        return ((level.astype(np.uint64) << np.uint64(LEVEL_SHIFT)) | (grams.hashes >> np.uint64(64 - LEVEL_SHIFT))).view(np.int64)

    def sets(self, column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, node, distinct n-grams in order) of every text."""
        for row, rows, words, n_words in ngrams.slices(column):
            grams = ngrams.Grams(words, n_words, n)
            places, ends, at = self.places(grams), np.cumsum(n_words), np.cumsum(grams.sizes)
            for i in range(rows):
                yield row + i, ngrams.identity(words[ends[i] - n_words[i]:ends[i]]), np.unique(places[at[i] - grams.sizes[i]:at[i]])


def prefixes(docs: DataFrame, order: Order, n: int, percent: int) -> DataFrame:
    """``node, n, prefix``: the first n-grams of each document, one of which any partner must share."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, prefix = [], [], []
            for _, own, grams in order.sets(batch.column("text"), n):
                if len(grams):
                    node.append(own)
                    size.append(len(grams))
                    prefix.append(grams[:len(grams) - (percent * len(grams) + 99) // 100 + 1])
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(prefix) if prefix else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(size, pa.int64()), lists], names=["node", "n", "prefix"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(first, "node long, n long, prefix array<long>")


def segments(docs: DataFrame, order: Order, n: int) -> DataFrame:
    """``node, fragment, part``: the n-grams of each document, cut where the fragments of the global order begin."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = order.pivots.astype(np.int64) << LEVEL_SHIFT
        for batch in batches:
            node, fragment, parts = [], [], []
            for _, own, grams in order.sets(batch.column("text"), n):
                for i, part in enumerate(np.split(grams, np.searchsorted(grams, pivots))):
                    if len(part):
                        node.append(own)
                        fragment.append(i)
                        parts.append(part)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(fragment, pa.int32()), lists], names=["node", "fragment", "part"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(cut, "node long, fragment int, part array<long>")


def needed(a: Column, b: Column, percent: int) -> Column:
    """The fewest n-grams that two sets of these sizes share when they link."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def room(percent: int) -> Column:
    """Whether sizes and places of a shared n-gram leave room for the overlap that a link needs."""
    least = needed(F.col("n_u"), F.col("n_v"), percent)
    return (100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")) & (
        F.col("n_u") - F.col("pos_u") >= least) & (F.col("n_v") - F.col("pos_v") >= least)


def as_side(members: DataFrame, side: str, *more: str) -> DataFrame:
    return members.select("gram", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "pos", *more)])


def larger_first() -> list[Column]:
    """``node_u, node_v, n_u, n_v`` of a pair, so that the larger set is ``u`` (of equal ones, the larger node)."""
    u, v = (F.struct(F.col(f"n_{s}").alias("n"), F.col(f"node_{s}").alias("node")) for s in "uv")
    large, small = F.greatest(u, v), F.least(u, v)
    return [large["node"].alias("node_u"), small["node"].alias("node_v"), large["n"].alias("n_u"), small["n"].alias("n_v")]


def close_pairs(pairs: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    """The pairs ``node_u, node_v, n_u, n_v`` that may link by the bound that their prefixes give, stored."""
    side = lambda s: prefix.select(F.col("node").alias(f"node_{s}"), F.col("prefix").alias(f"prefix_{s}"))
    both = pairs.join(side("u"), "node_u").join(side("v"), "node_v")
    known = F.least(F.element_at("prefix_u", -1), F.element_at("prefix_v", -1))  # both sets are known up to here
    upto = lambda s: F.size(F.filter(f"prefix_{s}", lambda x: x <= F.col("known")))
    shared = F.size(F.array_intersect("prefix_u", "prefix_v"))
    bound = shared + F.least(F.col("n_u") - upto("u"), F.col("n_v") - upto("v"))
    return store(both.withColumn("known", known).where(bound >= needed(F.col("n_u"), F.col("n_v"), percent)).select(
        "node_u", "node_v", "n_u", "n_v"))


def one_document(close: DataFrame, members_of: DataFrame) -> DataFrame:
    """The hashed ``doc_id`` of one document of each node in ``close``, as ``key``."""
    nodes = close.select(F.explode(F.array("node_u", "node_v")).alias("node")).distinct()
    return members_of.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("_doc")).select(F.xxhash64("_doc").alias("key")).distinct()


def parts_of(docs: DataFrame, wanted: DataFrame, order: Order, n: int) -> DataFrame:
    """The :func:`segments` of the documents with a key in ``wanted``, stored."""
    texts = docs.select(F.xxhash64("doc_id").alias("key"), "text").join(wanted, "key", "left_semi").distinct()
    return store(segments(texts, order, n))


def links_of(close: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``close`` that link, counted fragment by fragment."""
    part = lambda s: parts.select(F.col("node").alias(f"node_{s}"), "fragment", F.col("part").alias(f"part_{s}"))
    counted = close.join(part("u"), "node_u").join(part("v"), ["node_v", "fragment"]).groupBy("node_u", "node_v", "n_u", "n_v", "fragment").agg(
        F.max(F.size(F.array_intersect("part_u", "part_v"))).alias("shared")).groupBy("node_u", "node_v", "n_u", "n_v").agg(
        F.sum("shared").alias("total"))
    return counted.where(F.lit(100) * F.col("total") >= F.lit(percent) * (F.col("n_u") + F.col("n_v") - F.col("total"))).select("node_u", "node_v")


def classes(docs: DataFrame, members_of: DataFrame, order: Order, n: int, percent: int) -> DataFrame:
    """``node, component`` for every node that links with another."""
    chosen = store(prefixes(docs, order, n, percent))
    level = F.shiftright(F.element_at("prefix", 1), LEVEL_SHIFT)  # of the rarest n-gram: changed copies have rarer ones
    postings = chosen.select("node", "n", level.alias("level"), F.posexplode("prefix").alias("pos", "gram"))
    groups = store(postings.groupBy("gram").agg(F.min("node").alias("_a"), F.max("node").alias("_b"), F.max("level").alias("top")).where(
        "_a < _b").select("gram", "top"))
    members = store(postings.join(groups.hint("merge"), "gram").distinct())
    hubs = members.where("level = top").groupBy("gram").agg(F.min(F.struct("node", "n", "pos")).alias("hub")).select("gram", "hub.*")
    first = store(as_side(members, "u").join(as_side(hubs, "v"), "gram").where(
        (F.col("node_u") != F.col("node_v")) & room(percent)).select(*larger_first()).distinct())
    nodes = store(members.select("node").distinct())
    prefix = store(chosen.join(nodes, "node", "left_semi").select("node", "prefix").dropDuplicates(["node"]))
    close = close_pairs(first, prefix, percent)
    parts = parts_of(docs, one_document(close, members_of).hint("merge"), order, n)
    links = store(links_of(close, parts, percent))
    known = store(components(links, "node_u", "node_v"))

    labelled = members.join(known, "node", "left").select("gram", "node", "n", "pos", F.coalesce("component", "node").alias("component"))
    open_groups = labelled.groupBy("gram").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a < _b").select("gram")
    still = store(labelled.join(store(open_groups), "gram"))
    smaller = still.where(F.col("n") - F.col("pos") >= needed(F.col("n"), F.col("n"), percent))  # as the smaller of a pair
    ordered = (F.col("n_u") > F.col("n_v")) | ((F.col("n_u") == F.col("n_v")) & (F.col("node_u") > F.col("node_v")))
    cross = as_side(still, "u", "component").join(as_side(smaller, "v", "component"), "gram").where(
        ordered & (F.col("component_u") != F.col("component_v")) & room(percent)).select("node_u", "node_v", "n_u", "n_v").distinct()
    cross = cross.join(first.select("node_u", "node_v"), ["node_u", "node_v"], "left_anti")  # those are decided
    close = close_pairs(cross, prefix, percent)
    more = links_of(close, parts_of(docs, one_document(close, members_of), order, n), percent)
    return components(links.unionByName(more), "node_u", "node_v")


def near_duplicates(docs: DataFrame, gram_words: int = GRAM_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (the least ``doc_id`` reachable by links)."""
    found = store(counted(docs, gram_words))
    members = found.where("part IS NULL").select("doc_id", "node", F.col("n").alias("n_shingles"))
    linked = store(classes(docs, members.where("n_shingles > 0"), Order(*levels(found)), gram_words, percent))
    label = members.where("n_shingles > 0").select("doc_id", "node").join(linked, "node", "left").select(
        "node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = label.groupBy("component").agg(F.min("doc_id").alias("least"))
    of_node = store(label.select("node", "component").distinct().join(least, "component").select("node", "least"))
    return members.join(of_node, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, gram_words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the least of their class, in the columns of ``docs``; repeated rows stay once."""
    labelled = near_duplicates(docs, gram_words, percent).where("doc_id <=> component_id").select(
        F.col("doc_id").alias("_kept")).distinct()
    return docs.join(labelled, docs["doc_id"].eqNullSafe(labelled["_kept"]), "left_semi").dropDuplicates()
