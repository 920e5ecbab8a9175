"""Embedding near-dedup by sorted projection passes.

Each pass gives every vector a hash: the signs of its projections on random directions, end to end. Vectors of a label are put in the
lexicographic order of these hashes, where near vectors share a long beginning and so stand close together, and every vector
is compared with those in a bounded window before it. Pairs of at least the least cosine (in double precision) are united over
the passes, and the classes are the connected components of all of them.

- Vectors that are equal are one from the start, and count as often as they are there.
- A pass misses a pair that its first signs part. The number of passes follows from the size of the largest label, so that a pair of
  exactly the least cosine is missed by all of them with a chance of at most ``MISS``; nearer pairs are missed far less.
- A task sends on only what unites its windows (each vector with the least of its class so far), at most two links a vector and pass, however
  many near copies there are. Windows run over the borders of tasks: each task hands its first and last rows on.
- In a class that is larger than a window not all links are seen in the passes. So links are counted inside the classes afterwards,
  block by block: a class is cut into blocks by a hash and each pair of blocks is one small matrix product in some task. That
  counts all links of a vector, whatever the size of its class, without a pair ever being a row.

Edge cases: rows with a null label, a null or empty vector, a null or non-finite component or only zeros link with nothing and are their
own class. Vectors of different lengths are never compared. Repeated rows and ids are separate vectors; a null ``vec_id`` is larger than
all others as the name of a class, and a class of null ids only has a null name and keeps its rows. An empty table gives an empty
result. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from assayframe.llm.graph import components
from assayframe.operators.skew import skew_join
from assayframe.session import store

LEAST_COSINE = 0.98
#: Rows of a window's half: a vector meets at least so many before it, and at most twice as many.
WINDOW_ROWS = 256
#: The most likely share of pairs at the least cosine that all passes miss.
MISS = 1e-4
#: Signs in a hash.
SIGNS = 62
#: Rows of a block in which links are counted.
BLOCK_ROWS = 1024
SEED = 11


def passes_for(rows: int, least: float = LEAST_COSINE, window: int = WINDOW_ROWS, miss: float = MISS) -> int:
    """Passes over a label of so many vectors. In random order of beginnings a window spans about ``log2(rows / window)`` signs,
    one more to be safe; two vectors share a sign with a chance that follows from their angle."""
    shared = 1 - math.acos(least) / math.pi
    depth = max(0.0, math.log2(max(1, rows) / window)) + 1
    return max(1, math.ceil(math.log(miss) / math.log1p(-shared ** depth)))


def directions(length: int, number: int) -> np.ndarray:
    """Random directions of one pass, the same in every task and run."""
    return np.random.default_rng([SEED, length, number]).standard_normal((length, SIGNS))


def usable(label: str = "label", vector: str = "embedding"):
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(label).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def units(column: pa.Array, length: int) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, length)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows, and the end."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)


def union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of ``n`` places' class under the links ``a, b``."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if (new == least).all():
            return least
        least = new


class Windows:
    """Rows in hash order, compared block by block with the block before."""

    def __init__(self, least: float, rows: int):
        self.least, self.rows, self.group = least, rows, None
        self._reset()

    def _reset(self) -> None:
        self.before = None
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, group: tuple, nodes: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if group != self.group:
            yield from self.close()
            self.group = group
        at = 0
        while at < len(nodes):
            take = min(self.rows - self.size, len(nodes) - at)
            self.held.append((nodes[at:at + take], x[at:at + take]))
            self.size, at = self.size + take, at + take
            if self.size == self.rows:
                yield self._compare()

    def _compare(self) -> tuple[np.ndarray, np.ndarray]:
        nodes, x = (np.concatenate(c) for c in zip(*self.held))
        all_nodes, every = (np.concatenate([o, n]) for o, n in zip(self.before, (nodes, x))) if self.before else (nodes, x)
        old = len(all_nodes) - len(nodes)
        mine, other = np.nonzero(x @ every.T >= self.least)
        keep = other < mine + old
        classes = union(len(all_nodes), mine[keep] + old, other[keep])
        moved = np.flatnonzero(classes != np.arange(len(classes)))
        self.before, self.held, self.size = (nodes, x), [], 0
        return all_nodes[moved], all_nodes[classes[moved]]

    def close(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.size:
            yield self._compare()
        self._reset()


def _grouped(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, np.ndarray, pa.Array]]:
    """Runs of rows of one group: its values, nodes, and vectors."""
    columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
    nodes, vectors = batch.column("node").to_numpy(), batch.column("embedding")
    ends = runs(*columns)
    for a, b in zip(ends[:-1], ends[1:]):
        if b > a:
            yield tuple(c[a] for c in columns), nodes[a:b], vectors.slice(a, b - a)


def _links(found: Iterator[tuple[np.ndarray, np.ndarray]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for a, b in found:
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *[pa.nulls(len(a), f.type) for f in list(schema)[2:]]], schema=schema)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Each distinct vector of a label once: ``node`` (its least row), ``label, embedding, copies, least_id``."""
    return rows.where(usable()).groupBy("label", "embedding").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id"))


def hashed(vectors: DataFrame, passes: int) -> DataFrame:
    """One row per vector and pass: ``pass, label_key, length, key, node, embedding``."""
    kind = dict(vectors.dtypes)["embedding"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
        known: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for length in np.unique(lengths):
                some = batch.filter(pa.array(lengths == length))
                x = units(some.column("embedding"), int(length))
                if length not in known:
                    known[length] = [directions(int(length), p) for p in range(passes)]
                for p, r in enumerate(known[length]):
                    key = (x @ r > 0).astype(np.int64) @ weights
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), p, np.int32)), some.column("label_key"), some.column("length"), pa.array(key), some.column("node"),
                         some.column("embedding")], names=["pass", "label_key", "length", "key", "node", "embedding"])

    keyed = vectors.select(F.col("label").cast("string").alias("label_key"), F.size("embedding").alias("length"), "node", "embedding")
    return keyed.mapInArrow(project, f"pass int, label_key string, length int, key long, node long, embedding {kind}")


GROUP = ["pass", "label_key", "length"]


def windows(ordered: DataFrame, least: float, window: int) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` that unite the near vectors of each window, inside tasks and over their borders."""
    kind = dict(ordered.dtypes)["embedding"]
    columns = f"a long, b long, part int, side int, pass int, label_key string, length int, key long, node long, embedding {kind}"

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, seen, schema, last = TaskContext.get().partitionId(), Windows(least, window), 0, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("side", pa.int32()), *batch.schema])
            if seen < window:  # the rows that follow on the task before, if they are of its group
                yield _edge(batch.slice(0, window - seen), part, 1, schema)
                seen += batch.num_rows
            for group, nodes, vectors in _grouped(batch, GROUP):
                yield from _links(at.add(group, nodes, units(vectors, int(group[2]))), schema)
            last = [*last, batch]
            while len(last) > 1 and sum(b.num_rows for b in last[1:]) >= window:
                last = last[1:]
        if schema is not None:
            yield from _links(at.close(), schema)
            left = window
            for batch in reversed(last):
                if left:
                    taken = batch.slice(max(0, batch.num_rows - left))
                    left -= taken.num_rows
                    yield _edge(taken, part, 0, schema)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, at = pa.schema([("a", pa.int64()), ("b", pa.int64())]), Windows(least, 2 * window)
        for batch in batches:
            for group, nodes, vectors in _grouped(batch, ["border", *GROUP]):
                yield from _links(at.add(group, nodes, units(vectors, int(group[3]))), schema)
        yield from _links(at.close(), schema)

    found = store(ordered.mapInArrow(inside, columns))
    edges = found.where("node IS NOT NULL")
    parts = edges.select("part").distinct().select("part", F.row_number().over(Window.orderBy("part")).alias("number"))  # a row for each task
    border = F.col("number") - F.col("side")
    met = edges.join(F.broadcast(parts), "part").select(border.alias("border"), "side", *GROUP, "key", "node", "embedding")
    by = ["border", *GROUP]
    between = met.repartition(*by).sortWithinPartitions(*by, "side", "key", "node").select(*by, "node", "embedding").mapInArrow(across, "a long, b long")
    return found.where("node IS NULL").select("a", "b"), between


def _edge(batch: pa.RecordBatch, part: int, side: int, schema: pa.Schema) -> pa.RecordBatch:
    n = batch.num_rows
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, part, np.int32)),
                                       pa.array(np.full(n, side, np.int32)), *batch.columns], schema=schema)


def near_links(vectors: DataFrame, least: float = LEAST_COSINE, window: int = WINDOW_ROWS, miss: float = MISS) -> DataFrame:
    """Links ``a, b`` over ``node`` whose components are the classes of near vectors."""
    largest = vectors.groupBy("label", F.size("embedding")).count().agg(F.max("count")).first()[0] or 0
    order = [*GROUP, "key", "node"]
    ordered = hashed(vectors, passes_for(largest, least, window, miss)).repartitionByRange(*order).sortWithinPartitions(*order)
    inside, between = windows(ordered, least, window)
    return inside.unionAll(between)


def links_inside(members: DataFrame, least: float = LEAST_COSINE, block: int = BLOCK_ROWS) -> DataFrame:
    """``node, n_links``: near vectors of each member of ``component, size, node, copies, embedding`` in its class, copies counted."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    cut = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cell = ["component", "low", "high"]
    cells = cut.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "copies",
                       F.size("embedding").alias("length"), "embedding")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = [*cell, "length"]

        def counted() -> pa.RecordBatch:
            ids, own_of, nodes, copies, x = (np.concatenate(c) for c in zip(*[h[1:] for h in held]))
            near = x @ x.T >= least
            near &= ids[:, None] == ids
            near &= (own_of[:, None] != own_of) | (single[ids][:, None])
            np.fill_diagonal(near, False)
            n = near @ copies
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(n)], names=["node", "n"])

        number, size, group, single = -1, 0, None, np.empty(0, bool)
        flags: list[bool] = []
        for batch in batches:
            columns = [batch.column(n).to_numpy() for n in names]
            own_of, nodes, copies = (batch.column(n).to_numpy() for n in ("own", "node", "copies"))
            ends = runs(*columns)
            for a, b in zip(ends[:-1], ends[1:]):
                if b <= a:
                    continue
                key = tuple(c[a] for c in columns)
                if key != group:
                    if held and (size >= block or key[3] != group[3]):
                        single = np.array(flags)
                        yield counted()
                        held, flags, number, size = [], [], -1, 0
                    group, number = key, number + 1
                    flags.append(key[1] == key[2])
                size += b - a
                held.append((key, np.full(b - a, number), own_of[a:b], nodes[a:b], copies[a:b], units(batch.column("embedding").slice(a, b - a), int(key[3]))))
        if held:
            single = np.array(flags)
            yield counted()

    dealt = cells.repartition(*cell).sortWithinPartitions(*cell, "own")
    return dealt.mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n_links"))


def near_vectors(embeddings: DataFrame, least: float = LEAST_COSINE, window: int = WINDOW_ROWS, miss: float = MISS, block: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    rows = store(embeddings.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding"))
    vectors = store(distinct_vectors(rows))
    classes = store(components(near_links(vectors, least, window, miss)))
    members = vectors.join(classes, "node")
    of_class = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("least_id").alias("component_id"))
    in_class = store(skew_join(members.select("component", "node", "copies", "embedding"), of_class, ["component"], salt_by=["node"]))
    linked = in_class.select("node", "component_id").join(links_inside(in_class, least, block), "node")
    named = vectors.join(linked.withColumn("_near", F.lit(True)), "node", "left").select(
        "label", "embedding", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"),
        F.when(F.col("_near"), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id"), F.lit(True).alias("_usable"))
    out = skew_join(rows, named, ["label", "embedding"], "left", salt_by=["row"])
    own = F.when(F.col("_usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM least
"""
