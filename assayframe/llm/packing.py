"""Mixture-controlled packing by deficit round-robin over the sources.

Every source is a queue of documents. In each round (a window of ``WINDOW_SEQUENCES`` sequences) a source earns
its share of the window in tokens and sends whole documents while its credit lasts; what is left is carried to the
next round, across windows and tasks alike. With credit that is never lost, a document leaves in the round in
which its source's earnings reach the end of the document, so the schedule follows from running sums of
tokens per source and no task plays the queues one by one. The rounds, laid end to end, are cut into sequences: only the
last sequence of all is not full.

Edge cases: a null text is an empty document of one token, the end id; a null source is a queue of its own. Repeated rows
are separate documents. Very long documents run over several sequences. An empty table gives an empty
result. Only running sums and counts meet; no task holds a source.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from assayframe.llm import tokens
from assayframe.llm.common import BUCKET_BITS, running_start
from assayframe.session import store

SEQUENCE_TOKENS = 4096
WINDOW_SEQUENCES = 64
END_ID = 2


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``row, doc_id, source, n_tokens, ids``, written once; ids are little-endian bytes."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in batches:
            for row, ids, counts in encoder.encoded(batch.column("text"), end_id):
                piece = batch.slice(row, len(counts))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("row"), piece.column("doc_id"), piece.column("source"),
                     pa.array(counts, pa.int64()), tokens.binary_rows(ids, counts)],
                    names=["row", "doc_id", "source", "n_tokens", "ids"])

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").cast("string").alias("source"),
                        F.col("text").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return store(keyed.mapInArrow(encode, f"row long, doc_id {kind}, source string, n_tokens long, ids binary"))


def layout(rows: DataFrame, sequence: int = SEQUENCE_TOKENS, window: int = WINDOW_SEQUENCES) -> DataFrame:
    """Add ``at``, the document's place in the stream of all tokens, to ``row, source, n_tokens``."""
    queued = running_start(rows, ["source"], F.xxhash64("row"), "row", "n_tokens", "before")
    totals = rows.groupBy(F.col("source").alias("_source")).agg(F.sum("n_tokens").alias("_own"))
    everything = totals.withColumn("_all", F.sum("_own").over(Window.orderBy("_source").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)))
    earned = queued.join(everything, F.col("source").eqNullSafe(F.col("_source")))
    quantum = F.lit(float(sequence * window)) * F.col("_own") / F.col("_all")
    rounds = store(earned.select("row", "source", "n_tokens", "before", F.ceil(
        (F.col("before") + F.col("n_tokens")) / quantum).cast("long").alias("round")))
    sums = rounds.groupBy("round").agg(F.sum("n_tokens").alias("tokens"))
    step = F.shiftright("round", BUCKET_BITS)
    earlier = (Window.unboundedPreceding, -1)
    coarse = sums.groupBy(step.alias("step")).agg(F.sum("tokens").alias("_step_tokens")).select(
        "step", F.coalesce(F.sum("_step_tokens").over(Window.orderBy("step").rowsBetween(*earlier)), F.lit(0)).alias("_step_at"))
    starts = sums.withColumn("step", step).join(coarse, "step").select(
        "round", (F.col("_step_at") + F.coalesce(F.sum("tokens").over(
            Window.partitionBy("step").orderBy("round").rowsBetween(*earlier)), F.lit(0))).cast("long").alias("round_at"))
    inside = Window.partitionBy("round").orderBy(F.col("source").asc_nulls_last(), "before", "row").rowsBetween(*earlier)
    placed = rounds.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(starts, "round").select("row", "round", (F.col("round_at") + F.col("_inside")).cast("long").alias("at"))


def pack(rows: DataFrame, sequence: int = SEQUENCE_TOKENS, window: int = WINDOW_SEQUENCES, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``;
    with ``with_ids`` also the piece's ids as little-endian 32-bit bytes."""
    kind, wide = dict(rows.dtypes)["doc_id"], np.dtype(tokens.encoder(tokens.vocabulary_path()).dtype)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = (batch.column(c).to_numpy() for c in ("n_tokens", "at"))
            pieces = (at + n - 1) // sequence - at // sequence + 1
            row = np.repeat(np.arange(len(n)), pieces)
            number = at[row] // sequence + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(at[row], number * sequence)
            start, length = begin - at[row], np.minimum(at[row] + n[row], (number + 1) * sequence) - begin
            ids = batch.column("ids").cast(pa.large_binary())
            offsets = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset:ids.offset + len(ids)] // wide.itemsize
            held = np.frombuffer(ids.buffers()[2], wide, count=ids.buffers()[2].size // wide.itemsize) if len(ids) else np.empty(0, wide)
            first = offsets[row] + start
            parts = (held[a:a + size].astype("<u4").tobytes() for a, size in zip(first.tolist(), length.tolist()))
            kept = list(parts) if with_ids else parts
            numbers = [start, length, [zlib.crc32(p) for p in kept], n[row], number, begin - number * sequence]
            arrays = [batch.column("doc_id").take(pa.array(row)), *[pa.array(c, pa.int64()) for c in numbers]]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.binary())] if with_ids else arrays, names=names)

    placed = rows.select("row", "doc_id", "n_tokens", "ids").join(
        layout(rows.drop("ids", "doc_id"), sequence, window).hint("merge"), "row")
    schema = f"doc_id {kind}, " + ", ".join(f"`{n}` long" for n in names[1:7]) + ", ids binary" * with_ids
    return placed.select(F.col("doc_id"), "n_tokens", "at", "ids").mapInArrow(cut, schema)


def packed_documents(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Tokenize and pack all documents; see :func:`pack`."""
    return pack(tokenized(docs, path or tokens.vocabulary_path(), end_id))
