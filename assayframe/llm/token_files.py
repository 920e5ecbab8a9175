"""Token ids in Arrow files of fixed-size lists, for random access without copies.

Documents are sorted by id over range partitions. Every partition is one file in the Arrow file format, whose batches
have columns ``ids`` and ``mask``, fixed-size lists of one length: the ids of its documents end to end, cut into equal
sequences, the last one padded (mask false). A second small file lists the documents (``doc_id, n_tokens``) in order.
A reader maps the file into memory and takes any sequence, or any document, without decoding the rest.

Edge cases: a null text is an empty document with the end id alone. Rows that repeat a ``doc_id`` are in the order of their
text's hash. Very long texts run over many sequences. An empty table gives no files and an empty result. A task
writes under a name of its own and moves the file when it is whole, so a task that runs again leaves the same file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from assayframe.llm import tokens
from assayframe.session import shared_folder, store

SEQUENCE_TOKENS = 2048
BATCH_SEQUENCES = 256
END_ID = 1


def place(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the path in it; Hadoop writes a local folder as ``file:/...``."""
    if folder.startswith(("file:", "/")):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder)


class SequenceFile:
    """Writes ids as batches of equal-length sequences and masks."""

    def __init__(self, sink, dtype: np.dtype, length: int):
        self.length, self.rows, self.held, self.size = length, BATCH_SEQUENCES, [], 0
        kind = pa.from_numpy_dtype(dtype)
        self.dtype, self.schema = dtype, pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        full = self.rows * self.length
        if self.size >= full:
            ids, n = np.concatenate(self.held), self.size // full * full
            for at in range(0, n, full):
                self._batch(ids[at:at + full], full)
            self.held, self.size = [ids[n:]], self.size - n

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        """The rest is one smaller batch, whose last sequence is padded."""
        if self.size:
            last = np.zeros(-(-self.size // self.length) * self.length, self.dtype)
            last[:self.size] = np.concatenate(self.held)
            self._batch(last, self.size)
        self.writer.close()


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, length: int = SEQUENCE_TOKENS) -> DataFrame:
    """Write all documents below ``folder``; returns the written files: ``part, file, n_docs, n_tokens``."""
    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokens.encoder(path), TaskContext.get().partitionId()
        fs, base = place(folder)
        name, own, out = f"{base}/part-{part:06d}", f"{base}/.part-{part:06d}-{uuid.uuid4().hex}", None
        ids_of, counts, total = [], [], 0
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(f"{own}.ids")
                out = SequenceFile(sink, encoder.dtype, length)
            ids_of.append(batch.column("doc_id"))
            for _, ids, sizes in encoder.encoded(batch.column("text"), end_id):
                out.add(ids)
                counts += sizes.tolist()
                total += len(ids)
        if out is None:
            return
        out.close()
        sink.close()
        listed = pa.table({"doc_id": pa.chunked_array(ids_of), "n_tokens": pa.array(counts, pa.int64())})
        with fs.open_output_stream(f"{own}.docs") as to, pa.ipc.new_file(to, listed.schema) as writer:
            writer.write_table(listed, max_chunksize=1 << 16)
        for end in (".ids", ".docs"):
            if fs.get_file_info(name + end).type != pafs.FileType.NotFound:  # an earlier attempt's, the same
                fs.delete_file(name + end)
            fs.move(own + end, name + end)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int64()), "file": [name], "n_docs": pa.array([len(counts)], pa.int64()),
            "n_tokens": pa.array([total], pa.int64())})

    ordered = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_tie")).repartitionByRange(
        "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    return store(ordered.mapInArrow(save, "part long, file string, n_docs long, n_tokens long"))


def opened(name: str, folder: str) -> pa.ipc.RecordBatchFileReader:
    """A file of either kind; a local one is mapped, so its columns point into the file."""
    fs, _ = place(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(name))
    return pa.ipc.open_file(fs.open_input_file(name))


def stream(reader: pa.ipc.RecordBatchFileReader, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a file; a view where they lie in one batch. All batches but the last are of one size."""
    size = len(reader.get_batch(0).column(0).flatten()) if reader.num_record_batches else 1
    pieces = []
    while start < stop:
        batch = start // size
        flat = reader.get_batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)
        pieces.append(flat[start - batch * size:stop - batch * size])
        start = (batch + 1) * size
    return pieces[0] if len(pieces) == 1 else np.concatenate(pieces or [np.empty(0, "<u2")])


def read(files: DataFrame, folder: str, doc_id_type: str = "bigint") -> DataFrame:
    """Read the files back: ``doc_id, start, n_tokens, ids_crc32`` per document, from the stored ids."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, base in zip(part["file"], part["base"]):
                ids, listed, at = opened(f"{name}.ids", folder), opened(f"{name}.docs", folder), 0
                for i in range(listed.num_record_batches):
                    docs = listed.get_batch(i).to_pandas()
                    ends = at + docs["n_tokens"].to_numpy().cumsum()
                    starts = ends - docs["n_tokens"].to_numpy()
                    crc = [zlib.crc32(stream(ids, a, b).astype("<u4").tobytes()) for a, b in zip(starts, ends)]
                    yield pd.DataFrame({"doc_id": docs["doc_id"], "start": base + starts, "n_tokens": ends - starts, "ids_crc32": crc})
                    at = ends[-1]

    spread = based.repartition(files.sparkSession.sparkContext.defaultParallelism, "part")
    return spread.select("file", "base").mapInPandas(load, f"doc_id {doc_id_type}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write all documents and read them back; see :func:`write` and :func:`read`."""
    folder = folder or os.path.join(shared_folder(docs.sparkSession), f"tokens-{uuid.uuid4().hex}")
    files = write(docs, folder, path or tokens.vocabulary_path(), end_id)
    return read(files, folder, dict(docs.dtypes)["doc_id"])
