"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables that :func:`store` has written inside the innermost :func:`scratch`.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def get_session(app: str = "assayframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; a cluster keeps its own master and partition counts."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only a session that names none gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="assayframe-checkpoint-", dir=os.environ.get("TMPDIR"))
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written copy, which outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Like :func:`materialize`, as a compressed Parquet table: for wide rows, and where later steps prune columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if (written := _written.get()) is not None:
        written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Inside, tables written by :func:`store` last until the end: write or collect what is made of them before it.

    >>> with scratch(spark):
    ...     jaccard.near_duplicates(docs).write.parquet(path)
    """
    mark = _written.set([])
    try:
        yield
    finally:
        paths, _ = _written.get(), _written.reset(mark)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *columns) -> DataFrame:
    """Hash-partition a small-in-bytes, heavy-to-process table over all cores.

    Adaptive execution merges small shuffle partitions by size; an explicit count, the session's own shuffle
    setting, keeps the tasks that expand such rows in parallel.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def widen(scan: DataFrame) -> DataFrame:
    """A file scan over at least as many tasks as there are cores.

    A table of few row groups is read by few tasks, and all work up to the first shuffle stays there;
    such a table is dealt out over the cores once. A scan that already has the tasks is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
