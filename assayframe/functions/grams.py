"""Counts of hashed q-grams of a batch of texts, with numpy inside a task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters counted at once.
CHARACTERS = 1 << 20
#: Names of q-grams are found in a table up to this size, by sorting beyond it.
TABLE = 1 << 24
#: Buckets of grams that a task remembers.
REMEMBERED = 1 << 20


def named(values: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Equal numbers below ``size`` get the same small name, and how many names there are."""
    if size > TABLE:
        found, names = np.unique(values, return_inverse=True)
        return names.astype(np.int64), len(found)
    seen = np.zeros(size, bool)
    seen[values] = True
    found = np.flatnonzero(seen)
    names = np.empty(size, np.int64)
    names[found] = np.arange(len(found))
    return names[values], len(found)


def buckets_of(text: str, q: int, buckets: int, known: dict[str, int]) -> np.ndarray:
    """The bucket of the q-gram at each place of ``text``: the first 32 bits of its md5, modulo the bucket count. Each gram is hashed once."""
    letters, n = named(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64), 0x110000)
    names, count = letters, n
    for i in range(1, q):
        names, count = named(names[:-1] * n + letters[i:], count * n)
    place = np.empty(count, np.int64)
    place[names] = np.arange(len(names))
    if len(known) > REMEMBERED:
        known.clear()
    table = np.empty(count, np.int64)
    for i, at in enumerate(place.tolist()):
        gram = text[at:at + q]
        bucket = known.get(gram)
        if bucket is None:
            bucket = known[gram] = int.from_bytes(hashlib.md5(gram.encode()).digest()[:4], "big") % buckets
        table[i] = bucket
    return table[names]


def bucket_counts(batches: Iterator[pa.RecordBatch], q: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Batches of (key, text) to batches of (key, counts): one row for each key that has a gram, with ``n * buckets + bucket`` for each
    bucket that it has. Texts are taken together up to ``CHARACTERS``."""
    known: dict[str, int] = {}
    for batch in batches:
        keys = batch.column(0).dictionary_encode(null_encoding="encode")
        slots, texts = keys.indices.to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        ends = np.cumsum([len(t) for t in texts])
        start = 0
        while start < len(texts):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + CHARACTERS, side="right")))
            text, last = "".join(texts[start:stop]), ends[start:stop] - done
            if len(text) >= q:
                row = np.repeat(np.arange(stop - start), np.diff(last, prepend=0))[: len(text) - q + 1]
                inside = np.arange(len(row)) + q <= last[row]
                chosen, slot = np.unique(slots[start:stop], return_inverse=True)
                counts = np.bincount((slot[row] * buckets + buckets_of(text, q, buckets, known))[inside], minlength=len(chosen) * buckets)
                hit = np.flatnonzero(counts)
                per_key = np.bincount(hit // buckets, minlength=len(chosen))
                some = per_key > 0
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_key[some])), pa.int32()),
                                                 pa.array(counts[hit] * buckets + hit % buckets, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(chosen[some])), lists], names=["key", "counts"])
            start = stop
