"""Suffix-array dedup: remove every byte covered by a long string that also starts anywhere else.

A string of ``length`` bytes can repeat only if its anchor does: of all k-grams inside it, the one with the least hash.
Anchors depend on the string's bytes alone, so all places of a repeated string have the same anchor at the same
offset. This gives exact pruning and the partitioning:

1. Every document lists its runs of starts with one anchor. Anchors that occur at one place only are dropped.
2. Each remaining run becomes a snippet, the bytes of its starts and ``length - 1`` more; equal snippets are
   merged and counted, so copies move once. Snippets of an anchor meet in one group.
3. The snippets of a task are one text whose suffixes are sorted in two stages: those smaller than their successors
   directly, the rest induced by scanning the buckets of first bytes in order. Neighbours in the suffix array
   with a common prefix of ``length`` bytes are repeats.
4. Repeated starts go back to their documents and become removed byte ranges.

An anchor with more than ``GROUP_BYTES`` of different snippets is cut: its snippets are split into halves by start and
grouped by the bytes that all starts of a half share, again and again, so no group outgrows a task however common its anchor is.

Equal texts are one content: if there are two, each of their strings repeats, and one of them stands for both elsewhere.

Edge cases: a null text is empty. Texts shorter than ``length`` have nothing removed and take no part. Repeated rows are
copies. Very long texts are read in overlapping pieces. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayframe.llm.common import text_of
from assayframe.session import store

LENGTH = 200
ANCHOR_BYTES = 64
#: Bytes read at a time, sorted at a time, and of one anchor's snippets before they are cut.
PIECE_BYTES = 2 << 20
SORT_BYTES = 1 << 20
GROUP_BYTES = 1 << 19


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray, k: int = ANCHOR_BYTES) -> np.ndarray:
    """A hash of the ``k`` bytes (8 times a power of two) from each place on, doubled up from words of 8 bytes."""
    words = np.ndarray(len(data) - 7, "<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    h = mixed(words.copy())
    width = 8
    while width < k:
        h = mixed((h[:-width] * np.uint64(0xD6E8FEB86659FD93)) ^ (h[width:] + np.uint64(width)))
        width *= 2
    return h


def anchors(data: np.ndarray, length: int, k: int = ANCHOR_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a string of ``length`` bytes the place of its anchor, and all k-gram hashes."""
    h = gram_hashes(data, k)
    window, n = length - k + 1, len(data) - length + 1
    keys = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(keys) // window)
    block = np.full(rows * window, ~np.uint64(0))
    block[:len(keys)] = keys
    block = block.reshape(rows, window)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[window - 1:window - 1 + n])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), h


def runs(docs: DataFrame, length: int) -> DataFrame:
    """One row per document: ``row, doc_id, content, n_bytes`` and, in parallel arrays, its runs: ``n`` starts
    from ``start`` on have the anchor ``anchor``, at ``place``."""
    kind = dict(docs.dtypes)["doc_id"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield listed(batch.slice(at, 256))

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, found = [0], []
        for data in batch.column("data"):
            whole, n = np.frombuffer(data.as_buffer(), np.uint8), 0
            for at in range(0, len(whole) - length + 1, PIECE_BYTES):
                place, h = anchors(whole[at:at + PIECE_BYTES + length - 1], length)
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                found.append((h[place[first]].view(np.int64), place[first] + at, first + at, np.diff(np.append(first, len(place)))))
                n += len(first)
            counts.append(counts[-1] + n)
        offsets = pa.array(counts, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[i] for f in found]) if found else [], pa.int64()))
                 for i in range(4)]
        return pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "doc_id", "content", "n_bytes")] + lists, names=names)

    names = ["row", "doc_id", "content", "n_bytes", "anchor", "place", "start", "n"]
    data = text_of().cast("string").cast("binary")
    named = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.unhex(F.sha2(data, 256)).alias("content"),
        F.octet_length(data).cast("long").alias("n_bytes"), data.alias("data"))
    return named.mapInArrow(find, f"row long, doc_id {kind}, content binary, n_bytes long, " + ", ".join(f"{n} array<long>" for n in names[4:]))


def suffix_order(text: np.ndarray, depth: int, last: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of ``text`` in order, compared over ``depth`` bytes at least, by two-stage sorting.

    The least value, 0, ends the text and separates its snippets. With ``last``, the last wanted start of each snippet, the
    others are left out.
    """
    n = len(text)
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    following = change[np.searchsorted(change, np.arange(n))]
    smaller = text == 0  # suffixes smaller than their successors
    inside = following < n - 1
    smaller[inside] |= text[following[inside]] < text[following[inside] + 1]
    direct, wanted = np.flatnonzero(smaller), np.ones(n, bool)
    if last is not None:  # up to the suffix from which the last one is induced
        separators = np.flatnonzero(text == 0)
        edge = np.zeros(n + 1, np.int64)
        edge[np.append(0, separators[:-1] + 1)] += 1
        np.add.at(edge, direct[np.searchsorted(direct, last)] + 1, -1)
        wanted = np.cumsum(edge[:-1]) > 0
        direct = direct[wanted[direct]]
    raw = text.tobytes().decode("latin-1")
    slices = [raw[i:i + depth] for i in direct.tolist()]
    direct = direct[np.array(sorted(range(len(slices)), key=slices.__getitem__), np.int64)]
    del slices

    symbol = text[direct]
    own = np.searchsorted(symbol, np.arange(257))  # direct suffixes of each bucket
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def scan(part: np.ndarray) -> None:
        """Put the larger predecessors of ordered suffixes into their buckets, in that order."""
        before = part[part > 0] - 1
        before = before[~smaller[before] & wanted[before]]
        if len(before):
            bucket = text[before]
            by_bucket = np.argsort(bucket, kind="stable")
            found, at = np.unique(bucket[by_bucket], return_index=True)
            for c, piece in zip(found.tolist(), np.split(before[by_bucket], at[1:])):
                induced[c].append(piece)

    for c in range(256):
        done = 0
        while done < len(induced[c]):  # a run of equal bytes puts into its own bucket
            part = induced[c][done]
            done += 1
            out.append(part)
            scan(part)
        part = direct[own[c]:own[c + 1]]
        out.append(part)
        scan(part)
    return np.concatenate(out)


def repeated_starts(snippets: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """Of each distinct snippet the starts whose string of ``length`` bytes is in the text more than once."""
    sizes = np.array([len(s) for s in snippets])
    ends = np.cumsum(sizes + 1)
    text = np.frombuffer(b"\0".join(snippets) + b"\0", np.uint8) + np.uint8(1)  # no UTF-8 byte is above 0xF4
    text[ends - 1] = 0
    order = suffix_order(text, length, ends - 1 - length)
    owner = np.repeat(np.arange(len(snippets)), sizes + 1)
    room = ends[owner] - 1 - np.arange(len(text))
    order = order[room[order] >= length]
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    same = np.zeros(len(order) + 1, bool)
    for at in range(1, len(order), 20_000):  # adjacent common prefixes
        stop = min(at + 20_000, len(order))
        same[at:stop] = common_prefix(view, order[at - 1:stop - 1], order[at:stop], length)
    twice = np.zeros(len(text), bool)
    twice[order] = same[:-1] | same[1:]
    twice |= np.asarray(counts)[owner] > 1
    starts = ends - 1 - sizes
    return [np.flatnonzero(twice[a:a + s - length + 1]) for a, s in zip(starts, sizes)]


def common_prefix(view: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether suffixes ``a`` and ``b`` share a prefix of ``length``; most differ within the first bytes."""
    same = np.zeros(len(a), bool)
    left = np.flatnonzero((view[a, 0] == view[b, 0]) & (view[a, length - 1] == view[b, length - 1]))
    left = left[(view[a[left], :16] == view[b[left], :16]).all(axis=1)]
    same[left] = (view[a[left]] == view[b[left]]).all(axis=1)
    return same


def mark(groups: DataFrame, length: int) -> DataFrame:
    """From ``key, snippet, count`` the repeated starts of each snippet: ``snippet_id, starts`` (first, last, first, last ...)."""
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "snippet", "count")]):
                if size >= SORT_BYTES and row[0] != last:
                    yield solved(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[1]), row[0]
        if held:
            yield solved(held)

    def solved(held: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([h[1] for h in held], [h[2] for h in held], length)
        ids, starts = [], []
        for (_, snippet, _), at in zip(held, found):
            if len(at):
                cut = np.flatnonzero(np.diff(at) > 1)
                firsts, lasts = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
                ids.append(hashlib.md5(snippet).digest())
                starts.append(np.stack([firsts, lasts], 1).ravel().tolist())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(starts, pa.list_(pa.int64()))], names=["snippet_id", "starts"])

    return groups.repartition("key").sortWithinPartitions("key").select("key", "snippet", "count").mapInArrow(
        sort, "snippet_id binary, starts array<long>")


def halved(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """Cut pieces where cells of ``width`` starts end, counted from the anchor. The key of a cell's piece is the bytes
    that all strings starting in the cell share."""
    n = F.octet_length("snippet") - (length - 1)
    cell = lambda c: F.floor((c + length) / width).cast("int")
    cells = pieces.select("*", n.alias("_n"), F.explode(F.sequence(cell(F.col("offset")), cell(F.col("offset") + n - 1))).alias("_cell"))
    low = F.col("_cell") * width - length
    first = F.greatest("offset", low)
    last = F.least(F.col("offset") + F.col("_n") - 1, low + width - 1)
    byte = lambda at, size: F.substring(F.col("snippet"), (at - F.col("offset") + 1).cast("int"), size.cast("int"))
    return cells.select(
        "content", (F.col("start") + first - F.col("offset")).alias("start"), first.alias("offset"),
        F.xxhash64("key", "_cell", byte(low + width - 1, F.lit(length - width + 1))).alias("key"),
        byte(first, last - first + length).alias("snippet"))


def marked_pieces(pieces: DataFrame, length: int) -> DataFrame:
    """``content, start, starts``: repeated starts of all pieces, relative to the piece's ``start``."""
    width, out = length - ANCHOR_BYTES + 1, []
    while True:
        groups = store(pieces.groupBy("key", "snippet").agg(F.count(F.lit(1)).alias("count")))
        large = groups.groupBy("key").agg(F.sum(F.octet_length("snippet")).alias("size"), F.count(F.lit(1)).alias("n")).where(
            (F.col("size") > GROUP_BYTES) & (F.col("n") > 1)).select("key")
        if width == 1 or large.isEmpty():
            out.append((pieces, groups))
            break
        large = store(large)
        out.append((pieces.join(large, "key", "left_anti"), groups.join(large, "key", "left_anti")))
        width = (width + 1) // 2
        pieces = store(halved(pieces.join(large, "key", "left_semi"), width, length))
    found = None
    for pieces, groups in out:
        one = pieces.select("content", "start", F.unhex(F.md5("snippet")).alias("snippet_id")).join(
            store(mark(groups, length)), "snippet_id").select("content", "start", "starts")
        found = one if found is None else found.unionByName(one)
    return found


def repeats(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``members`` (doc_id, content, n_bytes), candidates (``content, data``), and ``content, start, starts``."""
    listed = store(runs(docs, length))
    members = listed.select("row", "doc_id", "content", "n_bytes")
    every = listed.select("row", "content", F.explode(F.arrays_zip("anchor", "place", "start", "n")).alias("run")).select(
        "row", "content", "run.*")
    spot = F.xxhash64("content", "place")
    shared = every.groupBy("anchor").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a < b").select("anchor")
    # stored, so that both sides of the join are plain exchanges and a hot anchor's rows can be split
    wanted = every.select("row", "anchor", "place", "start", "n").join(store(shared), "anchor", "left_semi")
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("start", "n", "anchor", "place")).alias("runs"))
    first = members.groupBy("content").agg(F.min(F.struct("doc_id", "row")).alias("first")).select(
        "content", "first.row", F.xxhash64("first.doc_id").alias("id"))
    data = text_of().cast("string").cast("binary")
    candidates = docs.select(F.unhex(F.sha2(data, 256)).alias("content"), F.xxhash64("doc_id").alias("id"), data.alias("data")).join(
        by_row.join(first, "row").select("content", "id", "runs"), ["content", "id"]).dropDuplicates(["content", "id"])
    candidates = store(candidates.select("content", "data", "runs"))
    pieces = candidates.select("content", "data", F.explode("runs").alias("run")).select(
        "content", F.col("run.start").alias("start"), (F.col("run.start") - F.col("run.place")).alias("offset"),
        F.col("run.anchor").alias("key"),
        F.substring(F.col("data"), F.col("run.start").cast("int") + 1, F.col("run.n").cast("int") + length - 1).alias("snippet"))
    return members, candidates.select("content", "data"), marked_pieces(pieces, length)


def removed(candidates: DataFrame, placed: DataFrame, length: int) -> DataFrame:
    """``content, n_removed, n_spans, kept_sha256`` of the contents that lose bytes."""
    ranges = placed.groupBy("content").agg(F.collect_list(F.struct("start", "starts")).alias("found"))

    def cover(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for content, data, found in zip(part["content"], part["data"], part["found"]):
                change = np.zeros(len(data) + 1, np.int64)
                for run in found:
                    at = np.asarray(run["starts"], np.int64) + run["start"]
                    np.add.at(change, at[::2], 1)
                    np.add.at(change, at[1::2] + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((content, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["content", "n_removed", "n_spans", "kept_sha256"])

    return candidates.join(ranges, "content").mapInPandas(cover, "content binary, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    members, candidates, placed = repeats(docs, length)
    found = store(removed(candidates, placed, length))
    copies = members.groupBy("content").agg(F.count(F.lit(1)).alias("copies"))
    nothing = F.sha2(F.lit(""), 256)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    joined = members.join(copies, "content").join(found, "content", "left")
    return joined.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("content")))).alias("kept_sha256"))
