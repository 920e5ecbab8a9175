"""N-grams of words as 64-bit hashes, for a batch of texts at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time.
SLICE_BYTES = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers_up_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.append(np.uint64(1), np.full(2 * n, MULTIPLIER, np.uint64)))
    return _powers


def word_hashes(data: np.ndarray, starts_of_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word. A-Z count as a-z; ASCII white space and starts of documents separate words."""
    solid = (data > 32) | ((data < 9) | (data > 13)) & (data != 32)
    begins = np.zeros(len(data) + 1, bool)
    begins[starts_of_docs] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | begins[1:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    kept = data[solid]
    kept = kept + ((kept >= 65) & (kept <= 90)).astype(np.uint8) * np.uint8(32)
    at = np.flatnonzero(first[solid])
    sizes = np.diff(np.append(at, len(kept)))
    place = np.arange(len(kept)) - np.repeat(at, sizes)
    values = (kept.astype(np.uint64) + np.uint64(1)) * _powers_up_to(int(sizes.max()) + 1)[place]
    return mixed(np.add.reduceat(values, at) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def long_word_hashes(data: np.ndarray) -> np.ndarray:
    """The same for one text of any length, read in slices that end at white space where there is any."""
    out, at = [], 0
    while at < len(data):
        stop = min(at + SLICE_BYTES, len(data))
        while stop < len(data):
            spaces = np.flatnonzero(np.isin(data[at:stop], [9, 10, 11, 12, 13, 32]))
            if len(spaces):
                stop = at + int(spaces[-1]) + 1
                break
            stop = min(stop + SLICE_BYTES, len(data))
        out.append(word_hashes(data[at:stop], np.zeros(1, np.int64))[0])
        at = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class Grams:
    """N-grams of some texts: ``hashes`` end to end, ``sizes`` per text, ``words`` (hashes) and ``n_words`` alike."""

    def __init__(self, words: np.ndarray, n_words: np.ndarray, n: int):
        self.words, self.n_words = words, n_words
        full = np.maximum(n_words - n + 1, 0)
        ends = np.cumsum(n_words)
        self.sizes = np.where(n_words > 0, np.maximum(full, 1), 0)
        at = np.repeat(ends - n_words - (np.cumsum(self.sizes) - self.sizes), self.sizes) + np.arange(self.sizes.sum())
        last = np.repeat(ends - 1, self.sizes)
        self.members = [np.minimum(at + k, last) for k in range(n)]  # a short text repeats its last word, marked below
        h = words[self.members[0]]
        for k in range(1, n):
            inside = (at + k <= last).astype(np.uint64)
            h = mixed(h * np.uint64(MULTIPLIER) + (words[self.members[k]] + np.uint64(k)) * inside)
        self.hashes = h
        self.doc = np.repeat(np.arange(len(n_words)), self.sizes)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, word hashes, words per text) of consecutive texts of a string column; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        stop = min(stop, len(column))
        own = offsets[row:stop + 1]
        if stop == row + 1 and own[1] - own[0] > SLICE_BYTES:
            words = long_word_hashes(data[own[0]:own[1]])
            yield row, 1, words, np.array([len(words)])
        else:
            words, starts = word_hashes(data[own[0]:own[-1]], own[:-1] - own[0])
            counts = np.diff(np.searchsorted(starts, own - own[0], "left"))
            yield row, stop - row, words, counts
        row = stop


def identity(words: np.ndarray) -> int:
    """A 64-bit name of a sequence of words."""
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)
