"""Token ids of whole texts, with each worker's pieces of words kept between batches in flat arrays.

The tokenizer drops white space, lower-cases, and never merges across white space or between a letter, a digit and a mark. So
the ids of a text are the ids of its pieces, one after the other. A batch of texts is cut into pieces with numpy, the pieces
are looked up in a table that names them by their bytes, and only pieces not met before reach Python and the tokenizer.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
#: Bounds of what a worker keeps: memory only, never results.
KEEP_PIECES = 600_000
#: Bytes of text cut at a time.
SLICE_BYTES = 1 << 19
#: Pieces encoded in one call.
CALL_PIECES = 256
#: Widths of the tables in words of eight bytes; longer pieces are encoded each time.
LANES = (2, 6)
SPACE, OTHER, LETTER, DIGIT, MARK = range(5)
#: Latin letters of two bytes in UTF-8, but for one whose lower case is two characters, and two signs.
LATIN_LEADS = (0xC3, 0xC8)
NOT_LATIN = [(0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)]
_encoders: dict[str, PieceEncoder] = {}


def _classes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = SPACE
    kinds[33:127] = MARK
    kinds[48:58] = DIGIT
    kinds[65:91] = kinds[97:123] = LETTER
    kinds[39] = OTHER  # an apostrophe starts a contraction with the letters after it
    return kinds


CLASSES = _classes()
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def cut(data: np.ndarray, starts_of_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and length of every piece, and whether it is Latin letters only. White space, starts of documents, and
    changes between letters, digits and marks separate pieces; each digit is one. Other characters stay with their neighbours."""
    kinds = CLASSES[data]
    lead = np.flatnonzero((data[:-1] >= LATIN_LEADS[0]) & (data[:-1] <= LATIN_LEADS[1]))
    for a, b in NOT_LATIN:
        lead = lead[(data[lead] != a) | (data[lead + 1] != b)]
    kinds[lead] = kinds[lead + 1] = LETTER
    before, here = kinds[:-1], kinds[1:]
    first = np.empty(len(data), bool)
    first[0] = kinds[0] != SPACE
    first[1:] = (here != SPACE) & ((before == SPACE) | (before != here) & (before > OTHER) & (here > OTHER) | (before == DIGIT) & (here == DIGIT))
    first[starts_of_docs] = kinds[starts_of_docs] != SPACE
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts, np.empty(0, bool)
    lengths = np.add.reduceat((kinds != SPACE).view(np.uint8), starts, dtype=np.int32)
    letters = np.add.reduceat((kinds == LETTER).view(np.uint8), starts, dtype=np.int32) == lengths
    return starts, lengths, letters


class PieceTable:
    """Numbers of byte strings of up to ``8 * lanes`` bytes, and the ids of each: an open hash table in flat arrays."""

    def __init__(self, lanes: int, dtype: np.dtype):
        self.lanes, self.dtype = lanes, dtype
        self.clear()

    def clear(self) -> None:
        self.n, self.n_ids = 0, 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.keys = np.empty((1 << 14, self.lanes), np.uint64)
        self.at, self.count = np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32)
        self.ids = np.empty(1 << 16, self.dtype)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        h = np.zeros(len(keys), np.uint64)
        for lane in range(self.lanes):
            h = (h ^ keys[:, lane]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def _room(self, more: int) -> None:
        if self.n + more > len(self.keys):
            wide = self.n + self.n // 2 + more
            keys, self.keys = self.keys, np.empty((wide, self.lanes), np.uint64)
            self.keys[:self.n] = keys[:self.n]
            self.at, self.count = np.resize(self.at, wide), np.resize(self.count, wide)
        if 2 * (self.n + more) > len(self.slots):
            size = len(self.slots)
            while 2 * (self.n + more) > size:
                size *= 2
            self.slots = np.full(size, -1, np.int32)
            self._place(self.keys[:self.n], np.arange(self.n))

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Give distinct keys slots of an empty table."""
        mask = np.uint64(len(self.slots) - 1)
        slot, left = self._hash(keys) & mask, np.arange(len(keys))
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            self.slots[slot[free]] = numbers[free]
            left = left[self.slots[slot[left]] != numbers[left]]
            slot[left] = (slot[left] + np.uint64(1)) & mask

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each key, and the places in ``keys`` of those that are new, in the order of their numbers."""
        self._room(len(keys))
        mask = np.uint64(len(self.slots) - 1)
        slot, left = self._hash(keys) & mask, np.arange(len(keys))
        numbers, fresh = np.empty(len(keys), np.int64), []
        while len(left):
            here = slot[left]
            free = left[self.slots[here] < 0]
            if len(free):
                self.slots[slot[free]] = -2 - free  # one of the keys that want a slot gets it
                won = free[self.slots[slot[free]] == -2 - free]
                given = np.arange(self.n, self.n + len(won))
                self.keys[given] = keys[won]
                self.slots[slot[won]] = given
                self.n += len(won)
                fresh.append(won)
            held = self.slots[here]
            same = (self.keys[held] == keys[left]).all(axis=1)
            numbers[left[same]] = held[same]
            left = left[~same]
            slot[left] = (slot[left] + np.uint64(1)) & mask
        return numbers, np.concatenate(fresh) if fresh else np.empty(0, np.int64)

    def learn(self, found: list[list[int]]) -> None:
        """The ids of the newest keys."""
        counts = np.array([len(x) for x in found], np.int64)
        flat = np.array([i for x in found for i in x], self.dtype)
        if self.n_ids + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.n_ids + len(flat)))
        new = slice(self.n - len(found), self.n)
        self.at[new] = self.n_ids + np.cumsum(counts) - counts
        self.count[new] = counts
        self.ids[self.n_ids:self.n_ids + len(flat)] = flat
        self.n_ids += len(flat)


class PieceEncoder:
    """Encodes UTF-8 text to ids of ``dtype``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: others follow from 256 on
        others = [b for b in range(256) if b not in printable]
        self.byte_names = {b: 256 + i for i, b in enumerate(others)}
        #: Texts with these go to the tokenizer whole: it looks for special tokens before it lower-cases.
        self.odd = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()] + [b"\0"]
        self.tables = [PieceTable(lanes, self.dtype) for lanes in LANES]

    def _learned(self, pieces: list[bytes], letters: list[bool]) -> list[list[int]]:
        """The ids of pieces, lower-cased in ASCII. Latin letters only are one word for the tokenizer's model, composed as they
        are; the model reads a word as one character for each byte."""
        out, rest, tokenize = [], [], self.model.tokenize
        for piece, plain in zip(pieces, letters):
            if plain:
                word = piece.decode() if piece.isascii() else piece.decode().lower().encode().decode("latin-1").translate(self.byte_names)
                out.append([t.id for t in tokenize(word)])
            else:
                rest.append((len(out), piece.decode()))
                out.append([])
        for i in range(0, len(rest), CALL_PIECES):
            some = rest[i:i + CALL_PIECES]
            for (place, _), found in zip(some, self.tokenizer.encode_batch_fast([x for _, x in some], add_special_tokens=False)):
                out[place] = found.ids
        return out

    def _slice(self, text: bytes, starts_of_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts end to end, and how many belong to each."""
        n_docs, low = len(starts_of_docs), text.lower()
        if any(x in low for x in self.odd):
            ends = np.append(starts_of_docs[1:], len(text))
            docs = [text[a:b] for a, b in zip(starts_of_docs, ends)]
            made = [np.array(self.tokenizer.encode(doc.decode(), add_special_tokens=False).ids, self.dtype)
                    if any(x in doc.lower() for x in self.odd) else self._slice(doc, np.zeros(1, np.int64))[0] for doc in docs]
            return np.concatenate(made), np.array([len(x) for x in made], np.int64)
        data = np.frombuffer(low, np.uint8)
        if not len(data):
            return np.empty(0, self.dtype), np.zeros(n_docs, np.int64)
        starts, lengths, letters = cut(data, starts_of_docs[starts_of_docs < len(data)])
        wide = np.ndarray((len(low) + 1,), "<u8", low + bytes(8 * max(LANES) + 8), strides=(1,))
        sources, counts = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        flats, base, least = [], 0, 0
        for table in self.tables:
            mine = np.flatnonzero((lengths > least) & (lengths <= 8 * table.lanes))
            least = 8 * table.lanes
            at, size = starts[mine], lengths[mine]
            keys = np.empty((len(mine), table.lanes), np.uint64)
            for lane in range(table.lanes):
                keys[:, lane] = wide[np.minimum(at + 8 * lane, len(low))] & LOW_BYTES[np.clip(size - 8 * lane, 0, 8)]
            if table.n > KEEP_PIECES:
                table.clear()
            numbers, fresh = table.find(keys)
            if len(fresh):
                table.learn(self._learned([low[a:a + n] for a, n in zip(at[fresh].tolist(), size[fresh].tolist())], letters[mine[fresh]].tolist()))
            sources[mine], counts[mine] = table.at[numbers].astype(np.int64) + base, table.count[numbers]
            flats.append(table.ids[:table.n_ids])
            base += table.n_ids
        long = np.flatnonzero(lengths > least)
        if len(long):
            found = self._learned([low[a:a + n] for a, n in zip(starts[long].tolist(), lengths[long].tolist())], letters[long].tolist())
            counts[long] = [len(x) for x in found]
            sources[long] = base + np.cumsum(counts[long]) - counts[long]
            flats.append(np.array([i for x in found for i in x], self.dtype))
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(sources - (ends - counts), counts) + np.arange(total)
        ids = np.empty(total, self.dtype)
        base = 0
        for flat in flats:
            inside = (place >= base) & (place < base + len(flat))
            ids[inside] = flat[place[inside] - base]
            base += len(flat)
        until = np.append(np.searchsorted(starts, starts_of_docs), len(starts))
        upto = np.append(0, ends)[until]
        return ids, np.diff(upto)

    def encoded(self, column: pa.Array, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first row, ids, ids per text)`` of consecutive texts of a string column, the id ``last`` after each; null is empty."""
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        held = memoryview(column.buffers()[2] or b"")
        row = 0
        while row < len(column):
            stop = min(max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1), len(column))
            own = offsets[row:stop + 1]
            if own[-1] - own[0] > SLICE_BYTES:
                parts = [self._slice(part, np.zeros(1, np.int64))[0] for part in _parts(held[own[0]:own[-1]])]
                ids, counts = np.concatenate(parts), np.array([sum(map(len, parts))], np.int64)
            else:
                ids, counts = self._slice(bytes(held[own[0]:own[-1]]), own[:-1] - own[0])
            ends = np.cumsum(counts + 1) - 1
            out = np.empty(len(ids) + len(counts), self.dtype)
            real = np.ones(len(out), bool)
            real[ends] = False
            out[ends], out[real] = last, ids
            yield row, out, counts + 1
            row = stop

    def encode_all(self, texts: list[bytes | None], last: int) -> list[bytes]:
        """Ids of each text and then the id ``last``, as little-endian bytes."""
        out = []
        for _, ids, counts in self.encoded(pa.array(texts, pa.binary()), last):
            out += [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]
        return out

    def encode(self, text: bytes, last: int) -> bytes:
        return self.encode_all([text], last)[0]


def _parts(text: memoryview) -> Iterator[bytes]:
    """A long text in parts that end at white space where there is any."""
    at = 0
    while at < len(text):
        stop = min(at + SLICE_BYTES, len(text))
        while stop < len(text):
            spaces = np.flatnonzero(CLASSES[np.frombuffer(text[at:stop], np.uint8)] == SPACE)
            if len(spaces):
                stop = at + int(spaces[-1]) + 1
                break
            stop = min(stop + SLICE_BYTES, len(text))
        yield bytes(text[at:stop])
        at = stop


def binary_rows(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Ids per text as a column of little-endian bytes, without a Python object for each."""
    offsets = np.append(0, np.cumsum(counts)) * ids.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)
