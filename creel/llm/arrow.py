"""Whole texts as byte arrays: slices of Arrow batches, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_FACTOR = 0x9E3779B97F4A7C15
_HASH_WORDS = 1 << 18


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; one long text is a batch of its own."""
    for batch in batches:
        sizes = np.diff(buffers(batch.column(column))[1])
        first, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += int(size)
        if first < len(sizes):
            yield batch.slice(first)


def words(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word, a run without space, tab, or line and page breaks.

    cut: places where a word ends and the next begins, too.
    """
    solid = ~SPACE[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    if cut is not None:
        edge = np.concatenate([edge, cut])
    before = np.empty_like(solid)
    before[:1], before[1:] = False, solid[:-1]
    before[edge] = False
    after = np.empty_like(solid)
    after[-1:], after[:-1] = False, solid[1:]
    after[edge - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from a polynomial over its bytes."""
    out = np.empty(len(start), np.uint64)
    longest = int((end - start).max(initial=0))
    powers = np.full(longest, _FACTOR, np.uint64)
    powers[:1] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    for i in range(0, len(start), _HASH_WORDS):
        s, e = start[i : i + _HASH_WORDS], end[i : i + _HASH_WORDS]
        sizes = e - s
        first = np.cumsum(sizes) - sizes
        within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        terms = (data[within + np.repeat(s, sizes)].astype(np.uint64) + np.uint64(1)) * powers[within]
        out[i : i + _HASH_WORDS] = np.add.reduceat(terms, first) + sizes.astype(np.uint64)
    return mix(out)


def runs(numbers: np.ndarray, n: int) -> np.ndarray:
    """Where each of the numbers 0 to n - 1 begins in a sorted array, with the end added."""
    return np.searchsorted(numbers, np.arange(n + 1))


def ragged(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one range after another."""
    return np.arange(int(sizes.sum())) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)


class Slots:
    """Numbers 0, 1, 2, ... for distinct 64-bit keys, found by open addressing."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.table = np.full(1 << 16, -1, np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for a new one."""
        mask = np.uint64(len(self.table) - 1)
        slot = (keys & mask).astype(np.int64)
        found = self.table[slot]
        if not len(self.keys):
            return found
        left = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(left):
            slot[left] = (slot[left] + 1) & int(mask)
            found[left] = got = self.table[slot[left]]
            left = left[(got >= 0) & (self.keys[got] != keys[left])]
        return found

    def add(self, keys: np.ndarray) -> None:
        """Number new distinct keys in their order."""
        first = len(self.keys)
        self.keys = np.concatenate([self.keys, keys])
        if 2 * len(self.keys) > len(self.table):
            self.table = np.full(1 << int(4 * len(self.keys)).bit_length(), -1, np.int32)
            first = 0
        numbers = np.arange(first, len(self.keys), dtype=np.int32)
        slot = (self.keys[first:] & np.uint64(len(self.table) - 1)).astype(np.int64)
        while len(numbers):
            free = self.table[slot] < 0
            self.table[slot[free]] = numbers[free]
            left = self.table[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & (len(self.table) - 1)
