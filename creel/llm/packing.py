"""Documents packed into token windows by multiway differencing.

Every document is tokenized and cut into full windows and a remainder, the latter
into parts of at most PART tokens, with which windows come out more equal. The
parts of a block are divided by the Karmarkar-Karp method: each starts as a
partial partition that holds it in one window and nothing in the others; the two
partitions with the largest imbalance are merged, the fullest window of one with
the emptiest of the other, until one is left. If a window is above the capacity,
the number of windows rises by one and the block is divided again.

Blocks are cut from the scan as it is read, so nothing is shuffled.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from creel.llm import arrow

CAPACITY = 4096
BLOCK_WINDOWS = 192
PART = 1024
MEMO_WORDS = 1 << 21
# fixed values: ASCII signs that always end a word of ASCII letters in the split pattern
SIGNS = b".,;:!?()|#$%&*\"-"

_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(SIGNS)] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True


def differencing(sizes: Sequence[int], windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Divide the sizes among windows by multiway differencing: window of each item, sum of each window."""
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(windows, np.int64)
    sums: dict[int, np.ndarray] = {}
    heap, merges = [], []
    for i, size in enumerate(sizes):
        heap.append((-int(size), i))
    heapq.heapify(heap)
    node = n

    def parts(k: int) -> np.ndarray:  # in falling order
        if k >= n:
            return sums.pop(k)
        out = np.zeros(windows, np.int64)
        out[0] = sizes[k]
        return out

    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = parts(a) + parts(b)[::-1]
        order = np.argsort(-both, kind="stable")
        sums[node] = both[order]
        merges.append((a, b, order))
        heapq.heappush(heap, (int(sums[node][-1] - sums[node][0]), node))
        node += 1
    last = heap[0][1]
    total = parts(last)
    places: dict[int, np.ndarray] = {last: np.arange(windows)}
    window = np.zeros(n, np.int64)
    for k in range(len(merges) - 1, -1, -1):
        a, b, order = merges[k]
        where = np.empty(windows, np.int64)
        where[order] = places.pop(n + k)
        for part, at in ((a, where), (b, where[::-1])):
            if part < n:
                window[part] = at[0]
            else:
                places[part] = at
    if last < n:
        window[last] = 0
    return window, total


def divide(sizes: Sequence[int], capacity: int) -> tuple[np.ndarray, int]:
    """Window of each item and the number of windows; the number rises while one is above the capacity."""
    windows = max(1, -(-int(sum(sizes)) // capacity))
    while True:
        window, total = differencing(sizes, windows)
        if total.max(initial=0) <= capacity:
            return window, windows
        windows += 1


class Encoder:
    """Token ids of many texts by the tokenizers library, each distinct word encoded once.

    White space ends a word of this kind of tokenizer, and so does a sign after an
    ASCII letter, so the ids of a text are those of its words in order. ASCII
    capitals are lowered first where the tokenizer does so anyway. Texts that may
    hold a special string are cut at white space only and left as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        probe = ["Ab, c", "ab,", "c"]
        whole, *cut = [e.ids for e in self.tokenizer.encode_batch(probe, add_special_tokens=False)]
        if whole != cut[0] + cut[1]:
            raise ValueError("this tokenizer does not drop white space and case")
        words = {i: w for w, i in self.tokenizer.get_vocab().items()}
        self.final = np.array([words.get(i, "").endswith("</w>") for i in range(max(words) + 1)])
        self.marks = {t.content[:2].encode() for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.reset()

    def reset(self) -> None:
        self.known = arrow.Slots()
        self.first = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        raw = data.tobytes()
        if any(m in raw for m in self.marks) or len(data) < 2:
            return data, *arrow.words(data, offsets)
        data = arrow.LOWER[data]
        letter, sign = _LETTER[data], _SIGN[data]
        return data, *arrow.words(data, offsets, np.flatnonzero((letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])) + 1)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words; first place and number of ids of each. Words of letters alone are one piece each and go in one call."""
        alone = np.fromiter(map(str.isalpha, words), bool, len(words))
        plain = np.flatnonzero(alone)
        flat = np.array(self.tokenizer.encode_batch_fast([" ".join(words[i] for i in plain)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.final[flat]) + 1
        if len(ends) != len(plain):
            alone[:], plain, flat, ends = False, plain[:0], flat[:0], ends[:0]
        rest = np.flatnonzero(~alone)
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)]
        sizes = np.zeros(len(words), np.int64)
        sizes[plain] = np.diff(ends, prepend=0)
        sizes[rest] = np.fromiter(map(len, ids), np.int64, len(ids))
        order = np.concatenate([plain, rest])
        first = np.empty(len(words), np.int64)
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate([flat, np.array(list(chain.from_iterable(ids)), np.int64)]).astype(np.uint32), first, sizes

    def number(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The known word that each word is; words not known yet are encoded."""
        if len(self.known) > MEMO_WORDS:
            self.reset()
        hashed = arrow.hashes(data, start, end)
        at = self.known.find(hashed)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            new, where = np.unique(hashed[unknown], return_index=True)
            where = unknown[where]
            raw = data.tobytes()
            for i in range(0, len(where), 1 << 15):
                ids, first, sizes = self.encode([raw[start[k] : end[k]].decode() for k in where[i : i + (1 << 15)]])
                self.first = np.concatenate([self.first, len(self.pool) + first])
                self.sizes = np.concatenate([self.sizes, sizes])
                self.pool = np.concatenate([self.pool, ids])
            self.known.add(new)
            at[unknown] = self.known.find(hashed[unknown])
        return at

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text after another, and the number of ids of each text."""
        data, start, end, text = self.words(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        at = self.number(data, start, end)
        sizes = self.sizes[at]
        counts = np.bincount(text, sizes, len(offsets) - 1).astype(np.int64)
        return self.pool[arrow.ragged(self.first[at], sizes)], counts


_ENCODERS: dict[str, Encoder] = {}

PIECES = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("n_padding", pa.int64())])


def padding(filled: int, capacity: int) -> int:
    """A window is padded to the capacity, unless what it holds is a power of two."""
    return 0 if filled & (filled - 1) == 0 else capacity - filled


def pack(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pack every whole text, followed by `end_id`, into windows of at most `capacity` tokens.

    Returns one row for each piece: the id, start (tokens of its document before
    it), length, ids_crc32, doc_tokens, sequence_id, offset (within the window,
    without gaps) and n_padding of its window. A document longer than a window
    fills whole windows and leaves a remainder. A null text is empty and gives
    the end id alone; a null id stays null; repeated rows are packed each; an empty
    table gives no rows; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []  # remainders: id, start, length, crc, tokens
        held = 0

        def out(found: list[tuple]) -> pa.RecordBatch:
            ids, *numbers = zip(*found, strict=True)
            return pa.record_batch([pa.array(ids, id_kind), *(pa.array(n, pa.int64()) for n in numbers)], names=["__id", *PIECES.names])

        def block() -> pa.RecordBatch:
            nonlocal sequence, waiting, held
            window, n = divide([w[2] for w in waiting], capacity)
            filled = np.bincount(window, [w[2] for w in waiting], n).astype(np.int64)
            at, found = np.zeros(n, np.int64), []
            for w, k in zip(waiting, window, strict=True):
                found.append((*w, sequence + int(k), int(at[k]), padding(int(filled[k]), capacity)))
                at[k] += w[2]
            sequence, waiting, held = sequence + n, [], 0
            return out(found)

        id_kind = None
        for batch in arrow.slices(batches, "__text"):
            id_kind = batch.schema.field("__id").type
            data, offsets = arrow.buffers(batch.column("__text"))
            flat, counts = encoder.ids(data, offsets)
            ends = np.cumsum(counts)
            full = []
            for doc, a, b in zip(batch.column("__id").to_pylist(), ends - counts, ends, strict=True):
                ids = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                whole = len(ids) - len(ids) % capacity
                for s in [*range(0, whole, capacity), *range(whole, len(ids), PART)]:
                    part = ids[s : s + (capacity if s < whole else PART)]
                    piece = (doc, s, len(part), zlib.crc32(part.tobytes()), len(ids))
                    if s < whole:
                        full.append((*piece, sequence, 0, padding(capacity, capacity)))
                        sequence += 1
                    else:
                        waiting.append(piece)
                        held += len(part)
                        if held >= BLOCK_WINDOWS * capacity:
                            yield block()
            if full:
                yield out(full)
        if waiting:
            yield block()

    numbers = ", ".join(f"`{f}` long" for f in PIECES.names)
    out = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(rows, f"__id {id_type}, {numbers}")
    return out.withColumnRenamed("__id", id_col)
