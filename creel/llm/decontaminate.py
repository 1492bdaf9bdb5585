"""Benchmark passages in texts by the q-gram lemma and banded alignment.

A passage of m characters that a text holds with at most e edits shares at least
m - q + 1 - q * e of its q-grams with it, on diagonals that lie within e of each
other. Shared q-grams are counted in overlapping bands of diagonals, bands that
reach the bound are regions, and each region is aligned within its band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from creel.llm import arrow

Q = 8
EDIT_PERCENT = 10
BLOCK_CHARS = 1 << 22
FILTER_BITS = 22

_FACTOR = 0x9E3779B97F4A7C15
_FOLD: list[np.ndarray] = []


def _folding() -> np.ndarray:
    fold = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x10000):
        low = chr(c).lower()
        if len(low) == 1:
            fold[c] = ord(low)
        if chr(c).isspace():
            fold[c] = 0x20
    return fold


def plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts in lower case with single blanks, where each text begins, and the byte place of each character."""
    if not _FOLD:
        _FOLD.append(_folding())
    data, offsets = arrow.buffers(texts)
    lead = (data & 0xC0) != 0x80
    c = _FOLD[0][np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    at = np.concatenate([[0], np.cumsum(lead)])[offsets]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0x20) | (c[:-1] != 0x20)
    keep[at[:-1][at[:-1] < len(c)]] = True
    return c[keep], np.concatenate([[0], np.cumsum(keep)])[at], np.flatnonzero(lead)[keep]


def qgrams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q characters from every place on; none from the last q - 1 places."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, size = c.astype(np.uint64) + np.uint64(1), 1
    out, done, rest = None, 0, q
    while rest:
        if rest & 1:
            part = h[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(_FACTOR, size, 1 << 64)) + part
            done += size
        rest >>= 1
        if rest:
            h = h[:-size] * np.uint64(pow(_FACTOR, size, 1 << 64)) + h[size:]
            size *= 2
    return out * np.uint64(_FACTOR)


def budget(m: int, percent: int = EDIT_PERCENT, q: int = Q) -> int:
    """Edits allowed in a passage: a percentage of its length, less where the lemma would then say nothing."""
    return min(m * percent // 100, (m - q) // q)


class Passages:
    """q-gram index of a block of benchmark passages."""

    def __init__(self, ids: list, texts: list[str | None], percent: int, q: int = Q):
        c, at, _ = plain(pa.array(texts, pa.string()))
        parts = [c[a:b] for a, b in zip(at, at[1:], strict=False)]
        strip = lambda x: x[1 if len(x) and x[0] == 0x20 else 0 : len(x) - (len(x) > 1 and x[-1] == 0x20)]
        both = [(i, strip(x)) for i, x in zip(ids, parts, strict=True)]
        both = [(i, x) for i, x in both if len(x) >= q]  # a shorter one cannot be told from chance
        self.ids, self.chars, self.q = [i for i, _ in both], [x for _, x in both], q
        self.edits = np.array([budget(len(x), percent, q) for x in self.chars], np.int64)
        self.least = np.array([len(x) - q + 1 for x in self.chars], np.int64) - q * self.edits
        grams = [qgrams(x, q) for x in self.chars]
        gram = np.concatenate([np.zeros(0, np.uint64), *grams])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])
        order = np.argsort(gram, kind="stable")
        self.item, self.place = item[order], place[order]
        self.gram, self.first, self.sizes = np.unique(gram[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.gram >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def regions(self, c: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Text, passage, first diagonal of the band and shared q-grams of every band that reaches the bound."""
        h = qgrams(c, self.q)
        hit = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(hit) or not len(self.gram):
            return
        k = np.minimum(np.searchsorted(self.gram, h[hit]), len(self.gram) - 1)
        same = self.gram[k] == h[hit]
        hit, k = hit[same], k[same]
        text = np.searchsorted(at, hit, side="right") - 1
        inside = hit + self.q <= at[text + 1]
        hit, k, text = hit[inside], k[inside], text[inside]
        sizes = self.sizes[k]
        where = arrow.ragged(self.first[k], sizes)
        item, place = self.item[where], self.place[where]
        text, hit = np.repeat(text, sizes), np.repeat(hit, sizes)
        _, pair, n = np.unique(text * len(self.ids) + item, return_inverse=True, return_counts=True)
        enough = n[pair] >= self.least[item]
        text, item, place, hit = text[enough], item[enough], place[enough], hit[enough]
        if not len(hit):
            return
        width = self.edits[item] + 1
        band = (hit - at[text] - place + len(c)) // width  # never negative
        key = np.concatenate([band, band - 1])
        text, item, place, hit = (np.tile(x, 2) for x in (text, item, place, hit))
        order = np.lexsort((key, item, text))
        text, item, key, place, hit = (x[order] for x in (text, item, key, place, hit))
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (key[1:] != key[:-1])]))
        n = np.diff(np.append(new, len(key)))
        many = n >= self.least[item[new]]
        for i, size in zip(new[many], n[many], strict=True):
            # each q-gram of either side counts once
            shared = min(len(np.unique(place[i : i + size])), len(np.unique(hit[i : i + size])))
            if shared >= self.least[item[i]]:
                yield int(text[i]), int(item[i]), int(key[i] * (self.edits[item[i]] + 1)) - len(c), int(shared)

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int, int]]:
        """Text, passage, shared q-grams, edits, first and last byte of the best region of each pair."""
        c, at, byte = plain(texts)
        best: dict[tuple[int, int], tuple] = {}
        for text, item, low, shared in self.regions(c, at):
            e = int(self.edits[item])
            if best.get((text, item), (1,))[0] == 0:
                continue
            found = align(self.chars[item], c[at[text] : at[text + 1]], low, low + 2 * e + 1, e)
            if found is not None:
                now = (found[0], -shared, found[1])
                best[text, item] = min(best.get((text, item), now), now)
        for (text, item), (edits, shared, last) in sorted(best.items()):
            end = at[text] + last
            start = max(at[text], end - len(self.chars[item]))
            yield text, item, -shared, edits, int(byte[start]), int(byte[end - 1])


def align(passage: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int] | None:
    """Fewest edits between the passage and a part of the text, and where the part ends; None above the budget.

    Only diagonals from low - edits to high + edits are filled: cell d of row i stands
    for i characters of the passage and i + d of the text.
    """
    low, high = low - edits, high + edits
    d = np.arange(low, high + 1)
    away = len(passage) + len(text) + 1
    row = np.where((d >= 0) & (d <= len(text)), 0, away)
    # the part of the text that the band can touch; places outside it equal nothing
    part = np.full(len(passage) + len(d), -1, np.int64)
    a, b = max(low, 0), min(high + len(passage), len(text))
    part[a - low : b - low] = text[a:b]
    other = part[np.arange(len(passage))[:, None] + np.arange(len(d))] != passage[:, None]
    for i in range(1, len(passage) + 1):
        now = row + other[i - 1]
        np.minimum(now[:-1], row[1:] + 1, out=now[:-1])
        now -= d
        row = np.minimum.accumulate(now) + d
        if low + i < 0 or high + i > len(text):
            row[(d + i < 0) | (d + i > len(text))] = away
        if not i & 7 and row.min() > edits:
            return None
    if row.min() > edits:
        return None
    k = int(row.argmin())
    return int(row[k]), int(d[k] + len(passage))


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", most: int = BLOCK_CHARS, percent: int = EDIT_PERCENT) -> Iterator[Passages]:
    """The benchmark in blocks of about `most` characters, so that what is shipped at once is bounded."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // most))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        held = part.orderBy("i", "t").collect()
        yield Passages([r["i"] for r in held], [r["t"] for r in held], percent)


def passages_in(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = EDIT_PERCENT) -> DataFrame:
    """Benchmark passages that whole texts hold with few edits.

    Letter case and the amount of white space do not count. Returns one row for each
    row of docs and passage: the id, item_id, shared_qgrams, edits, first_byte and
    last_byte of the place found in the text. Passages of fewer than Q characters and null texts match
    nothing; a null id stays null; repeated rows match each; an empty table on either
    side gives no rows; other columns are ignored.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    out = None
    for block in blocks(benchmark, item_col, item_text_col, percent=percent):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def found(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            held = shipped.value
            item_kind = pa.array(held.ids).type if held.ids else pa.int64()
            for batch in arrow.slices(batches, "__text"):
                rows = list(held.matches(batch.column("__text")))
                if rows:
                    text, item, *numbers = zip(*rows, strict=True)
                    yield pa.record_batch([batch.column("__id").take(pa.array(text)), pa.array([held.ids[i] for i in item], item_kind), *(pa.array(n, pa.int64()) for n in numbers)], names=["__id", "__item", "shared_qgrams", "edits", "first_byte", "last_byte"])

        part = given.mapInArrow(found, f"__id {id_type}, __item {item_type}, shared_qgrams long, edits long, first_byte long, last_byte long")
        out = part if out is None else out.union(part)
    return out.withColumnsRenamed({"__id": id_col, "__item": item_col})


def contaminated(text: Column, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", percent: int = EDIT_PERCENT) -> Column:
    """Whether a whole text holds a passage of the benchmark; a null text holds none."""
    out = F.lit(False)
    for block in blocks(benchmark, item_col, item_text_col, percent=percent):
        out = out | _holds(benchmark.sparkSession.sparkContext.broadcast(block))(text)
    return out


def _holds(shipped):
    @F.arrow_udf("boolean")
    def held(texts: pa.Array) -> pa.Array:
        out, at = np.zeros(len(texts), bool), 0
        for batch in arrow.slices(iter([pa.record_batch([texts], names=["text"])])):
            for row in shipped.value.matches(batch.column("text")):
                out[at + row[0]] = True
            at += batch.num_rows
        return pa.array(out)

    return held
