"""Token counts by a compiled finite-state transducer.

A byte-level BPE tokenizer is a function of the text whose value at a prefix, the
number of tokens if the text ended there, depends on a short tail of the prefix:
the open piece of the split pattern, of it the longest suffix that could still
begin a token, and the last token at each place of that suffix. These tails are
the states. A transition reads one byte and carries the change of the count, so
the count of a text is the sum of the weights along its path. States and
transitions are compiled when first met and kept as one integer table, which is
emptied when full.

Texts are cut into chunks. A chunk that begins with a blank before a solid byte
begins a piece whatever came before, so its state map is constant. Where no such
place is near, the cut is hard, and the chunk's map takes the state in which the
chunk before it ends. Chunk maps compose in order and the counts add up.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from creel.llm import arrow

CHUNK = 2048
MAX_STATES = 1 << 17
MISSING = np.int32(-1)
BIAS = 128
LISTED = 64

# fixed values: the code points with the property White_Space
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
# fixed values: the endings that the split pattern takes together with an apostrophe
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def kind(ch: str) -> str:
    """The class of a character in the split pattern: white space, letter, number or other."""
    if ch in WHITE_SPACE:
        return "W"
    return {"L": "L", "N": "N"}.get(unicodedata.category(ch)[0], "P")


class Run:
    """The open part of a piece: what its further tokens can depend on.

    suffix: its longest suffix that begins a longer token. marks: for the end and
    for each place in the suffix from which a longer token can still reach beyond
    the end, the distance to the end, the tokens that can begin there (a listed set,
    or the token before it, b"" at the piece's start) and the number of tokens up to
    there less that at the end.
    """

    __slots__ = ("suffix", "marks", "key")

    def __init__(self, suffix: bytes, marks: dict[int, tuple[bytes | frozenset, int]]):
        self.suffix, self.marks = suffix, marks
        self.key = (suffix, tuple(marks.items()))


EMPTY = Run(b"", {0: (b"", 0)})


class Transducer:
    """Counts the tokens of one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, max_states: int = MAX_STATES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("only a byte-level BPE with its usual split pattern is compiled")
        byte = byte_of()
        raw = lambda s: bytes(byte[c] for c in s)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.vocab = {raw(t) for t in spec["model"]["vocab"] if all(c in byte for c in t)} - set(self.special)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.heads: dict[bytes, list[bytes] | None] = {}  # longer tokens by their beginning; None: too many to list
        for t in self.vocab:
            for i in range(1, len(t)):
                longer = self.heads.setdefault(t[:i], [])
                if longer is not None:
                    longer.append(t)
                    if len(longer) > LISTED:
                        self.heads[t[:i]] = None
        self.sets: dict = {}
        self.shared: dict[frozenset, frozenset] = {}
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for (a, b), i in self.rank.items():
            self.made.setdefault(a + b, (i, a, b))
        self.whole: dict[bytes, bool] = {}
        self.max_states = max_states
        self.reset()

    def reset(self) -> None:
        self.number: dict = {}
        self.states: list = []
        self.table = np.full((256, 256), MISSING, np.int32)
        self.start = self.intern(("0",))

    def key(self, state: tuple) -> tuple:
        return tuple(x.key if isinstance(x, Run) else self.key(x) if isinstance(x, tuple) else x for x in state)

    def intern(self, state: tuple) -> int:
        key = self.key(state)
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(state)
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, MISSING)])
        return n

    # the pair-merge rule, used on one or two tokens at a time

    def encode(self, text: bytes) -> list[bytes]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            i = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[i] == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def reachable(self, token: bytes) -> bool:
        if token not in self.whole:
            self.whole[token] = self.encode(token) == [token]
        return self.whole[token]

    def adjacent(self, a: bytes, b: bytes) -> bool:
        """Whether two tokens stay two when their bytes meet.

        Their merges are undone from the last to the first. At each moment the two
        parts at the border must not be a pair that would have been merged by then;
        of equal merges the left one comes first.
        """
        limit = len(self.rank)
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < limit:
                return False
            made_a, made_b = self.made.get(a), self.made.get(b)
            if made_a is None and made_b is None:
                return True
            if made_b is None or made_a is not None and made_a[0] > made_b[0]:
                limit, _, a = made_a
            else:
                limit, b = made_b[0] + 1, made_b[1]

    def follows(self, before: bytes, token: bytes) -> bool:
        return token in self.vocab and self.reachable(token) and (before == b"" or self.adjacent(before, token))

    def narrowed(self, allowed: bytes | frozenset, head: bytes) -> bytes | frozenset | None:
        """What may still be the token that begins with `head`, given the token before it or the set known so far.

        A small set is listed, so that places which differ only in what went before become one state.
        """
        made = self.sets.get((allowed, head))
        if made is None and head in self.heads:
            longer = self.heads[head]
            if isinstance(allowed, frozenset):
                made = frozenset(t for t in allowed if len(t) > len(head) and t.startswith(head))
            elif longer is None:
                return allowed
            else:
                made = frozenset(t for t in longer if self.follows(allowed, t))
            made = self.sets[allowed, head] = self.shared.setdefault(made, made)
        return made

    def extend(self, run: Run, more: bytes) -> tuple[Run, int]:
        """The run after further bytes and the change of its number of tokens."""
        change = 0
        for i in range(len(more)):
            tail = run.suffix + more[i : i + 1]
            for back in sorted(run.marks, reverse=True):
                token = tail[len(tail) - back - 1 :]
                allowed, rel = run.marks[back]
                if token in allowed if isinstance(allowed, frozenset) else self.follows(allowed, token):
                    break
            step = rel + 1
            marks = {0: (token, 0)}
            for back, (allowed, rel) in run.marks.items():
                left = self.narrowed(allowed, tail[len(tail) - back - 1 :])
                if left or left == b"":
                    marks[back + 1] = (left, rel - step)
            most = max(marks)
            run = Run(tail[len(tail) - most :], marks)
            change += step
        return run, change

    # the split pattern

    def fresh(self, ch: str, raw: bytes) -> tuple[tuple, int]:
        """A piece begins with this character."""
        if ch == "'":
            return ("A",), 1
        run, n = self.extend(EMPTY, raw)
        if (k := kind(ch)) == "W":
            return ("W", run, -n, ch), n
        return (k, run, ""), n

    def after(self, state: tuple, ch: str, raw: bytes) -> tuple[tuple, int]:
        """The state after one more character and the change of the count."""
        mode, k = state[0], kind(ch)
        if mode == "0":
            return self.fresh(ch, raw)
        if mode == "A":
            run, n = self.extend(EMPTY, b"'")
            if ch in ENDINGS:
                return ("0",), self.extend(run, raw)[1]
            if k == "P":
                run, n = self.extend(run, raw)
                return ("P", run, ""), n
            (to, *rest), n = self.fresh(ch, raw)
            return ((to, rest[0], ch) if any(e[0] == ch for e in ENDINGS) else (to, *rest)), n
        if mode == "W":
            _, run, less, end = state
            if k == "W":
                run, n = self.extend(run, raw)
                return ("W", run, -n, ch), n
            if end == " ":
                run, n = self.extend(EMPTY, b" " + raw)
                return (k, run, ""), less + n
            to, n = self.fresh(ch, raw)
            return to, less + self.extend(EMPTY, end.encode())[1] + n
        _, run, began = state
        if began and began + ch in ENDINGS:
            return ("0",), self.extend(EMPTY, ("'" + began + ch).encode())[1] - 2
        if k == mode:
            run, n = self.extend(run, raw)
            return (k, run, ""), n
        return self.fresh(ch, raw)

    def compile(self, state: int, byte: int) -> None:
        """Add the transition that reads the byte in the state."""
        now = self.states[state]
        base, raw = now[1:] if now[0] == "+" else (now, b"")
        raw += bytes([byte])
        need = 1 if raw[0] < 0x80 else 2 if raw[0] < 0xE0 else 3 if raw[0] < 0xF0 else 4
        to, weight = (("+", base, raw), 0) if len(raw) < need else self.after(base, raw.decode(), raw)
        n = self.intern(to)
        self.table[state, byte] = n * 256 + weight + BIAS

    def walk(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, entry: list[tuple | None]) -> tuple[np.ndarray, list[tuple]]:
        """Count and last state of every chunk, all chunks abreast; entry None: the first state."""
        order = np.argsort(start - end, kind="stable")
        at, sizes = start[order].copy(), (end - start)[order]
        state = np.array([self.start if entry[i] is None else self.intern(entry[i]) for i in order], np.int64)
        count = np.zeros(len(at), np.int64)
        active = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left")
        for k in active:
            byte = data[at[:k]]
            cell = state[:k] * 256 + byte
            got = self.table.ravel().take(cell)
            if (got < 0).any():
                if len(self.states) + 512 > self.max_states:
                    held = [self.states[s] for s in state]
                    self.reset()
                    state = np.array([self.intern(s) for s in held], np.int64)
                    cell = state[:k] * 256 + byte
                    got = self.table.ravel().take(cell)
                for c in np.unique(cell[got < 0]):
                    self.compile(int(c) >> 8, int(c) & 255)
                got = self.table.ravel().take(cell)
            count[:k] += (got & 255) - BIAS
            state[:k] = got >> 8
            at[:k] += 1
        n, last = np.empty(len(at), np.int64), [None] * len(at)
        n[order] = count
        for i, s in zip(order, state, strict=True):
            last[i] = self.states[s]
        return n, last

    def counts(self, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """The number of tokens of every text."""
        total = np.zeros(len(offsets) - 1, np.int64)
        solid = (data > 0x20) & (data < 0x7F)
        sync = np.flatnonzero((data[:-1] == 0x20) & solid[1:]) if len(data) else np.zeros(0, np.int64)
        start, end, text, hard = [], [], [], []
        for i in range(len(total)):
            for a, b in self.segments(data, int(offsets[i]), int(offsets[i + 1]), total, i):
                joined = False
                while b > a:
                    cut = b
                    if b - a > chunk:
                        p = np.searchsorted(sync, a + chunk, side="right") - 1
                        cut = int(sync[p]) if p >= 0 and sync[p] > a else a + chunk
                    start.append(a), end.append(cut), text.append(i), hard.append(joined)
                    joined = cut < b and not (data[cut] == 0x20 and cut + 1 < b and solid[cut + 1])
                    a = cut
        if not start:
            return total
        start, end, text, hard = np.array(start), np.array(end), np.array(text), np.array(hard)
        entry: list = [None] * len(start)
        ready = np.flatnonzero(~hard)
        while len(ready):
            n, last = self.walk(data, start[ready], end[ready], [entry[i] for i in ready])
            np.add.at(total, text[ready], n)
            ahead = [(i + 1, s) for i, s in zip(ready, last, strict=True) if i + 1 < len(hard) and hard[i + 1]]
            for i, s in ahead:
                entry[i] = s
            ready = np.array([i for i, _ in ahead], np.int64)
        return total

    def segments(self, data: np.ndarray, a: int, b: int, total: np.ndarray, i: int) -> Iterator[tuple[int, int]]:
        """The parts of a text between special strings; each such string is one token."""
        raw = data[a:b].tobytes()
        if not any(s in raw for s in self.special):
            yield a, b
            return
        at = 0
        while at <= len(raw):
            found = min(((p, -len(s)) for s in self.special if (p := raw.find(s, at)) >= 0), default=None)
            if found is None:
                break
            yield a + at, a + found[0]
            total[i] += 1
            at = found[0] - found[1]
        yield a + at, b


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One transducer for each file and worker; what it has compiled serves all later batches."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Tokens of every whole text by the tokenizer in the file `path`, which every worker can read.

    Returns one row for each row of docs: the id, n_bytes, n_tokens and over_limit
    (more than `limit` tokens). A null text is empty and has no token, a null id
    stays null, repeated rows are counted each, an empty table gives no rows, and
    other columns are ignored. Nothing is shuffled.
    """

    def count(batches):
        machine = transducer(path)
        for batch in arrow.slices(batches, "__text"):
            data, offsets = arrow.buffers(batch.column("__text"))
            yield pa.record_batch([batch.column("__id"), pa.array(np.diff(offsets)), pa.array(machine.counts(data, offsets))], names=["__id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind_of_id = rows.schema["__id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"__id {kind_of_id}, n_bytes long, n_tokens long")
    return out.select(F.col("__id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
