"""Conversation structure repair: the cheapest edits that make turns alternate.

The roles of a sound conversation read, by their initials, `(s?(ua)+)?`. The rows of a
conversation are aligned by Wagner-Fischer tables to this string at each feasible
length. A length is tried while the least that it can cost is no more than the best
found (the incumbent), and its table holds only Ukkonen's band: the drifts between rows
and string that the incumbent's cost allows. Of equally cheap alignments the backtraced
audits are compared, and the one least in ASCII is taken.

A conversation of more than BLOCK rows is aligned block by block, from each state of the
string to each, and the blocks are put together by least cost and audit. That is the
same minimum, since an alignment passes each block's border in one of the four states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from creel.llm import scratch
from creel.operators.grouping import salted_join

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLOCK = 32
#: What may come next: anything, `u` after `s`, `a`, or `u` after `a`. The first and the last may end.
START, SYSTEM, WANT_A, WANT_U = range(4)
STATES = (START, SYSTEM, WANT_A, WANT_U)
GONE = "d"  # a row that must go; upper case marks truncated rows, `x` any other initial


def target(start: int, end: int, length: int) -> str | None:
    """The grammar's string of this length between two states; there is at most one."""
    for head in ("", "s") if start == START else ("",):
        rest = length - len(head)
        if rest < 0:
            continue
        if rest == 0:
            reached = SYSTEM if head else start
        else:
            reached = WANT_A if (rest % 2 == 1) != (start == WANT_A) else WANT_U
        if reached == end:
            return head + (("au" if start == WANT_A else "ua") * (rest // 2 + 1))[:rest]
    return None


def align(codes: str, goal: str, most: int) -> tuple[int, str] | None:
    """Cheapest edits of rows to a string, with the least audit, or None if they cost more than `most`.

    Only the band of the table is filled in which a path of cost `most` can run: at a cell
    the rows kept so far and the string's signs used so far differ by a drift, and the
    rest of the table has to bring it to the last cell's.
    """
    n, m = len(codes), len(goal)
    kept = [0]
    for c in codes:
        kept.append(kept[-1] + (c != GONE))
    last = kept[n] - m
    apart = lambda drift: DELETE * drift if drift > 0 else -INSERT * drift
    spare = most - DELETE * (n - kept[n])
    inside = [d for d in range(-m, kept[n] + 1) if apart(d) + apart(last - d) <= spare]
    if not inside:
        return None
    low, high = inside[0], inside[-1]
    none = most + 1
    table: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row, below = table[i], table[i + 1] if i < n else {}
        code = codes[i] if i < n else GONE
        cut = TRUNCATED if code.isupper() else 0
        for j in range(min(m, kept[i] - low), max(0, kept[i] - high) - 1, -1):
            if i == n and j == m:
                row[j] = 0
                continue
            best = below.get(j, none) + DELETE
            if j < m:
                if goal[j] != "s":
                    best = min(best, row.get(j + 1, none) + INSERT)
                if code != GONE:
                    step = 0 if code.lower() == goal[j] else REROLE if goal[j] != "s" else none
                    best = min(best, below.get(j + 1, none) + cut + step)
            if best <= most:
                row[j] = best
    total = table[0].get(0)
    if total is None:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        left = table[i][j]
        below = table[i + 1] if i < n else {}
        cut = TRUNCATED if i < n and codes[i].isupper() else 0
        if below.get(j, none) + DELETE == left:
            audit.append("D")
            i += 1
        elif j < m and goal[j] != "s" and table[i].get(j + 1, none) + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if codes[i].lower() == goal[j] else "R")
            i, j = i + 1, j + 1
    return total, "".join(audit)


@lru_cache(maxsize=1 << 15)
def block(codes: str, start: int, end: int) -> tuple[int, str] | None:
    """Cheapest edits of a block's rows from one state to another, over all lengths of the string between."""
    kept = sum(c != GONE for c in codes)
    forced = DELETE * (len(codes) - kept)
    best: tuple[int, str] | None = None
    # shorter strings cost a deletion for each row too many, longer ones an insertion for each missing
    ways = sorted((forced + (DELETE * (kept - m) if m < kept else INSERT * (m - kept)), m) for m in range(kept + 2 * len(codes) + 4))
    for least, m in ways:
        if best is not None and least > best[0]:
            break
        goal = target(start, end, m)
        if goal is None or ("s" in goal and "s" not in codes.lower()):
            continue
        found = align(codes, goal, best[0] if best else DELETE * len(codes) + INSERT * m)
        if found is not None and (best is None or found < best):
            best = found
    return best


class Path(NamedTuple):
    """The least audit up to a block's border, as a chain of the blocks' parts."""

    cost: int
    before: Path | None
    part: str

    def less(self, other: Path) -> bool:
        """Cheaper, or as cheap with a lesser audit; equal beginnings are not read."""
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b, x, y = [], [], self, other
        while x is not y:
            a.append(x.part)
            b.append(y.part)
            x, y = x.before, y.before
        return "".join(reversed(a)) < "".join(reversed(b))

    def audit(self) -> str:
        parts, x = [], self
        while x is not None:
            parts.append(x.part)
            x = x.before
        return "".join(reversed(parts))


def onward(paths: dict[int, Path], codes: str, ends: tuple[int, ...] = STATES) -> dict[int, Path]:
    """The best path to each state behind one more block.

    Two audits of equal cost to one state are never one the beginning of the other, as
    the longer would have insertions more, so the lesser stays so whatever follows.
    """
    out: dict[int, Path] = {}
    for start, path in paths.items():
        for end in ends:
            found = block(codes, start, end)
            if found is None:
                continue
            new = Path(path.cost + found[0], path, found[1])
            if end not in out or new.less(out[end]):
                out[end] = new
    return out


def ended(paths: dict[int, Path], codes: str) -> tuple[int, str]:
    """Cost and audit of a conversation whose last block this is: nothing said, or an answer last."""
    last = onward(paths, codes, (START, WANT_U))
    return min((p.cost, p.audit()) for p in last.values())


def repair(codes: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation, given one sign for each row."""
    paths = {START: Path(0, None, "")}
    while len(codes) > BLOCK:
        paths, codes = onward(paths, codes[:BLOCK]), codes[BLOCK:]
    return ended(paths, codes)


class Repaired:
    """Rows of a conversation, given one by one, as the turns that its audit makes of them."""

    def __init__(self, audit: str):
        self.audit, self.at = audit, 0
        out = len(audit) - audit.count("D")
        self.system, self.turn = out % 2, 0
        self.hash, self.first = hashlib.sha256(), True

    def _say(self, role: str | None, text: str) -> None:
        place = self.turn - self.system
        role = ("user", "assistant")[place % 2] if role is None else role
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.turn, self.first = self.turn + 1, False

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._say(None, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._say(role if edit == "K" else None, text)

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with faults by a checksum of their id and turn: conv_id, turn, role, text.

    Of 20 remainders 0 drops the row, 1 empties the text, 2 removes its marks, 3 repeats
    the row and 4 makes it the user's. A null is one blank, in the checksum too.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), named("role").alias("role"), named("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def _key(*columns: str) -> Column:
    """A digest of values and nulls, not null itself."""
    told = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*told), 256)


def coded(rows: DataFrame) -> DataFrame:
    """Rows with the sign of their fault and initial, and whether an earlier turn says the same.

    What is said twice in a conversation is found by partial aggregation and joined
    back with hot keys dealt out, so one text that fills a conversation costs no task more.
    """
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    whole = F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(blank, "b").when(~whole, F.upper(code)).otherwise(code)
    rows = rows.withColumn("code", code).withColumn("key", _key("conv_id", "role", "text"))
    turn = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    said = rows.groupBy("key").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    found = salted_join(rows, said, ["key"], "left")
    return found.withColumn("again", F.coalesce(turn > F.col("first"), F.lit(False))).select("conv_id", "turn", "role", "text", "code", "key", "again")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Counts:
    """Counts of one conversation, its signs up to a block, and its best paths so far."""

    def __init__(self):
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = None
        self.initial, self.key, self.codes = None, None, []
        self.paths = {START: Path(0, None, "")}

    def row(self, turn: int | None, role: str, code: str, key: str, again: bool) -> None:
        if turn is not None and turn != self.most:
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if code == "b":
            self.blank += 1
            code = GONE
        elif again or key == self.key:
            self.duplicate += 1
            code = GONE
        elif code.isupper():
            self.truncated += 1
        self.key = key
        if len(self.codes) == BLOCK:
            self.paths, self.codes = onward(self.paths, "".join(self.codes)), []
        self.codes.append(code)

    def done(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        cost, audit = ended(self.paths, "".join(self.codes))
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _streamed(rows: DataFrame, schema: str, opened, take, close) -> DataFrame:
    """Rows by conversation, kind, turn, role and text, each conversation folded into one row.

    A row of kind 0 opens each conversation. One conversation at a time is held.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, ids = None, [], []
        for batch in batches:
            for conv, row in zip(batch.column("conv_id").to_pylist(), batch.to_pylist(), strict=True):
                if row["kind"] == 0:
                    if now is not None:
                        out.append(close(now))
                    now = opened(row)
                    ids.append(conv)
                else:
                    take(now, row)
            if out:
                yield made(ids[: len(out)], out, batch.schema.field("conv_id").type)
                ids, out = ids[len(out) :], []
            kind = batch.schema.field("conv_id").type
        if now is not None:
            yield made(ids, [close(now)], kind)

    def made(ids: list, out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(ids, kind)]
        for values, named in zip(zip(*out, strict=True), schema.split(", "), strict=True):
            columns.append(pa.array(values, pa.int64() if named.endswith("long") else pa.string()))
        return pa.record_batch(columns, names=["conv_id", *[x.split()[0] for x in schema.split(", ")]])

    return rows.mapInArrow(run, f"conv_id {id_type}, {schema}")


def turn_repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Faults of every conversation, the audit of its cheapest repair, and a digest of the repaired turns.

    rows: conv_id, turn, role, text; other columns are ignored. conversations: ids that
    get a row of zeros where rows have none of them (a null id is one conversation).
    Rows are ordered by turn, nulls first, those of one turn by role and text. A null
    role or text is one blank. A row's first fault counts: blank, said before, cut off.
    An empty table gives no rows but those of conversations. Texts are taken whole; one
    task reads a conversation row by row, as its digest is one ordered hash, and holds
    its audit, about a byte for each row.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    signs = scratch.written(coded(own))
    every = signs.select("conv_id") if conversations is None else signs.select("conv_id").union(conversations.select("conv_id"))
    empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
    opening = every.distinct().select("conv_id", F.lit(0).alias("kind"), empty("turn", "long"), empty("role", "string"), empty("text", "string"), empty("code", "string"), empty("key", "string"), empty("again", "boolean"))
    turns = signs.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "code", "key", "again")
    audits = _streamed(opening.union(turns), RESULT, lambda row: _Counts(), lambda now, row: now.row(row["turn"], row["role"], row["code"], row["key"], row["again"]), lambda now: now.done())
    audits = scratch.written(audits)
    # once more in the same order, now with each conversation's audit before its rows
    said = turns.select("conv_id", "kind", "turn", "role", "text", F.lit("").alias("code"))
    given = audits.select("conv_id", F.lit(0).alias("kind"), empty("turn", "long"), empty("role", "string"), empty("text", "string"), F.col("audit").alias("code"))
    hashes = _streamed(given.union(said), "repaired_sha256 string", lambda row: Repaired(row["code"]), lambda now, row: now.row(row["role"], row["text"]), lambda now: (now.digest(),))
    hashes = hashes.withColumnRenamed("conv_id", "__id")
    return audits.join(hashes, audits["conv_id"].eqNullSafe(hashes["__id"])).drop("__id")
