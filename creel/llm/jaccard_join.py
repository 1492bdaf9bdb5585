"""Near-duplicate texts: exact Jaccard links on word shingles, and their components.

1. Every text becomes a set of shingle hashes. Texts with equal sets are one class
   from here on.
2. Two sets with the wanted similarity share a known number of the first shingles of
   each, in any order that is the same for all. The order puts shingles that many texts
   hold last and is random otherwise. Classes that share such a shingle meet in a
   group; a class that meets others in too few groups has no partner.
3. In most groups all classes are copies of each other. One pair for each class, with
   the smallest class of the groups that it stands in most often, is checked first,
   and the components these pairs make are set aside.
4. Groups that still hold several components are cut into tiles by bands of set
   size, large tiles into blocks. Within a tile hashed bitmaps bound the overlap of
   each pair from above: a bit that only one side has is an element the other
   lacks. Pairs that the bound lets through get the exact intersection. The first
   time each row shows only its best partner, so that a large group of near copies
   falls to few components by a number of pairs that grows as its rows; the second
   time all pairs of what are still different components are shown.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, LongType

from creel.llm import arrow, scratch
from creel.llm.components import components

WORDS = 5
PERCENT = 80
COMMON_SHARE = 2000  # a shingle is common from one text in so many on
TILE = 1024
BLOOM_BITS = 23
REMEMBER = 1 << 18
SPREAD = 4  # bits of a bitmap for each element
MOST_BITS = 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """The sorted set of shingle hashes of every text; a text of fewer words is one shingle, one without words none."""
    data = arrow.LOWER[data]
    start, end, text = arrow.words(data, offsets)
    word = arrow.hashes(data, start, end)
    at = arrow.runs(text, len(offsets) - 1)
    factor = np.uint64(0x9E3779B97F4A7C15)
    full = word[: max(0, len(word) - k + 1)].copy()
    for j in range(1, k):
        full = arrow.mix(full) * factor + word[j : j + len(full)]
    full = arrow.mix(full).view(np.int64)
    sets = []
    for a, b in zip(at, at[1:], strict=False):
        if b - a >= k:
            sets.append(np.unique(full[a : b - k + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in word[a:b]:
                h = arrow.mix(h * factor + w)
            sets.append(h.view(np.int64))
        else:
            sets.append(np.zeros(0, np.int64))
    return sets


def fingerprint(s: np.ndarray) -> int:
    """One number for a set; equal sets have equal numbers."""
    place = np.arange(1, len(s) + 1, dtype=np.uint64)
    h = arrow.mix(s.view(np.uint64) + place * np.uint64(0xD6E8FEB86659FD93))
    return int(arrow.mix(np.array([np.bitwise_xor.reduce(h, initial=np.uint64(0)) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def prefix(n: int, percent: int) -> int:
    """How many first shingles a set must show.

    Left out are fewer than ceil(percent of n) - n // 10 of n, so of the elements
    that two partners share the first 1 + m // 10 are among those of both, with m the
    smaller size, which is at least percent of the larger.
    """
    return min(n, n - -(-percent * n // 100) + 1 + n // 10)


def frames(**columns: tuple) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, t) for x, t in columns.values()], names=list(columns))


LONG, INT = pa.int64(), pa.int32()


class Sets:
    """The steps that read texts; sent to the executors."""

    def __init__(self, k: int, percent: int, common: np.ndarray | None = None, bloom: np.ndarray | None = None):
        self.k, self.percent, self.common, self.bloom = k, percent, common, bloom

    def members(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's id, size and class; and shingles that several texts of a slice hold, with their number."""
        for batch in arrow.slices(batches, "__text"):
            sets = shingle_sets(*arrow.buffers(batch.column("__text")), self.k)
            n, of = pa.array([len(s) for s in sets], INT), pa.array([fingerprint(s) for s in sets], LONG)
            yield pa.record_batch([batch.column("__id"), n, of, pa.nulls(len(sets), LONG), pa.nulls(len(sets), LONG)], names=["__id", "n", "class", "shingle", "texts"])
            found, texts = np.unique(np.concatenate(sets), return_counts=True)
            many = texts >= 4
            if many.any():
                m = int(many.sum())
                yield pa.record_batch([pa.nulls(m, batch.column("__id").type), pa.nulls(m, INT), pa.nulls(m, LONG), pa.array(found[many]), pa.array(texts[many])], names=["__id", "n", "class", "shingle", "texts"])

    def classes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """Sets of the texts of a task, equal ones seldom twice."""
        seen: set[int] = set()
        for batch in arrow.slices(batches, "__text"):
            for s in shingle_sets(*arrow.buffers(batch.column("__text")), self.k):
                if len(s) and (h := fingerprint(s)) not in seen:
                    if len(seen) >= REMEMBER:
                        seen.clear()
                    seen.add(h)
                    yield h, s
            yield 0, np.zeros(0, np.int64)  # a slice is done

    def keys(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first shingles of every class."""
        key, of, n = [], [], []
        for h, s in self.classes(batches):
            if len(s):
                p = prefix(len(s), self.percent)
                if len(self.common):
                    at = np.minimum(np.searchsorted(self.common, s), len(self.common) - 1)
                    late = self.common[at] == s
                    s = np.concatenate([s[~late], s[late]])
                key.append(s[:p]), of.append(np.full(p, h)), n.append(np.full(p, len(s)))
            elif key:
                yield frames(key=(np.concatenate(key), LONG), **{"class": (np.concatenate(of), LONG)}, n=(np.concatenate(n), INT))
                key, of, n = [], [], []

    def wanted(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of classes that may have a partner."""
        of, sets = [], []
        for h, s in self.classes(batches):
            if len(s):
                if all(in_bloom(self.bloom, h)):
                    of.append(h), sets.append(s)
            elif of:
                at = np.cumsum([0, *map(len, sets)])
                yield pa.record_batch([pa.array(of, LONG), pa.ListArray.from_arrays(pa.array(at, INT), pa.array(np.concatenate(sets)))], names=["class", "shingles"])
                of, sets = [], []


def bloom_places(classes: np.ndarray) -> np.ndarray:
    h = arrow.mix(classes.view(np.uint64))
    return np.stack([h & np.uint64((1 << BLOOM_BITS) - 1), (h >> np.uint64(32)) & np.uint64((1 << BLOOM_BITS) - 1)]).astype(np.int64)


def in_bloom(bloom: np.ndarray, h: int) -> list[bool]:
    return [bool(bloom[p >> 6] >> np.uint64(p & 63) & np.uint64(1)) for p in bloom_places(np.array([h], np.int64)).ravel().tolist()]


def bloom_of(classes: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size, 2 ** BLOOM_BITS bits; what it lets through too much is only read in vain."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << BLOOM_BITS, bool)
        for batch in batches:
            held[bloom_places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)).ravel()] = True
        words = np.packbits(held, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.record_batch([pa.array(at), pa.array(words[at])], names=["at", "word"])

    rows = classes.select("class").mapInArrow(bits, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    out = np.zeros(1 << BLOOM_BITS - 6, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64)
    return out.view(np.uint64)


GROUPS = "key long, class long, n int, before long"


def grouped(percent: int):
    """Rows sorted by key, size and class, each class of a key once: those with a partner of fitting size, and the group's first class if it fits, else the one before."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the rows not decided yet: the one before the last and the last
        lead: tuple = (None, 0, 0)  # the first row of the last group
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            # a class comes once from each task that holds it; one row stands for all
            new = np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
            rows = [x[new] for x in rows]
            yield from emit(rows, 0 if held is None else held[0].size - 1, False, lead)
            if rows[0][-1] != lead[0]:
                at = np.searchsorted(rows[0], rows[0][-1])
                lead = tuple(int(x[at]) for x in rows)
            keep = min(2, len(rows[0]))
            held = [x[-keep:] for x in rows]
        if held is not None:
            yield from emit(held, len(held[0]) - 1, True, lead)

    def emit(rows: list[np.ndarray], first: int, last: bool, lead: tuple) -> Iterator[pa.RecordBatch]:
        key, of, n = rows
        fits = (key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:])  # with the row before
        back = np.concatenate([[False], fits])
        ahead = np.concatenate([fits, [False]])
        stay = back | ahead
        to = len(key) if last else len(key) - 1
        at = np.flatnonzero(stay[first:to]) + first
        if len(at):
            start = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(len(key)), 0))[at]
            old = key[at] == lead[0] if lead[0] is not None else np.zeros(len(at), bool)
            lead_of, lead_n = np.where(old, lead[1], of[start]), np.where(old, lead[2], n[start])
            before = np.where(100 * lead_n >= percent * n[at], lead_of, np.where(back[at], of[at - 1], of[at]))
            yield frames(key=(key[at], LONG), **{"class": (of[at], LONG)}, n=(n[at], INT), before=(before, LONG))

    return stream


@F.arrow_udf(LongType())
def intersection(a: pa.Array, b: pa.Array) -> pa.Array:
    """Size of the intersection of two sorted arrays."""
    out = np.zeros(len(a), np.int64)
    left, right = np.asarray(a.values), np.asarray(b.values)
    la, lb = np.asarray(a.offsets), np.asarray(b.offsets)
    for i in range(len(a)):
        x, y = left[la[i] : la[i + 1]], right[lb[i] : lb[i + 1]]
        at = np.searchsorted(y, x)
        out[i] = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return pa.array(out)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose exact similarity is reached."""
    one = sets.select(F.col("class").alias("u"), F.col("shingles").alias("su"))
    two = sets.select(F.col("class").alias("v"), F.col("shingles").alias("sv"))
    both = pairs.join(one, "u").join(two, "v").withColumn("common", intersection("su", "sv"))
    union = F.size("su") + F.size("sv") - F.col("common")
    return both.where(100 * F.col("common") >= percent * union).select("u", "v")


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    held = np.zeros(1 << bits, bool)
    held[(s.view(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").view(np.uint64)


def own_bits(n: int) -> int:
    return min(MOST_BITS, max(6, int(SPREAD * n - 1).bit_length()))


@F.arrow_udf(BinaryType())
def signature(sets: pa.Array) -> pa.Array:
    """A bitmap of a set's hashes with about SPREAD bits for each element."""
    flat, at = np.asarray(sets.values), np.asarray(sets.offsets)
    return pa.array([bitmap(flat[a:b], own_bits(b - a)).tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def tile_pairs(rows: list[tuple], percent: int, best: bool = False) -> Iterator[tuple[int, int]]:
    """Pairs of a tile that the bitmaps cannot rule out; for each row all of them, or only that of the most room above the bound.

    rows: class, n, component, own (of the tile's band), side, bitmap.
    """
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    of, n, comp, own, side = (np.array(x) for x in list(zip(*rows, strict=True))[:5])
    raw = [np.frombuffer(r[5], np.uint64) for r in rows]
    words = min(map(len, raw))
    bits = np.stack([fold(x, words) for x in raw])
    crossed = len(set(side.tolist())) > 1
    for i in range(len(rows) - 1):
        end = np.searchsorted(n, 100 * n[i] // percent, side="right")
        j = np.arange(i + 1, end)
        j = j[(comp[j] != comp[i]) & (of[j] != of[i]) & (own[j] | own[i])]
        if crossed:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        most = np.minimum(n[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(1), n[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(1))
        for k in j[most >= need] if not best else j[[np.argmax(most - need)]] if (most >= need).any() else ():
            yield (int(of[i]), int(of[k])) if of[i] > of[k] else (int(of[k]), int(of[i]))


def tiled(percent: int, best: bool):
    """Rows sorted by tile: the pairs of each tile that need the exact check, or the best pair of each row."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1 and (found := list(tile_pairs(rows, percent, best))):
                u, v = zip(*found, strict=True)
                yield frames(u=(u, LONG), v=(v, LONG))

        for batch in batches:
            for *tile, of, n, comp, own, side, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tile != now:
                    yield from done()
                    now, rows = tile, []
                rows.append((of, n, comp, own, side, bits))
        yield from done()

    return stream


def tiles(rows: DataFrame, percent: int, most: int = TILE) -> DataFrame:
    """Deal the rows of groups into size-banded tiles; a tile of too many rows into pairs of blocks.

    A row stands in the tile of its own band and, as the smaller side, in that of the next.
    """
    step = float(np.log(100 / percent))
    band = F.floor(F.log(F.col("n").cast("double")) / step + F.lit(1e-9)).cast("int")
    dealt = rows.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("own", F.col("band") == band)
    size = dealt.groupBy("key", "band").agg(F.count("*").alias("rows"), F.max("own").alias("any"), F.min("component").alias("c1"), F.max("component").alias("c2"))
    size = size.where("any and c1 != c2").select("key", "band", F.ceil(F.col("rows") / most).cast("int").alias("blocks"))
    dealt = dealt.join(size, ["key", "band"]).withColumn("side", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", "band", F.least("side", "other").cast("int").alias("a"), F.greatest("side", "other").cast("int").alias("b"), "class", "n", "component", "own", "side")


def with_component(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Groups that still hold more than one component, with the component of each row.

    Shingles of one passage make many groups of the same classes; one of these groups
    has all their pairs. Two hashes of a group's classes and their number tell it.
    """
    found = components(edges).withColumnRenamed("node", "class")
    rows = groups.join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
    same = [F.count("*").alias("rows"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("y")]
    mixed = rows.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), *same).where("c1 != c2")
    mixed = mixed.groupBy("rows", "x", "y").agg(F.min("key").alias("key")).select("key")
    return scratch.written(rows.join(mixed, "key", "left_semi"))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffle files of steps that are done and written."""
    gc.collect()
    spark._jvm.System.gc()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Component of every whole text under links of Jaccard similarity `percent` / 100 or more.

    Words are runs without white space, A-Z lowered; a set is the distinct shingles of
    k words. Returns one row for each row of docs: the id, n_shingles and component_id,
    the smallest id that links lead to, itself included. A text without words (null,
    empty, blank) has no shingle and no link. A null id takes part and is never a
    component's id unless its component has no other, which is then null. Repeated
    rows are in one component; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    first = scratch.written(texts.mapInArrow(Sets(k, percent).members, f"__id {id_type}, n int, class long, shingle long, texts long"))
    members = first.where(F.col("class").isNotNull()).select("__id", "n", "class")
    least = max(4, members.count() // COMMON_SHARE)
    # at most COMMON_SHARE times the mean size of a set
    common = first.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= least)
    common = np.sort(common.select("shingle").toPandas()["shingle"].to_numpy(np.int64))

    only = texts.select("__text")
    keys = only.mapInArrow(Sets(k, percent, common).keys, "key long, class long, n int")
    keys = keys.repartition("key").sortWithinPartitions("key", "n", "class")
    met = scratch.written(keys.mapInArrow(grouped(percent), GROUPS))
    del keys
    release(spark)
    least = (F.lit(1) + F.floor(F.ceil(F.lit(percent) * F.col("n") / 100) / 10)).alias("least")
    often = met.groupBy("class", "n").agg(F.count("*").alias("groups")).where(F.col("groups") >= least).select("class")
    again = met.join(often, "class", "left_semi").select("key", "class", "n").repartition("key").sortWithinPartitions("key", "n", "class")
    groups = scratch.written(again.mapInArrow(grouped(percent), GROUPS))
    release(spark)

    bloom = bloom_of(groups)
    sets = only.mapInArrow(Sets(k, percent, None, bloom).wanted, "class long, shingles array<long>")
    sets = scratch.written(sets.groupBy("class").agg(F.any_value("shingles").alias("shingles")))
    release(spark)

    # each class with the first of a group that it meets most often
    meets = groups.where("before != class").groupBy("class", "before").agg(F.count("*").alias("n"))
    pairs = meets.groupBy("class").agg(F.max_by("before", F.struct("n", "before")).alias("before"))
    links = [scratch.written(linked(ordered(pairs, "class", "before"), sets, percent))]
    edges, rest, bits = links[0], groups, None
    for best in (True, False):
        rest = with_component(rest.select("key", "class", "n"), edges)
        if bits is None:
            bits = scratch.written(sets.join(rest.select("class").distinct(), "class", "left_semi").select("class", signature("shingles").alias("bits")))
        dealt = tiles(rest, percent).join(bits, "class")
        dealt = dealt.select("key", "band", "a", "b", "class", "n", "component", "own", "side", "bits")
        dealt = dealt.repartition("key", "band", "a", "b").sortWithinPartitions("key", "band", "a", "b")
        pairs = scratch.written(dealt.mapInArrow(tiled(percent, best), "u long, v long").distinct())
        links.append(scratch.written(linked(pairs, sets, percent)))
        edges = edges.union(links[-1])
        release(spark)

    found = components(edges)
    # a class without shingles is not a class: each such text stands alone
    of = members.where("n > 0").join(found.select(F.col("node").alias("class"), "component"), "class", "left")
    of = of.select("__id", "n", F.coalesce("component", "class").alias("component"))
    named = of.groupBy("component").agg(F.min("__id").alias("component_id"))
    alone = members.where("n = 0").select(F.col("__id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("__id").alias("component_id"))
    return of.join(named, "component").select(F.col("__id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id").union(alone)


def ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
