"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

The counts of trusted texts are a table of (context, character): four-grams as they
are, shorter ones by the number of different characters before them. Discounts,
context weights and probabilities are aggregations and joins of that table.

Texts are scored by joins too. They are packed, where they are read, into compressed
blocks of bounded size, and each block lists the different (context, character) pairs
in it, a few for a thousand characters. The pairs of all blocks are looked up in the
probabilities by key, backing off order by order, and the answers meet their block by
its number. Which texts are trusted is told by joining the ids listed with each piece;
the pieces are counted where they lie. No model, shard or text passes through the driver,
the model may have any size, and each text is moved once, compressed, or twice where
the marks of the trusted are too many for Spark to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from creel.llm import arrow, scratch

ORDER = 4
QUANTILE = 0.99
HELD_OUT = 10
PRIOR = 200
SLICE, PIECE, BLOCK, LEVEL = 1 << 20, 1 << 23, 1 << 25, 6
UNKNOWN = -20.0
START, BREAK = 2, 0x20

_WIDE = 21
_MASK = [(1 << _WIDE * k) - 1 for k in range(4)]


def places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context of three characters, character and text of every place; runs of white space are one blank, a text begins with starts."""
    data, offsets = arrow.buffers(texts)
    lead = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[offsets]
    c = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    c[(c >= 9) & (c <= 13)] = BREAK
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != BREAK) | (c[:-1] != BREAK) | (text[1:] != text[:-1])
    c, text = c[keep], text[keep]

    def back(k: int) -> np.ndarray:
        out = np.full(len(c), START, np.int64)
        if len(c) > k:
            out[k:] = np.where(text[k:] == text[:-k], c[:-k], START)
        return out

    return (back(3) << 2 * _WIDE) | (back(2) << _WIDE) | back(1), c, text


def pairs(context: np.ndarray, char: np.ndarray, often: bool = False) -> tuple[np.ndarray, ...]:
    """The different pairs of context and character, sorted; and the pair of each place, or how often each pair occurs."""
    known = np.zeros(0x110000, bool)
    known[char], known[START] = True, True
    alphabet = np.flatnonzero(known)
    bits = int(len(alphabet) - 1).bit_length()
    if 4 * bits <= 64:  # few characters: a pair is one number, which sorts as the pair does
        rank = np.zeros(0x110000, np.uint64)
        rank[alphabet] = np.arange(len(alphabet))
        number = rank[char]
        for k in (1, 2, 3):
            number |= rank[(context >> _WIDE * (k - 1)) & _MASK[1]] << np.uint64(bits * k)
        order = np.sort(number)
        new = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.zeros(0, np.int64)
        found = order[new]
        part = [alphabet[((found >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1)).astype(np.int64)] for k in range(4)]
        c, w = (part[3] << 2 * _WIDE) | (part[2] << _WIDE) | part[1], part[0]
        return (c, w, np.diff(np.append(new, len(order)))) if often else (c, w, np.searchsorted(found, number))
    order = np.lexsort((char, context))
    c, w = context[order], char[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])]) if len(c) else np.zeros(0, bool)
    if often:
        return c[new], w[new], np.diff(np.append(np.flatnonzero(new), len(c)))
    which = np.empty(len(c), np.int64)
    which[order] = np.cumsum(new) - 1
    return c[new], w[new], which


def counts(texts: DataFrame) -> DataFrame:
    """How often each character follows each context of three, over all texts; every task adds up its slices first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, "__text", SLICE):
            context, char, _ = places(batch.column("__text"))
            context, char, often = pairs(context, char, often=True)
            yield pa.record_batch([pa.array(context), pa.array(char), pa.array(often)], names=["h", "w", "c"])

    return texts.mapInArrow(counted, "h long, w long, c long").groupBy("h", "w").agg(F.sum("c").alias("c"))


def counts_in(pieces: DataFrame, trusted: DataFrame, key: str, out: str) -> DataFrame:
    """The same counts of the texts in packed pieces that a row of `trusted` names by `key` and that are not `out`.

    Only keys are joined: they give each piece the places of its trusted rows. A
    repeated key marks all its rows, once each, a null key none.
    """
    listed = pieces.select("block", "piece", F.posexplode("keys").alias("at", key))
    marks = scratch.written(listed.join(trusted, key, "left_semi").groupBy("block", "piece").agg(F.collect_list("at").alias("marks")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, at in zip(batch.column("rows"), batch.column("marks")):
                own = (rows.take(at.values) for rows in pa.ipc.open_stream(blob.as_buffer()))
                for rows in arrow.slices(own, "__text", SLICE):
                    context, char, _ = places(rows.column("__text").filter(pc.invert(rows.column(out))))
                    context, char, often = pairs(context, char, often=True)
                    yield pa.record_batch([pa.array(context), pa.array(char), pa.array(often)], names=["h", "w", "c"])

    marked = pieces.select("block", "piece", "rows").join(marks, ["block", "piece"]).select("rows", "marks")
    return marked.mapInArrow(counted, "h long, w long, c long").groupBy("h", "w").agg(F.sum("c").alias("c"))


def discounts(table: DataFrame) -> list[float]:
    """D1, D2 and D3+ from the numbers of n-grams that occur once to four times."""
    r = table.where("c <= 4").groupBy("c").count().collect()
    n = {int(x["c"]): x["count"] for x in r}
    n1, n2, n3, n4 = (max(n.get(k, 0), 1) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def model(texts: DataFrame) -> DataFrame:
    """Probabilities and context weights of all orders, from the counts of texts."""
    return probabilities(counts(texts))


def probabilities(four: DataFrame) -> DataFrame:
    """Probabilities and context weights of all orders: n, h, w (-1 for a context's weight), value, from the counts of four-grams.

    n is the length of the context. Order 0 has the single characters, and with
    w = -1 the probability of a character never seen.
    """
    tables = [None] * ORDER
    tables[ORDER - 1] = scratch.written(four)
    for k in range(ORDER - 2, -1, -1):
        tables[k] = tables[k + 1].groupBy(F.col("h").bitwiseAND(F.lit(_MASK[k])).alias("h"), "w").agg(F.count("*").alias("c"))
    out, lower = None, None
    for k, table in enumerate(tables):
        d = discounts(table)
        ctx = table.groupBy("h").agg(F.sum("c").alias("total"), *[F.count(F.when(F.col("c") == i if i < 3 else F.col("c") >= 3, 1)).alias(f"n{i}") for i in (1, 2, 3)])
        ctx = ctx.select("h", "total", ((d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")) / F.col("total")).alias("weight"))
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        own = table.join(ctx, "h").withColumn("own", (F.col("c") - off) / F.col("total"))
        if k == 0:
            kinds = (table.count() or 0) + 1  # one more for any character never seen
            seen = own.select("h", "w", (F.col("own") + F.col("weight") / kinds).alias("p"))
            ctx = ctx.withColumn("weight", F.col("weight") / kinds)
        else:
            short = lower.select(F.col("h").alias("__h"), F.col("w").alias("__w"), F.col("p").alias("__p"))
            same = (F.col("h").bitwiseAND(F.lit(_MASK[k - 1])) == F.col("__h")) & (F.col("w") == F.col("__w"))
            seen = own.join(short, same).select("h", "w", (F.col("own") + F.col("weight") * F.col("__p")).alias("p"))
        lower = seen = scratch.written(seen)
        rows = seen.select(F.lit(k).alias("n"), "h", "w", F.col("p").alias("value")).union(ctx.select(F.lit(k), "h", F.lit(-1).cast("long"), "weight"))
        out = rows if out is None else out.union(rows)
    return scratch.written(out)


def resolved(asked: DataFrame, table: DataFrame) -> DataFrame:
    """Logarithm of the probability of each of the different pairs h, w asked for: h, w, log.

    A pair that a model's order has not seen has the weight of its context, if that was
    seen, times the probability after the context without its first character.
    """
    log = F.ln(F.greatest(F.col("value"), F.lit(1e-300)))
    levels = [asked.select("h", "w")]
    for k in range(ORDER - 2, -1, -1):
        levels.insert(0, levels[0].select(F.col("h").bitwiseAND(F.lit(_MASK[k])).alias("h"), "w").distinct())
    lower = None
    for k, level in enumerate(levels):
        own = table.where(F.col("n") == k)
        seen = own.where("w >= 0").select("h", "w", log.alias("seen"))
        weight = own.where("w < 0").select("h", log.alias("weight"))
        out = level.join(seen, ["h", "w"], "left").join(weight, "h", "left")
        if k == 0:
            rest = F.coalesce("weight", F.lit(UNKNOWN))
        else:
            short = F.col("h").bitwiseAND(F.lit(_MASK[k - 1]))
            out = out.join(lower, (short == F.col("__h")) & (F.col("w") == F.col("__w")), "left")
            rest = F.coalesce("weight", F.lit(0.0)) + F.col("__log")
        out = out.select("h", "w", F.coalesce("seen", rest).alias("log"))
        lower = out.toDF("__h", "__w", "__log")
    return out


def packed(docs: DataFrame, most: int = BLOCK, key: str | None = None, alike: str | None = None) -> DataFrame:
    """Texts in compressed pieces of blocks of about `most` bytes, and each block's different pairs.

    A row is either a piece (block, piece, rows, and with `key` that column's values as
    keys) or a block's pairs (block, h, w). A text above the size is a block of its own.
    Pieces are compressed whole and gone through by slices; texts alike in the column
    `alike`, like their language, lie side by side in a piece, where they compress better.
    """
    kind = T.ArrayType(docs.schema[key].dataType if key else T.LongType())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        size, found, number = 0, [], 0

        def listed() -> pa.RecordBatch:
            h, w, _ = pairs(*(np.concatenate(c) for c in zip(*found)), often=True)
            return row(None, h, w)

        def row(rows, h=None, w=None, keys=None) -> pa.RecordBatch:
            own = pa.array([None], to_arrow_type(kind)) if keys is None else pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            cells = [pa.array([block], pa.int64()), pa.array([number], pa.int32()), pa.array([rows], pa.binary()), own, pa.array([h], pa.list_(pa.int64())), pa.array([w], pa.list_(pa.int64()))]
            return pa.record_batch(cells, names=["block", "piece", "rows", "keys", "h", "w"])

        for piece in arrow.slices(batches, "__text", min(PIECE, most)):
            own = len(arrow.buffers(piece.column("__text"))[0])
            if found and size + own > most:
                yield listed()
                block, size, found = block + 1, 0, []
            size += own
            if alike:
                piece = piece.take(pc.sort_indices(piece, sort_keys=[(alike, "ascending")]))
            for part in arrow.slices([piece], "__text", SLICE):
                context, char, _ = places(part.column("__text"))
                found.append(pairs(context, char, often=True)[:2])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as stream:
                stream.write_batch(piece)
            yield row(sink.getvalue().to_pybytes(), keys=piece.column(key) if key else None)
            number += 1
        if found:
            yield listed()

    cells = [("block", T.LongType()), ("piece", T.IntegerType()), ("rows", T.BinaryType()), ("keys", kind), ("h", T.ArrayType(T.LongType())), ("w", T.ArrayType(T.LongType()))]
    return docs.mapInArrow(pack, T.StructType([T.StructField(*c) for c in cells]))


def scores(docs: DataFrame, table: DataFrame, most: int = BLOCK) -> DataFrame:
    """The rows of docs without their `__text`, with the sum of logarithms, logs, and the number of places, chars."""
    return block_scores(scratch.written(packed(docs, most)), docs.schema, table)


def block_scores(blocks: DataFrame, packed_as: T.StructType, table: DataFrame) -> DataFrame:
    """The scores of the rows in packed blocks; `packed_as` is the schema of the rows."""
    kept = [f for f in packed_as.fields if f.name != "__text"]
    asked = blocks.where("h IS NOT NULL").select("block", F.inline(F.arrays_zip("h", "w")))
    answers = asked.join(resolved(scratch.written(asked.select("h", "w").distinct()), table), ["h", "w"]).select(F.col("block").alias("of"), "h", "w", "log")

    def scored(pieces: pa.Table, known: pa.Table) -> pa.Table:
        h, w, log = (known.column(c).to_numpy() for c in ("h", "w", "log"))
        contexts = np.unique(h)
        key = (np.searchsorted(contexts, h) << _WIDE) | w
        order = np.argsort(key)
        key, log = key[order], log[order]
        out = []
        for blob in pieces.column("rows"):
            for batch in arrow.slices(pa.ipc.open_stream(blob.as_buffer()), "__text", SLICE):
                context, char, text = places(batch.column("__text"))
                context, char, which = pairs(context, char)
                at = np.searchsorted(key, (np.searchsorted(contexts, context) << _WIDE) | char)
                n = batch.num_rows
                logs = np.bincount(text, log[at][which], n).astype(np.float64)
                cells = [batch.column(f.name) for f in kept] + [pa.array(logs), pa.array(np.bincount(text, minlength=n))]
                out.append(pa.record_batch(cells, names=[*(f.name for f in kept), "logs", "chars"]))
        return pa.Table.from_batches(out)

    schema = T.StructType([*kept, T.StructField("logs", T.DoubleType()), T.StructField("chars", T.LongType())])
    pieces = blocks.where("rows IS NOT NULL").select("block", "rows")
    return pieces.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(scored, schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """Perplexity and verdict of every whole text.

    Trusted are the texts that a label of 1 marks. A tenth of them, told by the text,
    is left out of the counts; what is usual in a language is learned from that tenth.
    Returns one row for each row of docs: the id, n_places, perplexity (per character)
    and kept. A text is kept unless its mean logarithm, drawn to the language's usual
    value if the text is short, lies beyond the language's quantile over the texts left
    out. A language without such texts, and every language if nothing is trusted, keeps
    its texts. A null or empty text has no place, a null perplexity and is kept. A null
    language is a language; a null id is never trusted; repeated rows are judged each;
    an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.col(lang_col).alias("__lang"))
    own = own.withColumn("__out", F.pmod(F.xxhash64("__text"), F.lit(HELD_OUT)) == 0)
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("__id")).distinct()
    blocks = scratch.written(packed(own, key="__id", alike="__lang"))
    table = probabilities(counts_in(blocks.where("rows IS NOT NULL"), trusted, "__id", "__out"))
    rows = block_scores(blocks, own.schema, table).join(trusted.withColumn("__trusted", F.lit(True)), "__id", "left")
    rows = scratch.written(rows.select("__id", "__lang", "logs", "chars", (F.coalesce("__trusted", F.lit(False)) & F.col("__out") & (F.col("chars") > 0)).alias("__usual")))
    usual = rows.where("__usual").groupBy(F.col("__lang").alias("__l")).agg((-F.sum("logs") / F.sum("chars")).alias("__mean"))
    both = rows.join(usual, F.col("__lang").eqNullSafe(F.col("__l")), "left").drop("__l")
    loss = (-F.col("logs") + PRIOR * F.col("__mean")) / (F.col("chars") + PRIOR)
    both = both.withColumn("__loss", loss)
    limit = both.where("__usual").groupBy(F.col("__lang").alias("__l")).agg(F.percentile_approx("__loss", quantile, 10000).alias("__limit"))
    out = both.join(limit, F.col("__lang").eqNullSafe(F.col("__l")), "left")
    perplexity = F.when(F.col("chars") > 0, F.exp(-F.col("logs") / F.col("chars")))
    return out.select(F.col("__id").alias(id_col), F.col("chars").alias("n_places"), perplexity.alias("perplexity"), F.coalesce((F.col("chars") == 0) | (F.col("__loss") <= F.col("__limit")), F.lit(True)).alias("kept"))
