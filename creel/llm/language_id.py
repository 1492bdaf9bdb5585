"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams (one to three characters, words
bounded by blanks) of a language in falling order. The out-of-place distance of a
document adds, over its own most frequent n-grams, how far each stands from its
place in the profile; an n-gram that is not there counts as the profile's length.
The nearest profile is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from creel.llm import arrow

PROFILE = 400
UNKNOWN = "und"
BLANK = 0x20
MERGE_ROWS = 1 << 22
MAX_LANGUAGES = 4096

_WIDE = 21  # bits of a code point


def _folding() -> np.ndarray:
    """Lower case of every letter; any other character is a blank."""
    fold = np.full(0x110000, BLANK, np.int64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            fold[c] = ord(low) if len(low) == 1 else c
    return fold


_FOLD: list[np.ndarray] = []


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the one-, two- and three-character n-grams from every place on, 0 for none; the place of each text.

    Each text stands between blanks, its neighbours sharing one; several blanks are one.
    """
    if not _FOLD:
        _FOLD.append(_folding())
    data, offsets = arrow.buffers(texts)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = lead[offsets]  # of each text, in characters
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    c = np.full(len(chars) + len(at), BLANK, np.int64)
    sizes = np.diff(at)
    c[np.arange(len(chars)) + np.repeat(np.arange(1, len(at)), sizes)] = _FOLD[0][chars]
    at = at + np.arange(len(at))
    keep = c != BLANK
    keep[1:] |= keep[:-1]
    keep[at] = True  # the blanks between texts
    keep[at[1:] - 1] &= c[at[1:] - 1] != BLANK  # and none before them
    keep[at] = True
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    c = c[keep]
    c = np.append(c, [BLANK, BLANK])
    two = (c[:-2] << _WIDE) | c[1:-1]
    three = (two << _WIDE) | c[2:]
    solid = c[:-2] != BLANK
    inner = c[1:-1] != BLANK
    return np.where(solid, c[:-2], 0), np.where(solid | inner, two, 0), np.where(inner, three, 0), at


def counted_grams(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(np.concatenate(parts), return_counts=True)
    return (found[1:], n[1:]) if len(found) and found[0] == 0 else (found, n)


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """The `size` most frequent n-grams of every language over all rows: lang, gram, place from 0.

    Tasks add up the counts of what they have read before anything is shuffled. Of
    equally frequent n-grams the smaller number comes first. Rows without text or
    language teach nothing.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        waiting = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            gram, at = np.unique(gram, return_inverse=True)
            return gram, np.bincount(at, n).astype(np.int64)

        for batch in arrow.slices(batches, "__text"):
            langs = batch.column("__lang")
            for lang in langs.unique().to_pylist():
                one, two, three, _ = grams(batch.filter(pc.equal(langs, lang)).column("__text"))
                held.setdefault(lang, []).append(found := counted_grams([one, two, three]))
                waiting += len(found[0])
            if waiting > MERGE_ROWS:
                held = {k: [merged(v)] for k, v in held.items()}
                waiting = sum(len(v[0][0]) for v in held.values())
                if waiting > MERGE_ROWS // 2:
                    for lang, parts in held.items():
                        gram, n = parts[0]
                        yield pa.record_batch([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], names=["__lang", "gram", "n"])
                    held, waiting = {}, 0
        for lang, parts in held.items():
            gram, n = merged(parts)
            yield pa.record_batch([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], names=["__lang", "gram", "n"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("__text"))
    total = rows.mapInArrow(counted, "__lang string, gram long, n long").groupBy("__lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("__lang").orderBy(F.desc("n"), "gram"))
    # a limit on the row number itself lets every task keep its own first rows only
    first = total.withColumn("place", place).where(F.col("place") <= size)
    return first.select(F.col("__lang").alias("lang"), "gram", (F.col("place") - 1).alias("place"))


class Profiles:
    """Profiles of all languages as one table of places."""

    def __init__(self, lang: list[str], gram: np.ndarray, place: np.ndarray, size: int):
        self.langs = sorted(set(lang))
        number = {x: i for i, x in enumerate(self.langs)}
        self.size = size
        self.gram = np.unique(gram)
        self.place = np.full((len(self.gram) + 1, len(self.langs)), -1, np.int32)  # the last row: in no profile
        self.place[np.searchsorted(self.gram, gram), [number[x] for x in lang]] = place

    def nearest(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: how much nearer its profile is than the farthest that could be."""
        *kinds, at = grams(texts)
        langs, scores = [], np.zeros(len(texts))
        for a, b in zip(at, at[1:], strict=False):
            found, n = counted_grams([x[a:b] for x in kinds])
            if not len(found) or not self.langs:
                langs.append(UNKNOWN)
                continue
            top = np.argsort((-n).astype(np.int16) if n.max() < 1 << 15 else -n, kind="stable")[: self.size]
            found = found[top]
            k = np.minimum(np.searchsorted(self.gram, found), len(self.gram) - 1)
            k[self.gram[k] != found] = len(self.gram)
            place = self.place[k]
            apart = np.where(place < 0, self.size, np.abs(place - np.arange(len(found))[:, None])).sum(0)
            best = int(apart.argmin())
            langs.append(self.langs[best])
            scores[len(langs) - 1] = 1 - apart[best] / (self.size * len(found))
        return langs, np.clip(scores, 0, 1)


def language_id(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """Language of every whole text, learned from rows whose crc32 of the id as text modulo 5 is not 0.

    Returns one row for each row of docs: the id, held_out (never learned from),
    lang_pred and score. A null text, an empty one or one without a letter is `und`
    with score 0, and so is every text if there is nothing to learn from. Of equally
    near languages the first by name is taken. A row with a null id is not learned
    from. Repeated rows are judged each; an empty table gives no rows; other columns
    are ignored. The profiles are shipped whole: at most `size` n-grams for each
    language, and no more than MAX_LANGUAGES languages.
    """
    bucket = F.crc32(F.col(id_col).cast("string")) % 5
    learned = profiles(docs.where(bucket != 0), lang_col, text_col, size)
    rows = learned.limit(size * MAX_LANGUAGES + 1).toPandas()
    if len(rows) > size * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is {lang_col} a language?")
    model = Profiles(list(rows["lang"]), rows["gram"].to_numpy(np.int64), rows["place"].to_numpy(np.int64), size)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, "__text"):
            langs, scores = shipped.value.nearest(batch.column("__text"))
            yield pa.record_batch([batch.column("__id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)], names=["__id", "held_out", "lang_pred", "score"])

    given = docs.select(F.col(id_col).alias("__id"), F.coalesce(bucket == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("__text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return given.mapInArrow(judged, f"__id {id_type}, held_out boolean, lang_pred string, score double").withColumnRenamed("__id", id_col)
