"""Toxicity by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, of neighbouring pairs and
of pairs with one or two words between. The model has one weight for each hash value;
per-coordinate learning rates and L1 regularisation leave few that are not zero,
and those few are what scoring ships to the executors. A feature enters the model
only if enough of the texts learned from have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from creel.llm import arrow

BITS = 24
SAMPLE = 12288
LEAST_TEXTS = 5
THRESHOLD = 0.3
# rates and penalties of the method; L1 is what makes the weights few. These, LEAST_TEXTS and
# POSITIVE were chosen by three folds inside the rows that may be learned from
ALPHA, BETA, L1, L2, EPOCHS = 0.2, 1.0, 16.0, 0.0, 4
# how much more a toxic text counts, being about one in ten
POSITIVE = 2.5
SKIPS = (1, 2, 3)
PUNCTUATION = b".,;:!?\"'()[]{}"


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of every text, and the text that each belongs to; a feature may come twice."""
    data = arrow.LOWER[data]
    plain = data.copy()
    plain[np.isin(plain, np.frombuffer(PUNCTUATION, np.uint8))] = 0x20
    start, end, text = arrow.words(plain, offsets)
    word = arrow.hashes(plain, start, end)
    found, where = [word], [text]
    for k in SKIPS:
        if len(word) > k:
            same = text[k:] == text[:-k]
            found.append(arrow.mix(word[:-k] * np.uint64(2 * k + 1) + np.uint64(k) ^ word[k:])[same])
            where.append(text[k:][same])
    return (np.concatenate(found) & np.uint64((1 << bits) - 1)).astype(np.int64), np.concatenate(where)


def distinct(feature: np.ndarray, text: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((text << bits) | feature)
    return both & ((1 << bits) - 1), both >> bits


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class FTRL:
    """Weights of coordinates and a bias, learned one text at a time."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1, np.float32), np.zeros(size + 1, np.float32)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.maximum(np.abs(z) - np.where(at == len(self.z) - 1, 0, L1), 0)
        return -np.sign(z) * shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = (logistic(w.sum()) - label) * (POSITIVE if label else 1.0)
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, bits: int = BITS) -> dict[str, np.ndarray]:
    """Learn from at most `sample` labelled texts, those with the smallest hashes of their ids.

    The sample is the documented bound: its hashed features, not its texts, go to the
    one task that learns in order. Rows whose label or id is null teach nothing; if
    nothing can be learned every text scores 0, so that none is rejected unseen.
    """
    keyed = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    few = keyed.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col)).cast("int").alias("__label"))
    few = few.orderBy(F.xxhash64(F.col("__id").try_cast("long")), "__id").limit(sample)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(few), "__id")  # few is bounded by sample
    number = F.coalesce(F.col("__id").try_cast("long"), F.xxhash64(F.col("__id").cast("string")))
    rows = rows.select(number.alias("__id"), "__label", "__text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, "__text"):
            feature, text = distinct(*features(*arrow.buffers(batch.column("__text")), bits), bits)
            at = arrow.runs(text, batch.num_rows)
            held = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature.astype(np.int32)))
            yield pa.record_batch([batch.column("__id").cast(pa.int64()), batch.column("__label"), held], names=["id", "label", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        model = FTRL(1 << bits)
        if table is not None:
            label, lists = table["label"].to_numpy(), table["at"].combine_chunks()
            at, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            live = np.bincount(flat, minlength=1 << bits)[flat] >= LEAST_TEXTS
            at = np.concatenate([[0], np.cumsum(live)])[at]
            flat = flat[live]
            order = np.lexsort((table["id"].to_numpy(), arrow.mix(table["id"].to_numpy().astype(np.uint64))))
            for _ in range(EPOCHS):
                for i in order:
                    model.learn(flat[at[i] : at[i + 1]], int(label[i]))
        keep = np.flatnonzero(model.z)
        w = model.weights(keep).astype(np.float64)
        yield pa.record_batch([pa.array(keep[w != 0]), pa.array(w[w != 0])], names=["at", "weight"])

    data = rows.mapInArrow(hashed, "id long, label int, at array<int>").repartition(1)
    found = data.mapInArrow(learn, "at long, weight double").toPandas()
    if not len(found):
        return {"at": np.array([1 << bits]), "weight": np.array([-35.0]), "bits": bits}
    return {"at": found["at"].to_numpy(np.int64), "weight": found["weight"].to_numpy(np.float64), "bits": bits}


def score(text: Column, model: dict, spark) -> Column:
    """Score from 0 to 1 of each whole text; a null or empty text has only the model's bias."""
    shipped = spark.sparkContext.broadcast(model)  # at most 2 ** bits weights

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        held = shipped.value
        size = 1 << held["bits"]
        if "dense" not in held:  # once for each worker
            held["dense"] = np.zeros(size + 1, np.float32)
            held["dense"][held["at"]] = held["weight"]
        weight = held["dense"]
        out = []
        for batch in arrow.slices(iter([pa.record_batch([texts], names=["text"])])):
            data, offsets = arrow.buffers(batch.column("text"))
            feature, owner = features(data, offsets, held["bits"])
            live = weight[feature] != 0
            feature, owner = distinct(feature[live], owner[live], held["bits"])
            out.append(logistic(np.bincount(owner, weight[feature], len(offsets) - 1) + weight[size]))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return scored(text)


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return labels.where(F.crc32(F.col(id_col).cast("string")) % 4 != 2)


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score and verdict of every whole text.

    Returns one row for each row of docs: the id, held_out (never learned from),
    score and predicted (1 from the threshold on). A null id is not held out;
    repeated rows are scored each; an empty table gives no rows; columns of docs
    other than id and text are never looked at.
    """
    model = fit(docs, training_labels(labels, id_col), label_col, id_col, text_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    scored = docs.select(F.col(id_col), held.alias("held_out"), score(F.col(text_col), model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
