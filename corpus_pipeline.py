"""A training-data pipeline: quality rules, toxicity, near duplicates, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from creel.llm import decontaminate, jaccard_join, packing, quality_rules, scratch, toxicity
from creel.llm.queries import table, tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns, whatever these are called.

    Null, empty and short texts go, repeated rows are judged alike, a null language or
    source is a group of its own, and an empty table stays empty.
    """
    return quality_rules.judged(docs).where("kept").select("row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. It learns from the documents that are left.

    A null or empty text has only the model's bias, so it stays. A row with a null id is
    judged, but not learned from. Repeated rows are judged alike.
    """
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")), "toxic")
    return docs.where(toxicity.score(F.col("text"), model, spark) < toxicity.THRESHOLD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id, any one of equal ids; a null id comes last.

    Rows are told by a key that is written with them, so null and repeated ids do not
    matter, and a document's columns travel as one, so their names do not either. Texts
    without words are no duplicates of each other and stay.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = scratch.written(docs.select(own.alias("doc"), F.monotonically_increasing_id().alias("key")))
    found = jaccard_join.near_duplicates(keyed.select("key", F.col("doc.text").alias("text")), "key").select("key", "component_id")
    rows = found.join(keyed.select("key", F.col("doc.doc_id").alias("id")), "key")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    first = rows.groupBy("component_id").agg(F.min(order).alias("least")).select("least.key")
    others = found.select("key").join(first, "key", "left_anti")
    return keyed.join(others, "key", "left_anti").select("doc.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts have none, repeated rows are judged alike."""
    return docs.where(~decontaminate.contaminated(F.col("text"), table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in token windows; see `packing.pack` for null, empty and repeated rows."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), 2)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("toxicity", clean),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]
#: Thresholds from sketches, a learned model and tokenizer ids cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
