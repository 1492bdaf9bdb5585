"""Filter interaction audit: what each filter removes, and what it would have removed, in every order.

Conditions on a text give each document a bit for every filter that it fails. Copies
are found by an existential self-join: a left-semi join on a hash, the exact text and
a smaller id. Its ids are united with those of the other failures, the bits of each
document are put together, and only the counts of bit combinations, at most 2 ** k for
each part, are looked at for the k! orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from creel.llm import scratch

COPIES = "E"
SPACES = "[\\x20\\x09-\\x0D]+"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SIGNS = 200, 50, 3, "[#$%&*|]"
#: A hash holding at least one in so many rows is hot (so there are no more than so many); its rows go to so many tasks.
HOT_SHARE, SALTS = 1024, 64


def conditions(text: Column, words: Column) -> dict[str, Column]:
    """Failures of one text, told from itself alone. A text without words fails for its length only."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n,
        "C": 100 * capitals > MAX_CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(SIGNS),
    }


def copies(rows: DataFrame, measured: DataFrame) -> DataFrame:
    """Rows (id, part, hash) whose exact text a row with a smaller id holds.

    The right side has one row for each text that occurs twice, made by partial
    aggregation. Rows of hot hashes are dealt over SALTS tasks; the hot hashes, at most
    HOT_SHARE numbers, come from the counts of the hashes.
    """
    sizes = measured.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    hot = F.broadcast(sizes.where(F.col("n") * HOT_SHARE >= total).select(F.col("hash").alias("__hot")))
    firsts = rows.groupBy("hash", "text").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.join(hot, F.col("hash") == F.col("__hot"), "left")
    salts = F.sequence(F.lit(0), F.when(F.col("__hot").isNull(), 0).otherwise(SALTS - 1))
    firsts = firsts.select(F.col("hash").alias("__h"), F.col("text").alias("__t"), "first", F.explode(salts).alias("__s"))
    salt = F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    later = rows.join(hot, F.col("hash") == F.col("__hot"), "left").withColumn("salt", salt.cast("int")).drop("__hot")
    same = (F.col("hash") == F.col("__h")) & (F.col("text") == F.col("__t")) & (F.col("salt") == F.col("__s")) & (F.col("first") < F.col("id"))
    return later.join(firsts, same, "left_semi").select("id", "part", "hash")


def combinations(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Counts of every part and bit combination: part, failed (bit i: the i-th filter), n, good, toxic."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    split = rows.withColumn("words", F.filter(F.split("text", SPACES, -1), lambda w: w != ""))
    found = conditions(F.col("text"), F.col("words"))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(found.values())), F.lit(0))
    measured = scratch.written(split.select("id", "part", "hash", bits.cast("int").alias("failed")))
    again = copies(rows, measured).select("id", "part", "hash", F.lit(1 << len(found)).alias("failed"), F.lit(0).alias("n"))
    # rows of one id, part and text have equal bits, so they stay one row that counts for several
    each = measured.withColumn("n", F.lit(1)).unionByName(again).groupBy("id", "part", "hash").agg(F.bit_or("failed").alias("failed"), F.sum("n").alias("n"))
    is_one = lambda c: F.max((F.col(c) == 1).cast("int"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    counted = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return each.join(marks, "id", "left").groupBy("part", "failed").agg(F.sum("n").alias("n"), counted("good"), counted("toxic"))


def in_orders(counts: DataFrame, letters: str) -> DataFrame:
    """What every filter does at its step of every order, from the counts of bit combinations."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    bit = lambda at: F.expr(f"shiftleft(1, instr('{letters}', substring(filter_order, {at}, 1)) - 1)")
    rows = counts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    before = F.expr(f"aggregate(slice(sequence(1, {len(letters)}), 1, step - 1), 0, (b, i) -> b | shiftleft(1, instr('{letters}', substring(filter_order, i, 1)) - 1))")
    rows = rows.withColumn("own", bit("step")).withColumn("before", before)
    fails = F.col("failed").bitwiseAND(F.col("own")) > 0
    gone = F.col("failed").bitwiseAND(F.col("before")) > 0
    total = lambda when, value: F.sum(F.when(when, F.col(value)).otherwise(0)).cast("long")
    # a document that fails k filters is removed by each of them in one k-th of the orders
    share = F.when(fails, F.col("n") * F.expr(f"{factorial(len(letters))} div greatest(bit_count(failed), 1)")).otherwise(0)
    return rows.groupBy("part", "filter_order", F.col("step").cast("int").alias("step")).agg(
        total(~fails & ~gone, "n").alias("kept"),
        total(fails & ~gone, "n").alias("removed"),
        total(fails & gone, "n").alias("redundant"),
        total(F.col("failed") == F.col("own"), "n").alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(share).cast("long").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters A to E and step: see the contract's columns.

    A null text is empty, so it is a copy of other empty texts; a null part is the empty
    string. Rows with a null id are counted, but are never copies, nor is anything a copy
    of them, and they have no label. Rows that are repeated count each; rows of equal id
    are not smaller than each other. Of several labels of an id one with a 1 is enough.
    An empty table gives no rows. Columns other than those named are ignored.
    """
    return in_orders(combinations(docs, labels, id_col, text_col, part_col), "ABCD" + COPIES)


#: The same in DuckDB's SQL, for tables without repeated ids.
SQL = """
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
failing AS (
  SELECT doc_id, part,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS failed
  FROM words),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, failed),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM l a JOIN l b ON b.f <> a.f JOIN l c ON c.f NOT IN (a.f, b.f) JOIN l d ON d.f NOT IN (a.f, b.f, c.f)
  JOIN l e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier
  FROM orders, range(1, 6) r(step)),
each AS (SELECT *, (failed & own) > 0 AS fails, (failed & earlier) > 0 AS gone FROM counts, steps)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(failed), 1)) FILTER (fails), 0)::BIGINT AS shapley
FROM each GROUP BY part, filter_order, step
"""
