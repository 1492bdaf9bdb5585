"""Row numbers, binding by position and running minima of an ordered table, without one task for all rows.

Rows are dealt to tasks by ranges of the order. Each range is summed up in one row, the
summaries of the ranges before are carried in, and the rest happens within the range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from creel.sources.tables import materialise

RANGE = "__range"


def ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows written in ranges of the order, with the number of their range and of the row within it.

    Missing values come first. Rows that agree in ``order`` are ordered by their other
    columns, so a value that a large share of the rows hold is split over ranges as
    well; only rows that are equal throughout stay together.
    """
    by = [*order, *[c for c in df.columns if c not in order]]
    cut = df.repartitionByRange(*by).sortWithinPartitions(*by)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialise(cut.select("*", F.spark_partition_id().alias(RANGE), within.alias("__place")))


def carried_in(rows: DataFrame, **sums) -> DataFrame:
    """Add to every row a value over all ranges before its own, missing in the first.

    ``sums`` names each new column and gives the aggregate of one range and the
    aggregate that puts ranges together. There is one row for each range, so a window
    over them and their broadcast are bounded by the number of tasks that wrote them.
    """
    each = rows.groupBy(RANGE).agg(*[own.alias(name) for name, (own, _) in sums.items()])
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(RANGE, *[together(name).over(before).alias(name) for name, (_, together) in sums.items()])
    return rows.join(F.broadcast(each), RANGE)


def numbered(df: DataFrame, order: Sequence[str], name: str = "rang_ligne") -> DataFrame:
    """Row numbers 0, 1, 2, ... in the stated order."""
    rows = carried_in(ranged(df, order), __offset=(F.count(F.lit(1)), F.sum))
    return rows.select(*df.columns, (F.coalesce("__offset", F.lit(0)) + F.col("__place")).alias(name))


def bind_by_position(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Columns of both tables side by side: first row with first row, each in its stated order.

    Binding rows of tables of different length is an error; it is raised when the rows are read.
    """
    both = set(left.columns) & set(right.columns)
    if both:
        raise ValueError(f"both tables have {sorted(both)}")
    a, b = numbered(left, left_order, "__row"), numbered(right, right_order, "__other")
    paired = a.join(b, F.col("__row") == F.col("__other"), "full")
    gap = F.raise_error(F.lit("the tables to bind differ in length"))
    checked = paired.where(F.when(F.col("__row").isNull() | F.col("__other").isNull(), gap.cast("boolean")).otherwise(True))
    return checked.select(*left.columns, *right.columns)
