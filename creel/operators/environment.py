"""Environment variables per place: means, transforms, distributions, exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from creel.functions import scalars as S
from creel.operators.quantiles import exact_quantiles


def point_means(df: DataFrame, key: str, variables: Sequence[str], zero_is_missing: Sequence[str]) -> DataFrame:
    """Mean of each variable per place, zeros of the listed variables being missing.

    One grouped aggregation over the wide table; the long form would multiply the
    rows by the number of variables first. A place left without any value is dropped.
    """
    value = {v: S.null_if(F.col(v).cast("double"), 0.0) if v in zero_is_missing else F.col(v).cast("double") for v in variables}
    if set(variables) <= set(zero_is_missing):
        df = df.where(F.coalesce(*value.values()).isNotNull())
    return df.groupBy(key).agg(*[F.avg(c).alias(v) for v, c in value.items()])


def transform(
    df: DataFrame,
    *,
    log: Sequence[str] = (),
    log1p: Sequence[str] = (),
    log10: Sequence[str] = (),
    log1p10: Sequence[str] = (),
    arcsine: Sequence[str] = (),
    missing_below: dict[str, float] | None = None,
    missing_zero: Sequence[str] = (),
) -> DataFrame:
    """Listed transforms in one projection. The log of a value at or below zero is missing."""
    new: dict[str, Column] = {}
    for cols, f in (
        (log, F.ln),
        (log1p, F.log1p),
        (log10, F.log10),
        (log1p10, S.log1p10),
        (arcsine, S.arcsine_share),
    ):
        for c in cols:
            new[c] = f(F.col(c))
    for c, bound in (missing_below or {}).items():
        new[c] = S.null_below(new.get(c, F.col(c)), bound)
    for c in missing_zero:
        new[c] = S.null_if(new.get(c, F.col(c)), 0.0)
    return df.withColumns(new)


# -- distributions -----------------------------------------------------------------


def histogram(df: DataFrame, variables: Sequence[str], bins: int = 30, log_axis: bool = False) -> DataFrame:
    """Counts in equal-width bins from minimum to maximum, per variable; the last bin is closed.

    With ``log_axis`` bins are equal on a log10 scale and values at or below zero
    are left out. Empty bins give no row.
    """
    long = df.select(*[F.col(v).cast("double").alias(v) for v in variables]).unpivot([], list(variables), "variable", "value")
    if log_axis:
        long = long.withColumn("value", F.log10("value"))
    long = long.where(F.col("value").isNotNull())
    # at most one row per listed variable
    range_ = long.groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    tagged = long.join(F.broadcast(range_), "variable")
    bucket = F.when(F.col("lo") == F.col("hi"), F.lit(1).cast("bigint")).otherwise(
        F.least(F.width_bucket("value", "lo", "hi", F.lit(bins)), F.lit(bins).cast("bigint"))
    )
    counts = tagged.groupBy("variable", bucket.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counts.select("variable", "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_start"), "n")


def bar_counts(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Rows per category, per variable."""
    long = df.select(*[F.col(v).cast("string").alias(v) for v in variables]).unpivot([], list(variables), "variable", "value")
    return long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))


def five_numbers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Minimum, quartiles and maximum by group (the numbers under a box plot)."""
    q = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75])
    return q.select(
        *keys, "n", "mini", F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3"), "maxi"
    )


def summary_stats(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Minimum, median and maximum per variable, zero being missing."""
    long = df.select(*[S.null_if(F.col(v).cast("double"), 0.0).alias(v) for v in variables]).unpivot(
        [], list(variables), "variable", "valeur"
    )
    q = exact_quantiles(long, ["variable"], "valeur", [0.5])
    return q.select("variable", "mini", F.col("q")[0].alias("med"), "maxi")
