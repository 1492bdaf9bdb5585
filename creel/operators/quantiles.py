"""Exact quantiles by counted refinement.

The rows are counted by a whole number that grows with the value, the logarithm in 1024
parts, and the bin that holds a rank is found from the counts. Only values in that bin
are counted by their distance from its least value, in units of their last binary digit,
and the rank is followed down to a single value, first among wide steps of that
distance, then within one. Nothing is estimated, so a rank is never missed, and whatever
a group's size no step orders more than 2 ** 23 counts of it (a few thousand for values
of usual spread).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from creel.sources.tables import materialise

_PARTS = 1024  # bins of a doubling of the value
_STEPS = (22, 0)  # binary digits of the second number, of 45, that are left open by each of its steps


def coarse_number(x: Column) -> Column:
    """A whole number that never falls as a double grows, and holds values of a ratio near one together.

    Zero, the infinite values and NaN have numbers of their own.
    """
    size = F.abs(x)
    special = F.when(size == 0, 0).when(F.isnan(x), 2200 * _PARTS).when(size == float("inf"), 2100 * _PARTS)
    number = F.coalesce(special.cast("long"), F.floor(F.log2(size) * _PARTS) + 1076 * _PARTS)
    return F.when((x < 0) & ~F.isnan(x), -number).otherwise(number)


def last_digit(least: Column, most: Column) -> Column:
    """A power of two that divides the distance of any two values between these, of one sign and a ratio near one."""
    exponent = F.floor(F.log2(F.least(F.abs(least), F.abs(most)))) - 53
    return F.greatest(F.pow(F.lit(2.0), exponent.cast("double")), F.lit(5e-324))


def _count(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy("g", *by).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))


def _merge(bins: DataFrame, *by: str) -> DataFrame:
    return bins.groupBy("g", *by).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def _descend(bins: DataFrame, targets: DataFrame, path: Sequence[str], name: str) -> DataFrame:
    """The bin of each target's rank, the rank within it, and the least value behind it."""
    inside = Window.partitionBy("g", *path).orderBy(name)
    ranked = bins.withColumns(
        {
            "upto": F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
            "after": F.lead("least").over(inside),
        }
    )
    found = targets.drop("n", "least", "most").join(ranked, ["g", *path]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    kept = [c for c in targets.columns if c not in ("rank", "next", "n", "least", "most")]
    rank = (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank")
    return found.select(*kept, name, rank, F.coalesce("after", "next").alias("next"), "n", "least", "most")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles per group, as array ``q``, plus ``n``, ``mini``, ``maxi``.

    Missing values take no part; a group without any other has no row. Missing keys are
    a group. The rows are read twice, the second time only for values beside a rank.
    """
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.select(group.alias("g"), F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull())
    rows = rows.withColumn("high", coarse_number(F.col("x")))
    coarse = materialise(_count(rows, "high"))
    groups = _merge(coarse).select("g", F.col("n").alias("cnt"), F.col("least").alias("mini"), F.col("most").alias("maxi"))
    wanted = F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("j", "p")
    targets = groups.select("*", wanted).withColumn("at", (F.col("cnt") - 1) * F.col("p"))
    targets = targets.withColumns({"rank": F.floor("at").cast("long"), "next": F.lit(None).cast("double")})

    second = materialise(_descend(coarse, targets, [], "high"))
    done = second.where(F.col("least") == F.col("most"))
    open_ = second.where(F.col("least") != F.col("most"))

    origins = open_.select("g", "high", F.col("least").alias("origin"), last_digit(F.col("least"), F.col("most")).alias("unit")).distinct()
    beside = rows.join(origins, ["g", "high"]).withColumn("low", ((F.col("x") - F.col("origin")) / F.col("unit")).cast("long"))
    bins = materialise(_count(beside, "high", "low")).withColumns({f"low{left}": F.shiftright("low", left) for left in _STEPS})
    last, path = open_, ["high"]
    for left in _STEPS:
        last = _descend(_merge(bins, *path, f"low{left}"), last, path, f"low{left}")
        path = [*path, f"low{left}"]
        bins = bins.join(last.select("g", *path).distinct(), ["g", *path], "left_semi")

    both = done.unionByName(last.select(*done.columns))
    upper = F.when(F.col("rank") + 1 < F.col("n"), F.col("least")).otherwise(F.coalesce("next", "least"))
    part = F.col("at") - F.floor("at")
    value_at = F.when((part == 0) | (upper == F.col("least")), F.col("least")).otherwise(F.col("least") + (upper - F.col("least")) * part)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("j", value_at.alias("q")))), lambda s: s["q"])
    out = both.groupBy("g").agg(
        F.any_value("cnt").alias("n"), F.any_value("mini").alias("mini"), F.any_value("maxi").alias("maxi"), listed.alias("q")
    )
    return out.select(*[F.col("g")[k].alias(k) for k in keys], "n", "mini", "maxi", "q")
