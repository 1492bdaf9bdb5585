"""An ordered level series: baseline shift, minimum, and inverse interpolation.

A series may be of any length and spacing. What depends on the rows before is found by
ranges of the order, see :mod:`creel.operators.order`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from creel.operators.order import RANGE, carried_in, numbered, ranged
from creel.sources.tables import materialise


def baseline(df: DataFrame, time: str, level: str, before: float | None = None) -> DataFrame:
    """Restrict to ``time < before`` and subtract the level at the earliest time."""
    rows = df.select(time, level)
    if before is not None:
        rows = rows.where(F.col(time) < before)
    first = rows.agg(F.min_by(level, time)).scalar()
    return rows.withColumn(level, F.col(level) - first)


def minimum(df: DataFrame, time: str, level: str) -> DataFrame:
    """Lowest level and every time it occurs."""
    low = df.agg(F.min(level)).scalar()
    return df.where(F.col(level) == low).select(time, level)


def until_minimum(df: DataFrame, time: str, level: str) -> DataFrame:
    """The first k rows in time order, k being the time of the minimum read as a row count.

    With times stepping by one from zero this leaves out the minimum itself. Rows are
    numbered by ranges of the time, and the minimum is a value in the plan.
    """
    rows = numbered(df, [time], "__row")
    k = df.agg(F.min_by(time, F.struct(level, time))).scalar()
    return rows.where(F.col("__row") < F.floor(k)).select(*df.columns)


def new_lows(series: DataFrame, time: str, level: str) -> DataFrame:
    """Rows whose level is below all earlier ones, with the lowest earlier level as ``__prev``.

    One row per time. The rows are dealt out by ranges of equal size, so times may crowd
    anywhere; the lowest level of all ranges before is carried into each.
    """
    rows = carried_in(ranged(series.select(time, level), [time]), __before=(F.min(level), F.min))
    earlier = Window.partitionBy(RANGE).orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__prev", F.least(F.min(level).over(earlier), "__before"))
    return rows.where(F.col("__prev").isNull() | (F.col(level) < F.col("__prev"))).select(time, level, "__prev")


def inverse_level(levels: DataFrame, series: DataFrame, wanted: str, time: str, level: str, step: float = 1.0) -> DataFrame:
    """Time at which the series first falls below each wanted level, linear between steps.

    The segment ends are the first time whose level is below the wanted one and
    the time one ``step`` before. The result is missing where the level is never
    passed or that earlier time is not in the series.

    Only a new low can be a "first time below", and later lows are lower. So the one for
    a wanted level is the greatest low below it: lows and wanted levels are put in one
    order by level, and the last low is carried forward, across ranges and within.
    """
    # read several times below, so written out once
    one = materialise(series.groupBy(time).agg(F.min(level).alias(level)).where(F.col(level).isNotNull()))
    lows = new_lows(one, time, level)
    earlier = one.select((F.col(time) + F.lit(step)).alias("__t"), F.col(level).alias("__y_sup"))
    lows = lows.join(earlier, F.col(time) == F.col("__t"), "left")
    low = F.struct(F.col(level).cast("double").alias("y_inf"), F.col(time).cast("double").alias("t_inf"), F.col("__y_sup").cast("double").alias("y_sup"))
    row = F.struct(*levels.columns)
    # at equal levels what is asked comes first: a low is below it only if it is lower
    asked = levels.select(F.col(wanted).cast("double").alias("__level"), F.lit(0).alias("__kind"), F.lit(None).cast("struct<y_inf:double,t_inf:double,y_sup:double>").alias("__low"), row.alias("__asked"))
    marks = lows.select(F.col(level).cast("double").alias("__level"), F.lit(1).alias("__kind"), low.alias("__low"), F.lit(None).cast(asked.schema["__asked"].dataType).alias("__asked"))
    both = carried_in(ranged(asked.unionByName(marks), ["__level", "__kind"]), __carried=(F.max("__low"), F.max))
    so_far = Window.partitionBy(RANGE).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__last", F.coalesce(F.max("__low").over(so_far), "__carried")).where("__kind = 0")
    y_inf, t_inf, y_sup = (F.col("__last")[c] for c in ("y_inf", "t_inf", "y_sup"))
    # time = t_inf + (wanted - y_inf) / a with a = (y_inf - y_sup) / step
    year = t_inf + F.try_divide(F.col("__level") - y_inf, (y_inf - y_sup) / F.lit(step))
    return both.select("__asked.*", year.alias("annee_niveau"))
