"""From a level series and levels asked for to the times at which they were passed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from creel.operators import series as TS


def level_to_time(levels: DataFrame, series: DataFrame, wanted: str, time: str, level: str, before: float | None = None, step: float = 1.0) -> DataFrame:
    """Restrict the series, shift it to its first level, cut it at its minimum and read it backwards.

    The time of the minimum is read as a number of rows, see :func:`series.until_minimum`.
    """
    shifted = TS.baseline(series, time, level, before)
    return TS.inverse_level(levels, TS.until_minimum(shifted, time, level), wanted, time, level, step)
