"""Missing-value rules for aggregates and comparisons.

Spark aggregates skip nulls and return null for an all-null group. Inventory
tables need three other rules: an empty sum is zero, a strict aggregate is
missing as soon as one input is missing, and a distinct count sees "missing"
as one value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sum_or_zero(c: str | Column) -> Column:
    """Sum of the non-missing values; 0 where there are none."""
    return F.coalesce(F.sum(_col(c)), F.lit(0))


def strict(agg: Callable[[Column], Column], c: str | Column) -> Column:
    """``agg(c)``, missing if any input row is missing."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), agg(c))


def sum_strict(c: str | Column) -> Column:
    return strict(F.sum, c)


def mean_strict(c: str | Column) -> Column:
    return strict(F.avg, c)


def n_distinct(c: str | Column) -> Column:
    """Distinct values, a missing value counting as one of them."""
    c = _col(c)
    return F.count_distinct(c) + F.coalesce(F.max(F.when(c.isNull(), 1).otherwise(0)), F.lit(0))


def n_distinct_where(flag: str | Column, c: str | Column) -> Column:
    """Distinct values on the rows where ``flag`` is true, a missing value counting as one."""
    flag, c = _col(flag), _col(c)
    return F.count_distinct(F.when(flag, c)) + F.coalesce(F.max(F.when(flag & c.isNull(), 1)), F.lit(0))


def n_distinct_if(flag: str | Column, c: str | Column) -> Column:
    """As ``n_distinct_where``, but a row whose flag is missing also counts as one missing value."""
    flag, c = _col(flag), _col(c)
    unknown = flag.isNull() | (flag & c.isNull())
    return F.count_distinct(F.when(flag, c)) + F.coalesce(F.max(F.when(unknown, 1)), F.lit(0))


def row_mean(*cols: str | Column, ignore_missing: bool = False) -> Column:
    """Mean across columns of one row."""
    cs = [_col(c).cast("double") for c in cols]
    if not ignore_missing:
        return sum(cs[1:], cs[0]) / F.lit(float(len(cs)))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0.0)))
    known = sum((c.isNotNull().cast("int") for c in cs[1:]), cs[0].isNotNull().cast("int"))
    return F.try_divide(total, known)


def ratio(num: str | Column, den: str | Column) -> Column:
    """Division that is missing, not an error, where the denominator is zero."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))
