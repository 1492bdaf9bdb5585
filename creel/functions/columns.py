"""Column selection by position, name or type, and wide/long reshaping."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` by position, in either direction."""
    a, b = df.columns.index(first), df.columns.index(last)
    return df.columns[a : b + 1] if a <= b else df.columns[b : a + 1][::-1]


def cols_starting(df: DataFrame, prefix: str) -> list[str]:
    """Names with the given prefix; upper and lower case are not told apart."""
    return [c for c in df.columns if c.lower().startswith(prefix.lower())]


def cols_ending(df: DataFrame, suffix: str) -> list[str]:
    return [c for c in df.columns if c.lower().endswith(suffix.lower())]


def cols_of_type(df: DataFrame, *types: str) -> list[str]:
    """Names whose Spark type matches one of ``types`` (decimal matches any precision)."""
    return [c for c, t in df.dtypes if re.sub(r"\(.*", "", t) in types]


def numeric_cols(df: DataFrame) -> list[str]:
    return cols_of_type(df, "tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def cols_except(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def map_columns(df: DataFrame, cols: Sequence[str], f: Callable[[Column], Column]) -> DataFrame:
    """Replace each listed column by ``f`` of it, in one projection."""
    return df.withColumns({c: f(F.col(c)) for c in cols})


def select_rename(
    df: DataFrame, mapping: dict[str, str], *, everything: bool = False, drop: Sequence[str] = ()
) -> DataFrame:
    """Select ``{new: old}`` in that order; ``everything`` appends the remaining columns."""
    picked = [F.col(old).alias(new) for new, old in mapping.items()]
    if everything:
        used = set(mapping.values()) | set(drop)
        picked += [F.col(c) for c in df.columns if c not in used]
    return df.select(*picked)


def to_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    """Wide to long; ids repeat for each value column."""
    return df.unpivot(list(ids), list(values), name, value)


def to_wide(
    df: DataFrame,
    ids: Sequence[str],
    name: str,
    value: str,
    levels: Sequence[str],
    fill: float | None = None,
    agg: Callable[[str], Column] = F.max,
) -> DataFrame:
    """Long to wide for the stated ``levels``.

    Levels are an argument so that no extra job looks for them. ``agg`` resolves
    several rows per cell and must not depend on row order. ``fill=None`` leaves
    holes missing.
    """
    wide = df.groupBy(*ids).pivot(name, list(levels)).agg(agg(value))
    return wide if fill is None else wide.fillna(fill, subset=list(levels))
