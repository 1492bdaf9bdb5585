"""Stacking, recoding, filtering and key lookups that prepare the capture table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from creel.functions import scalars as S


def stack_sources(*sources: DataFrame) -> DataFrame:
    """Stack tables whose columns differ; absent columns become missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def stack_aligned(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack tables on the columns of the first, in its order."""
    return reduce(lambda a, b: a.unionByName(b.select(*first.columns)), others, first)


def recode_and_filter(
    df: DataFrame, species: str, drop: Sequence[str] = (), recode: Mapping[str, str] | None = None
) -> DataFrame:
    """Remove listed codes and recode others. A missing code is kept."""
    if drop:
        df = df.where(F.coalesce(~F.col(species).isin(list(drop)), F.lit(True)))
    return df.withColumn(species, S.recode(species, recode)) if recode else df


def period(year: str | Column, limit: int, *, inclusive: bool, keep_missing: bool) -> Column:
    """Condition "from a year on": strict or inclusive, missing kept or dropped."""
    y = F.col(year) if isinstance(year, str) else year
    cond = (y >= limit) if inclusive else (y > limit)
    return cond | y.isNull() if keep_missing else cond


def drop_zero_as_missing(df: DataFrame, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """In a long table, drop zeros of the listed variables (there, zero means missing)."""
    return df.where(~(F.col(name).isin(list(names)) & (F.col(value) == 0)))


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(cols))


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, one pass, one row per column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], list(df.columns), "column", "n_missing")


def level_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def in_table(df: DataFrame, other: DataFrame, on: Sequence[str] | Column) -> DataFrame:
    return df.join(other, on, "left_semi")


def not_in_table(df: DataFrame, other: DataFrame, on: Sequence[str] | Column) -> DataFrame:
    return df.join(other, on, "left_anti")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.subtract(b)


# -- lookups ---------------------------------------------------------------------


class DuplicateKeyError(ValueError):
    """A lookup table holds several rows for one key."""


def require_unique(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return ``dim``, or raise if a key occurs twice. Runs a job."""
    twice = dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").limit(3).collect()
    if twice:
        raise DuplicateKeyError(f"keys {list(keys)} repeat, for example {[r.asDict() for r in twice]}")
    return dim


def lookup(
    df: DataFrame,
    dim: DataFrame,
    on: Mapping[str, str] | Sequence[str],
    columns: Sequence[str] | None = None,
    *,
    null_safe: bool = False,
    check_unique: bool = False,
) -> DataFrame:
    """Left join of a dimension on an explicit key.

    ``on`` maps fact columns to dimension columns (or lists shared names). No
    broadcast is forced: table statistics and adaptive execution choose it when
    the dimension is small. ``null_safe`` also matches missing with missing.
    """
    pairs = list(on.items()) if isinstance(on, Mapping) else [(k, k) for k in on]
    dim_keys = [b for _, b in pairs]
    if columns is not None:
        dim = dim.select(*dim_keys, *columns)
    if check_unique:
        require_unique(dim, dim_keys)
    renamed = dim.withColumnsRenamed({b: f"__d_{i}" for i, (_, b) in enumerate(pairs)})
    cond = None
    for i, (a, _) in enumerate(pairs):
        right = renamed[f"__d_{i}"]
        eq = df[a].eqNullSafe(right) if null_safe else df[a] == right
        cond = eq if cond is None else cond & eq
    return df.join(renamed, cond, "left").drop(*[f"__d_{i}" for i in range(len(pairs))])


@dataclass(frozen=True)
class Link:
    """A declared foreign key: fact column, dimension, its key and the columns wanted."""

    key: str
    dim: DataFrame
    dim_key: str
    columns: tuple[str, ...]


def enrich(df: DataFrame, links: Sequence[Link], check_unique: bool = False) -> DataFrame:
    """One left join per declared foreign key."""
    for link in links:
        df = lookup(df, link.dim, {link.key: link.dim_key}, link.columns, check_unique=check_unique)
    return df


def all_places(
    places: DataFrame, facts: DataFrame, keys: Sequence[str], fill: Mapping[str, object]
) -> DataFrame:
    """Every place with its facts; columns without facts take the given default."""
    out = places.join(facts, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def bridge_by_text_key(
    facts: DataFrame,
    bridge: DataFrame,
    fact_key: str,
    bridge_key: str,
    source: str,
    source_name: str,
    take: Sequence[str],
) -> DataFrame:
    """Join records of one source to a bridge whose key is a number there and text here."""
    typed = (
        bridge.where(F.col(bridge_key).isNotNull())
        .select(F.col(bridge_key).cast("string").alias(fact_key), *take)
        .distinct()
        .withColumn(source, F.lit(source_name))
    )
    keyed = facts.withColumn(fact_key, F.col(fact_key).cast("string"))
    return keyed.join(typed, [fact_key, source], "left")
