"""Per-group values on rows, latest rows, repeatable samples.

A window partitioned by a place puts every row of that place into one task. A
place may hold a large share of all rows, so group values are aggregated first
(map-side combine) and joined back instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from creel.functions.nulls import sum_or_zero, strict

# A key is treated as hot if it holds at least 1/HOT_SHARE of the rows; there can
# be no more than HOT_SHARE such keys, so broadcasting them is bounded.
HOT_SHARE = 1024
# Groups smaller than this fit a task whatever their share.
HOT_MIN_ROWS = 1_000_000
SALTS = 64
# Rows that a task sorts and groups at once when a large table is dealt by key.
TASK_ROWS = 1 << 19


def _null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for i, (a, b) in enumerate(pairs):
        eq = left[a].eqNullSafe(right[b])
        cond = eq if i == 0 else cond & eq
    return cond


def spread_salt(df: DataFrame, salts: int = SALTS) -> Column:
    """A salt that spreads equal rows too: it depends on the row and its input partition."""
    return F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in df.columns]), F.lit(salts)).cast("int")


def many(df: DataFrame, rows: int, *, most: int = TASK_ROWS) -> bool:
    """Whether ``rows`` need more tasks of ``most`` rows than the cores at hand take in one round."""
    return -(-rows // most) > df.sparkSession.sparkContext.defaultParallelism


def dealt(df: DataFrame, keys: Sequence[str], rows: int, *, most: int = TASK_ROWS) -> DataFrame:
    """The rows dealt by key to as many tasks as ``rows`` need at ``most`` each.

    Joins and groupings by these keys then stay in those tasks, whose memory does not
    grow with the table. A table that the cores at hand take in one round is left to Spark.
    """
    return df.repartition(-(-rows // most), *keys) if many(df, rows, most=most) else df


def looked_up(df: DataFrame, keys: Sequence[str], rows: int, *, most: int = TASK_ROWS) -> DataFrame:
    """A table with few rows for one key, dealt, that a join then holds in hash tables.

    The other side passes them unsorted, so a task's memory follows ``most`` however many
    rows of that side share a key. ``rows`` counts the larger side.
    """
    return dealt(df, keys, rows, most=most).hint("shuffle_hash") if many(df, rows, most=most) else df


def hot_keys(
    df: DataFrame, keys: Sequence[str], share: int = HOT_SHARE, min_rows: int = HOT_MIN_ROWS
) -> DataFrame:
    """Keys holding at least 1/share of the rows (so at most ``share`` of them)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = sizes.agg(F.sum("__n")).scalar()
    return sizes.where((F.col("__n") >= min_rows) & (F.col("__n") * share >= total)).select(*keys)


def with_group_values(
    df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], *, share: int = HOT_SHARE, min_rows: int = HOT_MIN_ROWS
) -> DataFrame:
    """Add per-group aggregates to every row; missing keys form a group."""
    groups = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()], F.count(F.lit(1)).alias("__n"))
    return attach_group_values(df, keys, groups, list(aggs), share=share, min_rows=min_rows)


def attach_group_values(
    df: DataFrame,
    keys: Sequence[str],
    groups: DataFrame,
    names: Sequence[str],
    *,
    share: int = HOT_SHARE,
    min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """Add the columns ``names`` of a table with one row per group to every row of ``df``.

    ``groups`` carries its row counts as ``__n``. Rows of hot groups take their value
    from a broadcast of at most ``share`` rows and carry a salt, so the remaining join
    never gathers them in one task.
    """
    if not keys:
        one = groups.agg(F.first(F.struct(*names)).alias("__v")).scalar()
        return df.withColumn("__v", one).select(*df.columns, *[F.col("__v")[n].alias(n) for n in names])
    kk = {k: f"__k_{i}" for i, k in enumerate(keys)}
    groups = groups.select(*[F.col(k).alias(a) for k, a in kk.items()], F.struct(*names).alias("__v"), "__n")
    total = groups.agg(F.sum("__n")).scalar()
    is_hot = (F.col("__n") >= min_rows) & (F.col("__n") * share >= total)
    hot = groups.where(is_hot).select(*kk.values(), F.col("__v").alias("__hot"))
    rest = groups.select(*kk.values(), "__v", F.lit(0).alias("__s"))

    rows = df.join(F.broadcast(hot), _null_safe(df, hot, list(kk.items())), "left").drop(*kk.values())
    rows = rows.withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(spread_salt(df) + 1))
    cond = _null_safe(rows, rest, list(kk.items())) & (F.col("__salt") == F.col("__s"))
    out = rows.join(rest, cond, "left")
    value = F.coalesce(F.col("__hot"), F.col("__v"))
    return out.select(*[rows[c] for c in df.columns], *[value[n].alias(n) for n in names])


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    share: int = HOT_SHARE,
    min_rows: int = HOT_MIN_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join that splits the hot keys of ``left`` over ``salts`` tasks.

    Only the ``right`` rows of hot keys are replicated. ``how`` is one of inner,
    left, left_semi, left_anti.
    """
    hot = hot_keys(left, keys, share, min_rows)
    hot = hot.select(*[F.col(k).alias(f"__h_{i}") for i, k in enumerate(keys)], F.lit(True).alias("__hot"))
    pairs = [(k, f"__h_{i}") for i, k in enumerate(keys)]

    def mark(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), _null_safe(df, hot, pairs), "left").drop(*[h for _, h in pairs])

    rows = mark(left).withColumn(
        "__salt", F.when(F.col("__hot").isNull(), 0).otherwise(spread_salt(left, salts))
    ).drop("__hot")
    copies = mark(right).withColumn(
        "__salt",
        F.explode(F.sequence(F.lit(0), F.when(F.col("__hot").isNull(), 0).otherwise(F.lit(salts - 1)))),
    ).drop("__hot")
    return rows.join(copies, [*keys, "__salt"], how).drop("__salt")


def sum_by(df: DataFrame, keys: Sequence[str], value: str, name: str | None = None, missing: str = "zero") -> DataFrame:
    """Sum by key. ``missing='zero'`` ignores missing values, ``'strict'`` propagates them."""
    agg = sum_or_zero(value) if missing == "zero" else strict(F.sum, value)
    return df.groupBy(*keys).agg(agg.alias(name or value))


def merge_all_but(df: DataFrame, value: str, agg: Column | None = None) -> DataFrame:
    """Group by every column except ``value``; records that differ only there are merged."""
    keys = [c for c in df.columns if c != value]
    agg = sum_or_zero(value) if agg is None else agg
    return df.groupBy(*keys).agg(agg.alias(value)).select(*df.columns)


def latest_with_ties(df: DataFrame, keys: Sequence[str], when: str, *, strict_dates: bool = False, **skew: int) -> DataFrame:
    """All rows at the latest date of their group.

    With ``strict_dates`` a group holding a missing date has no latest date.
    """
    latest = strict(F.max, when) if strict_dates else F.max(when)
    out = with_group_values(df, keys, {"__latest": latest}, **skew)
    return out.where(F.col(when) == F.col("__latest")).drop("__latest")


def latest_one(df: DataFrame, keys: Sequence[str], when: str, tie_break: Sequence[str]) -> DataFrame:
    """One row per group: the latest date, then the smallest ``tie_break``.

    A partial minimum per task, not a window. ``tie_break`` must identify the row
    within its group and date.
    """
    first = F.min_by(F.struct(*df.columns), F.struct(*tie_break))
    per_day = df.where(F.col(when).isNotNull()).groupBy(*keys, when).agg(first.alias("__row"))
    return per_day.groupBy(*keys).agg(F.max_by("__row", when).alias("__row")).select("__row.*")


def sample_key(ids: Sequence[str], seed: int | str) -> Column:
    """Pseudo-random order of rows that depends on their id and the seed only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in ids]))


def sample_n(df: DataFrame, n: int, ids: Sequence[str], seed: int | str = 0) -> DataFrame:
    """Repeatable random sample of ``n`` rows; each task keeps its best ``n`` first."""
    return df.withColumn("__r", sample_key(ids, seed)).orderBy("__r").limit(n).drop("__r")


def sample_one_per_group(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: int | str = 0) -> DataFrame:
    """One repeatable random row per group."""
    row = F.min_by(F.struct(*df.columns), sample_key(ids, seed))
    return df.groupBy(*keys).agg(row.alias("__row")).select("__row.*")


def first_rows(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """Rows 1..k in a stated order."""
    return df.orderBy(*order).limit(k)


def first_matching(df: DataFrame, condition: Column, order: Sequence[str]) -> DataFrame:
    """First row, in a stated order, that meets the condition."""
    return df.where(condition).orderBy(*order).limit(1)
