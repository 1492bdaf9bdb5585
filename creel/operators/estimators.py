"""Richness extrapolation and species accumulation from incidence frequencies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from creel.functions import scalars as S
from creel.functions.nulls import row_mean

ESTIMATORS = ["chao", "jack1", "jack2", "boot"]
# steps of one accumulation curve expanded by one row before it is spread again
BLOCK = 4096


def incidence(df: DataFrame, pool: str, unit: str, species: str) -> DataFrame:
    """Per pool: its units ``n``, its species ``__s``, and how many species ``m`` are
    held by exactly ``f`` units, as an array ``__levels`` of (f, m).

    Units without any record do not appear in a capture table and do not count. One
    pass: next to its species every unit emits one row without species, which stands
    for the unit itself. Its frequency is the number of units, so no second
    aggregation has to be joined.
    """
    sets = df.groupBy(pool, unit).agg(F.collect_set(species).alias("__sp"))
    itself = F.array(F.lit(None).cast(df.schema[species].dataType))
    held = sets.select(pool, F.explode(F.concat("__sp", itself)).alias("__sp"))
    freq = held.groupBy(pool, "__sp").agg(F.count(F.lit(1)).alias("__f"))
    by_level = freq.groupBy(pool, F.col("__sp").isNull().alias("__u"), "__f").agg(F.count(F.lit(1)).alias("__m"))
    # distinct frequencies of one pool: never more than its species
    level = F.when(~F.col("__u"), F.struct(F.col("__f").alias("f"), F.col("__m").alias("m")))
    return by_level.groupBy(pool).agg(
        F.max(F.when(F.col("__u"), F.col("__f"))).alias("n"),
        F.sum(F.when(~F.col("__u"), F.col("__m"))).alias("__s"),
        F.collect_list(level).alias("__levels"),
    ).where(F.col("__s") > 0)


def pool_estimates(df: DataFrame, pool: str, unit: str, species: str) -> DataFrame:
    """Observed richness and the Chao, first and second order jackknife and bootstrap estimates.

    ``jack2`` is missing for a pool of one unit.
    """
    n, s = F.col("n").cast("double"), F.col("__s")

    def held_by(units: int) -> Column:
        found = F.filter("__levels", lambda e: e["f"] == units)
        return F.coalesce(F.get(found, F.lit(0))["m"], F.lit(0)).cast("double")

    missed = F.aggregate(
        "__levels", F.lit(0.0), lambda acc, e: acc + e["m"] * F.pow(1 - e["f"].cast("double") / n, n)
    )
    per_pool = incidence(df, pool, unit, species).withColumns({"__a1": held_by(1), "__a2": held_by(2), "__b": missed})
    a1, a2 = F.col("__a1"), F.col("__a2")
    shrink = (n - 1) / n
    return per_pool.select(
        pool,
        "n",
        F.col("__s").alias("richesse_observee"),
        (s + shrink * F.when(a2 > 0, a1 * a1 / F.nullif(2 * a2, F.lit(0.0))).otherwise(a1 * (a1 - 1) / 2)).alias("chao"),
        (s + a1 * shrink).alias("jack1"),
        (s + a1 * (2 * n - 3) / n - F.try_divide(a2 * (n - 2) * (n - 2), n * (n - 1))).alias("jack2"),
        (s + F.col("__b")).alias("boot"),
    )


def mean_estimate(
    estimates: DataFrame, *, below_observed_missing: bool, digits: int = 2, out: str = "richesse_absolue_moy_estimateurs"
) -> DataFrame:
    """Mean of the four estimators, everything rounded.

    Point form: plain mean, missing if one is. Basin form (``below_observed_missing``):
    an estimate below the observed richness is dropped, the mean uses the others.
    """
    if below_observed_missing:
        estimates = estimates.withColumns({c: S.null_below(c, F.col("richesse_observee")) for c in ESTIMATORS})
    estimates = estimates.withColumn(out, row_mean(*ESTIMATORS, ignore_missing=below_observed_missing))
    return estimates.withColumns({c: S.round_even(c, digits) for c in [*ESTIMATORS, out]})


# Stirling remainder of ln Γ at 1..200; beyond, two terms of the series are exact to 3e-15
_REMAINDER = [
    math.lgamma(m) - ((m - 0.5) * math.log(m) - m + 0.5 * math.log(2 * math.pi)) for m in range(1, 201)
]


def _stirling_remainder(x: Column) -> Column:
    series = (F.lit(1 / 12) - F.lit(1 / 360) / (x * x)) / x
    return F.coalesce(F.get(F.lit(_REMAINDER), F.least(x, F.lit(201.0)).cast("int") - 1), series)


def missed_share(n: Column, f: Column, k: Column) -> Column:
    """``C(n-f, k) / C(n, k)``: chance that ``k`` of ``n`` units all miss a species held by ``f``.

    Closed form through Stirling's series, arranged so that large terms cancel
    before they are evaluated (the ratio is symmetric in ``f`` and ``k``; the
    smaller one multiplies the logarithms). No running product, so no window.
    """
    n = n.cast("double")
    s, t = F.least(f, k).cast("double"), F.greatest(f, k).cast("double")
    x0, y0, x1, y1 = n + 1, n - s + 1, n - t + 1, n - t - s + 1
    log_ratio = (
        (x1 - 0.5) * F.log1p(s / y1)
        - (x0 - 0.5) * F.log1p(s / y0)
        + s * F.ln(y1 / y0)
        + _stirling_remainder(x1)
        - _stirling_remainder(y1)
        - _stirling_remainder(x0)
        + _stirling_remainder(y0)
    )
    return F.when(f + k > n, 0.0).otherwise(F.exp(log_ratio))


def accumulation(df: DataFrame, site: str, op: str, species: str, *, min_ops: int = 0, block: int = BLOCK) -> DataFrame:
    """Expected richness of 1..n operations of each site with more than ``min_ops`` (exact, not sampled).

    ``S(k) = Σ m(f) · (1 - C(n-f,k)/C(n,k))`` over the distinct frequencies ``f``,
    held by ``m`` species each. A curve is expanded in blocks of steps, and the
    blocks are spread before the steps are, so one huge site fills many tasks. The
    frequencies are summed up within the row of each step.
    """
    pools = incidence(df, site, op, species).where(F.col("n") > min_ops)
    last = F.floor((F.col("n") - 1) / block).cast("bigint")
    blocks = pools.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    # a stated number of partitions: the rows are few here but grow by up to ``block`` below,
    # which adaptive coalescing would not foresee
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = blocks.repartition(parts, F.col(site), F.col("__b"))
    first = F.col("__b") * block + 1
    steps = spread.withColumn("n_opes", F.explode(F.sequence(first, F.least(first + block - 1, F.col("n")))))

    def gain(total: Column, level: Column) -> Column:
        return total + level["m"] * (1 - missed_share(F.col("n"), level["f"], F.col("n_opes")))

    return steps.select(site, "n_opes", F.aggregate("__levels", F.lit(0.0), gain).alias("pt_richesse"))


def accumulation_well_sampled(
    df: DataFrame,
    site: str,
    op: str,
    species: str,
    min_ops: int = 30,
    labels: DataFrame | None = None,
    label: str | None = None,
    unknown: str = "Inconnu",
) -> DataFrame:
    """Curves of the sites with more than ``min_ops`` operations, with a place label."""
    curve = accumulation(df, site, op, species, min_ops=min_ops)
    if labels is None:
        return curve
    named = curve.join(labels.select(site, label).distinct(), site, "left")
    text = F.concat(F.col(site).cast("string"), F.lit(" ("), F.coalesce(F.col(label), F.lit(unknown)), F.lit(")"))
    return named.withColumn(label, text)
