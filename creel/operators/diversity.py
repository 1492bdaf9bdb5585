"""Diversity indices of a site from a long table of counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from creel.functions.nulls import mean_strict, n_distinct, n_distinct_where, ratio, sum_or_zero, sum_strict
from creel.operators.grouping import attach_group_values, latest_one, latest_with_ties
from creel.operators.prepare import complete_rows, lookup
from creel.sources.tables import materialise

INDICES = ["richesse", "shannon", "simpson", "pielou"]


def indices(
    df: DataFrame,
    site: str | Sequence[str],
    species: str,
    count: str,
    *,
    holes: str = "zero",
    vocabulary: DataFrame | None = None,
    missing: str = "strict",
) -> DataFrame:
    """Richness, Shannon, Simpson and Pielou per site.

    Works on sums only: with ``N = Σn``, ``H = ln N - Σ n ln n / N`` and
    ``D = (N² - Σ n²) / N²``, so there is no pivot and both aggregations combine on
    the map side. Pielou is missing for a site with one species. Counts that are
    zero or missing do not contribute; a site without individuals is left out.

    ``holes='missing'`` gives missing Shannon, Simpson and Pielou where a site
    does not hold a record of every species of ``vocabulary``, as a wide matrix
    without a fill value does.
    """
    sites = [site] if isinstance(site, str) else list(site)
    total = sum_strict(count) if missing == "strict" else sum_or_zero(count)
    per_species = df.groupBy(*sites, species).agg(total.alias("__n"))
    n = F.when(F.col("__n") > 0, F.col("__n").cast("double"))
    per_site = per_species.groupBy(*sites).agg(
        F.count(n).alias("richesse"),
        F.sum(n).alias("__N"),
        F.sum(n * F.ln(n)).alias("__nlogn"),
        F.sum(n * n).alias("__nn"),
        F.count(F.col("__n")).alias("__cells"),
    ).where(F.col("richesse") > 0)
    single = F.col("richesse") == 1
    h = F.when(single, 0.0).otherwise(F.ln("__N") - F.col("__nlogn") / F.col("__N"))
    nn = F.col("__N") * F.col("__N")
    d = F.when(single, 0.0).otherwise((nn - F.col("__nn")) / nn)
    full = F.lit(True)
    if holes == "missing":
        if vocabulary is None:
            raise ValueError("holes='missing' needs the vocabulary of species")
        full = F.col("__cells") == vocabulary.select(species).distinct().agg(F.count(F.lit(1))).scalar()
    out = per_site.select(
        *sites,
        "richesse",
        F.when(full, h).alias("shannon"),
        F.when(full, d).alias("simpson"),
    )
    return out.withColumn(
        "pielou", F.when(F.col("richesse") > 1, F.col("shannon") / F.ln(F.col("richesse").cast("double")))
    )


def indices_presence(df: DataFrame, site: str | Sequence[str], species: str) -> DataFrame:
    """The same indices on a presence table: every recorded species counts once."""
    sites = [site] if isinstance(site, str) else list(site)
    once = df.select(*sites, species).distinct().withColumn("__one", F.lit(1.0))
    return indices(once, sites, species, "__one")


def latest_per_point(
    captures: DataFrame, bridge: DataFrame, op: str, point: str, when: str, species: str, count: str, **skew: int
) -> DataFrame:
    """Indices of the latest operation of each point, ties kept.

    Only an operation with individuals of some species can be the latest; a species
    with a missing count has no total. The dates are compared on one row per operation,
    and only the captures of the kept operations are summed up by species.
    """
    holes = captures.where(F.col(count).isNull()).select(op, species).distinct()
    same = F.col(op).eqNullSafe(F.col("__op")) & F.col(species).eqNullSafe(F.col("__sp"))
    held = captures.where(F.col(count) > 0).join(holes.toDF("__op", "__sp"), same, "left_anti").select(op).distinct()
    dated = bridge.select(op, point, when).distinct().join(held, op, "left_semi")
    last = materialise(latest_with_ties(dated, [point], when, strict_dates=True, **skew))
    found = indices(captures.join(last.select(op), op, "left_semi"), op, species, count)
    return last.join(found, op)


def indices_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str] = INDICES) -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(ids), list(cols), "name", "value"
    )


def model_table(
    point_indices: DataFrame,
    point: str,
    lookups: Sequence[tuple[DataFrame, Mapping[str, str]]],
    columns: Mapping[str, str],
    required: Sequence[str],
) -> DataFrame:
    """Indices with environment, coordinates and basin; incomplete rows dropped.

    ``lookups`` holds (table, {point column: key}) pairs and ``columns`` maps new
    to old names.
    """
    out = point_indices
    for dim, on in lookups:
        out = lookup(out, dim, on)
    return complete_rows(out.select(*[F.col(old).alias(new) for new, old in columns.items()]), required)


def positive_only(df: DataFrame, cols: Sequence[str] = ("shannon", "simpson")) -> DataFrame:
    """Keep sites whose listed indices are positive and add ``log10(richness + 1)``."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.col(c) > 0)
    return df.where(cond).withColumn("log_richesse", F.log10(F.col("richesse") + 1))


def richness(df: DataFrame, keys: Sequence[str], species: str, keep: Column | None = None, out: str = "richesse") -> DataFrame:
    """Distinct species by key, optionally on the rows meeting ``keep``."""
    rows = df if keep is None else df.where(keep)
    return rows.groupBy(*keys).agg(n_distinct(species).alias(out))


def local_and_regional(
    df: DataFrame,
    point: str,
    basin: str,
    species: str,
    year: str,
    full_inventory: Column,
    present: Column,
    min_points: int = 4,
) -> DataFrame:
    """Mean local richness against regional richness.

    Basins need more than ``min_points`` inventoried points; each point counts
    with its latest year only.
    """
    # latest year of each species at each point; a species counts where that is the point's latest
    last = F.max(F.when(present, F.col(year)))
    per_species = df.where(full_inventory).groupBy(basin, point, species).agg(last.alias("__y"))
    held = F.collect_list(F.when(F.col("__y").isNotNull(), F.struct(F.col("__y").alias("y"), F.col(species).alias("sp"))))
    # an array of species of one point is bounded by the vocabulary
    per_point = per_species.groupBy(basin, point).agg(held.alias("__held"))
    per_point = per_point.withColumn("__y", F.array_max("__held")["y"])
    kept = F.filter("__held", lambda e: e["y"] == F.col("__y"))
    rows = per_point.select(basin, point, F.explode_outer(kept).alias("__e"))
    found = F.col("__e").isNotNull()
    out = rows.groupBy(basin).agg(
        n_distinct(point).alias("__points"),
        n_distinct_where(found, F.col("__e.sp")).alias("richesse_regionale"),
        F.try_divide(F.count_if(found), n_distinct_where(found, point)).alias("richesse_loc_moy"),
    )
    return out.where((F.col("__points") > min_points) & (F.col("richesse_regionale") > 0)).drop("__points")


def operation_richness(
    lots: DataFrame, op: str, point: str, when: str, species: str, op_cols: Sequence[str] = ()
) -> DataFrame:
    """Distinct species per operation (missing counts as one) at the latest operation of each point."""
    keys = [point, op, when, *op_cols]
    per_op = lots.groupBy(*keys).agg(n_distinct(species).alias("rsl"))
    return latest_one(per_op, [point], when, [op])


def mean_local(estimates: DataFrame, basin_estimates: DataFrame, basin: str, value: str, out: str = "lsr_moy") -> DataFrame:
    """Mean point estimate per basin (missing if one is) beside the basin estimate."""
    local = estimates.groupBy(basin).agg(mean_strict(value).alias(out))
    return basin_estimates.join(local, basin, "left")


def density_by_point(
    ops: DataFrame, lots: DataFrame, point: str, op: str, year: str, surface: str, count: str, **skew: int
) -> DataFrame:
    """Individuals per surface at the latest year of each point, with its log; positive surfaces only."""
    last = latest_with_ties(ops, [point], year, **skew)
    totals = lots.groupBy(op).agg(sum_or_zero(count).alias("effectif"))
    out = last.join(totals, op, "left").withColumn("effectif", F.coalesce("effectif", F.lit(0.0)))
    out = out.where(F.col(surface) > 0).withColumn("densite", F.col("effectif") / F.col(surface))
    return out.withColumn("log_densite", F.ln("densite"))


def density_by_basin(
    rows: DataFrame,
    basin: str,
    year: str,
    count: str,
    area: str,
    exclude: Sequence[object] = (),
    **skew: int,
) -> DataFrame:
    """Individuals of the basin at its latest year over the basin area, kept on each row."""
    kept = rows.where(~F.col(basin).isin(list(exclude))) if exclude else rows
    per_year = kept.groupBy(basin, year).agg(sum_strict(count).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    per_basin = per_year.groupBy(basin).agg(
        F.max(year).alias("__latest"), F.max_by("__sum", year).alias("effectif_bassin"), F.sum("__n").alias("__n")
    )
    out = attach_group_values(kept, [basin], per_basin, ["__latest", "effectif_bassin"], **skew)
    out = out.where(F.col(year) == F.col("__latest")).drop("__latest")
    out = out.withColumn("densite_bassin", ratio("effectif_bassin", area))
    return out.withColumns({"log_densite_bassin": F.ln("densite_bassin"), "log_surf": F.ln(area)})
