"""From captures per operation to diversity models and richness extrapolation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from creel.functions import scalars as S
from creel.operators import diversity as D, estimators as E, regression as R
from creel.operators.grouping import latest_with_ties


def point_diversity(
    lots: DataFrame,
    ops: DataFrame,
    op: str,
    point: str,
    when: str,
    species: str,
    count: str,
    inventory: Column | None = None,
    recode: Mapping[str, str] | None = None,
) -> DataFrame:
    """Indices of the latest inventoried operation of each point.

    ``ops`` holds one row per operation; only the columns named here are read from it.
    """
    kept = ops if inventory is None else ops.where(inventory)
    rows = lots.where(F.col(count) > 0)
    if recode:
        rows = rows.withColumn(species, S.recode(species, recode))
    return D.latest_per_point(rows, kept.select(op, point, when), op, point, when, species, count)


def index_models(
    points: DataFrame, env: DataFrame, point: str, env_key: str, predictors: Sequence[str], indices: Sequence[str] = D.INDICES
) -> DataFrame:
    """Model table of all indices on the environment, incomplete points dropped."""
    columns = {c: c for c in [point, *indices, *predictors]}
    table = D.model_table(points, point, [(env.select(env_key, *predictors), {point: env_key})], columns, predictors)
    return R.model_table(table, list(indices), list(predictors))


def point_density_model(
    ops: DataFrame, lots: DataFrame, coords: DataFrame, point: str, op: str, year: str, surface: str, count: str, x: str, y: str
) -> DataFrame:
    """Log density at the latest year of each point on its two coordinates and the sampled surface.

    ``coords`` holds one row per point. Operations without individuals have no logarithm
    and take no part, nor do points without coordinates.
    """
    rows = D.density_by_point(ops, lots, point, op, year, surface, count).join(coords.select(point, x, y), point)
    return R.linear_models(rows, ["log_densite"], [x, y, surface])


def basin_density_model(
    rows: DataFrame, basins: DataFrame, basin: str, year: str, count: str, area: str, altitude: str, exclude: Sequence[object] = ()
) -> DataFrame:
    """Density of each basin at its latest year on its area and greatest altitude.

    ``rows`` holds captures with their basin, ``basins`` one row per basin with area and
    altitude. A basin counts once for each of its rows of the latest year.
    """
    dense = D.density_by_basin(rows.join(basins.select(basin, area, altitude), basin), basin, year, count, area, exclude)
    return R.linear_models(dense, ["densite_bassin"], [area, altitude])


def local_and_basin_richness(
    lots: DataFrame, ops: DataFrame, op: str, point: str, basin: str, when: str, species: str
) -> DataFrame:
    """Mean of the point estimates beside the estimate of the basin's latest operations."""
    local = E.mean_estimate(
        E.pool_estimates(lots.select(op, species).join(ops.select(op, point), op), point, op, species), below_observed_missing=False
    )
    local = local.join(ops.select(point, basin).distinct(), point)
    last = latest_with_ties(ops.select(op, point, basin, when), [point], when).select(op, basin)
    regional = E.mean_estimate(
        E.pool_estimates(lots.select(op, species).join(last, op), basin, op, species), below_observed_missing=True, out="rsr_abs"
    )
    regional = regional.select(basin, F.col("n").alias("n_pop"), F.col("richesse_observee").alias("rsr_obs"), "rsr_abs")
    return D.mean_local(local, regional, basin, "richesse_absolue_moy_estimateurs")
