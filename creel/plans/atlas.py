"""From survey sources to presence, absence and status per basin."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from creel.functions import scalars as S
from creel.functions.nulls import n_distinct, n_distinct_if
from creel.operators import presence as PR, spatial as SP
from creel.operators.grouping import merge_all_but
from creel.operators.prepare import period, recode_and_filter, stack_sources
from creel.sources.tables import materialise


@dataclass(frozen=True)
class CaptureColumns:
    """Names of the capture table's columns."""

    station: str = "code_station"
    date: str = "date_peche"
    year: str = "annee"
    species: str = "code_espece"
    count: str = "effectif"
    protocol: str = "type_peche"
    x: str = "x_wgs84"
    y: str = "y_wgs84"
    operation: str = "ope_id"
    place: str = "code_coords"


@dataclass(frozen=True)
class Rules:
    """Choices that differ between studies."""

    first_year: int
    inventory_pattern: str
    drop_species: Sequence[str] = ()
    recode_species: Mapping[str, str] = field(default_factory=dict)


def clean_captures(sources: Sequence[DataFrame], rules: Rules, c: CaptureColumns = CaptureColumns()) -> DataFrame:
    """Stack sources, recode species, add keys, merge duplicate records, keep the period.

    Years after the first year, or unknown, are kept. The period is applied before
    the merge: it looks at a grouping column only, so fewer rows are shuffled.
    """
    rows = recode_and_filter(stack_sources(*sources), c.species, rules.drop_species, rules.recode_species)
    rows = rows.withColumns({c.date: S.to_day(c.date), c.year: S.to_whole(c.year)})
    rows = rows.where(period(c.year, rules.first_year, inclusive=False, keep_missing=True))
    rows = rows.withColumn(c.place, S.coordinate_key(c.x, c.y))
    rows = rows.withColumn(c.operation, S.paste(c.place, c.station, c.date, c.year))
    return merge_all_but(rows, c.count)


def point_statuses(captures: DataFrame, rules: Rules, c: CaptureColumns = CaptureColumns()) -> DataFrame:
    """Presences and absences of every operation, with their status."""
    attrs = [c.place, c.station, c.date, c.year, c.protocol, c.x, c.y]
    return PR.point_table(captures, c.operation, c.species, c.count, c.protocol, rules.inventory_pattern, attrs)


def placed_statuses(
    captures: DataFrame,
    basins: DataFrame,
    basin_cols: Sequence[str],
    rings: str,
    rules: Rules,
    c: CaptureColumns = CaptureColumns(),
    names: DataFrame | None = None,
    name_col: str | None = None,
) -> DataFrame:
    """The atlas's point table: every operation's presences and absences, with the basin its place lies in.

    A species counts if it was ever caught, anywhere and in any year. Operations outside
    all basins and before the first year, or of an unknown year, are then left out; they
    are told from the places, before the species are expanded. A place in two basins
    gives its rows to both. The captures are read three times, so they are written once.
    """
    captures = materialise(captures)
    places = captures.select(c.place, c.x, c.y).distinct()
    inside = SP.point_in_polygon(places, basins, c.x, c.y, rings, basin_cols)
    of_place = inside.groupBy(c.place).agg(F.sort_array(F.collect_set(F.struct(*basin_cols))).alias("__basins"))
    kept = captures.where(period(c.year, rules.first_year, inclusive=True, keep_missing=False)).join(of_place, c.place)
    attrs = [c.place, c.station, c.date, c.year, c.protocol, c.x, c.y, "__basins"]
    species = PR.species_ever_present(captures, c.species, c.count)
    table = PR.point_table(kept, c.operation, c.species, c.count, c.protocol, rules.inventory_pattern, attrs, species, names, name_col)
    return table.select(*[x for x in table.columns if x != "__basins"], F.inline("__basins"))


def _placed(captures: DataFrame, basin: str, rules: Rules, c: CaptureColumns) -> DataFrame:
    """Captures with a basin and a known year from the first year on."""
    known = period(c.year, rules.first_year, inclusive=True, keep_missing=False)
    return captures.where(F.col(basin).isNotNull() & known)


def basin_statuses(captures: DataFrame, basin: str, rules: Rules, c: CaptureColumns = CaptureColumns()) -> DataFrame:
    """Highest status per basin, species and year, straight from the captures.

    ``captures`` carries the basin. Years from the first year on, known years only.
    """
    species = PR.species_ever_present(captures, c.species, c.count)
    kept = _placed(captures, basin, rules, c)
    full = S.pattern_flag(c.protocol, rules.inventory_pattern)
    return PR.status_by(kept, [basin, c.year], c.species, c.count, full, species)


def basin_effort(captures: DataFrame, basin: str, rules: Rules, c: CaptureColumns = CaptureColumns()) -> DataFrame:
    """Years, places and inventoried places per basin, over the captures that basin statuses count."""
    flag = S.pattern_flag(c.protocol, rules.inventory_pattern).alias("__inv")
    seen = _placed(captures, basin, rules, c).select(basin, c.year, c.place, flag).distinct()
    return seen.groupBy(basin).agg(
        n_distinct(c.year).alias("n_annees"),
        n_distinct(c.place).alias("n_pops"),
        n_distinct_if("__inv", c.place).alias("n_inventaires"),
    )
