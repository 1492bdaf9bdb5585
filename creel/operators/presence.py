"""Presence, absence and ordered status of a species at an operation, a point or a basin.

Species are numbered once. What an operation or place holds is one bit for each species,
64-bit words that merge in any order, and what it lacks is their complement.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from creel.functions import scalars as S
from creel.functions.nulls import ratio, sum_or_zero, sum_strict
from creel.operators.order import numbered
from creel.operators.prepare import all_places, lookup

# Ordered status labels, lowest first, and the default of a map.
STATUS_LEVELS = ["Non détecté", "Absent", "Présent"]
NOT_SURVEYED = "Non prospecté"
# Trend codes and their ordered labels, from rise to decline.
TREND_LABELS = {
    "H": "Hausse",
    "Sh": "Stable / hausse",
    "S": "Stable",
    "Sb": "Stable / baisse",
    "B": "Baisse",
}
# species in a block of the dictionary: the bits of a whole number, without its sign
WIDTH = 63
ABSENT_EVERYWHERE = "Espèce absente du périmètre de l'étude"


def species_ever_present(df: DataFrame, species: str, count: str) -> DataFrame:
    """Species with a positive total; one missing count removes the species."""
    total = df.groupBy(species).agg(sum_strict(count).alias("__total"))
    return total.where(F.col("__total") > 0).select(species)


def presences(df: DataFrame, species: str, count: str, status: str = "statut", *, distinct: bool = True) -> DataFrame:
    """Positive records labelled present."""
    rows = df.where(F.col(count) > 0)
    return (rows.distinct() if distinct else rows).withColumn(status, F.lit(STATUS_LEVELS[2]))


def protocol_status(full_inventory: Column) -> Column:
    """Absent under a full inventory, otherwise (also if unknown) not detected."""
    return F.when(full_inventory, STATUS_LEVELS[1]).otherwise(STATUS_LEVELS[0])


def record_status(count: str, full_inventory: Column) -> Column:
    """Present with individuals, otherwise what the protocol says; a missing count has no status."""
    return F.when(F.col(count) > 0, STATUS_LEVELS[2]).when(F.col(count).isNotNull(), protocol_status(full_inventory))


def protocol_rank(full_inventory: Column) -> Column:
    """2 under a full inventory, otherwise 1: the rank of a species that is not recorded."""
    return F.when(full_inventory, 2).otherwise(1)


def merge_records(df: DataFrame, op: str, species: str, count: str, rank: Column, op_cols: Sequence[str] = ()) -> DataFrame:
    """One row per operation and species: counts summed, and the record of highest protocol as ``__of``.

    ``__of`` holds the rank and ``op_cols``. Of records of equal rank the greatest
    attributes count, so the choice does not depend on the order of the rows.
    """
    of = F.max(F.struct(rank.alias("__rank"), *op_cols)).alias("__of")
    return df.groupBy(op, species).agg(sum_or_zero(F.col(count).cast("double")).alias(count), of)


# -- the species dictionary --------------------------------------------------------


@dataclass(frozen=True)
class Dictionary:
    """Species numbered without gaps.

    ``codes`` has one row per species with its block and its bit there, ``blocks`` one
    row per block with its species in order of their bits, and whatever else is known
    about them. Blocks are numbered from 0, and ``last`` is the number of the last.
    """

    codes: DataFrame
    blocks: DataFrame
    last: Column


def dictionary(vocabulary: DataFrame, species: str, names: DataFrame | None = None, name_cols: Sequence[str] = (), *, width: int = WIDTH) -> Dictionary:
    """Number a vocabulary; ``names`` gives further columns of a species (one row each)."""
    listed = vocabulary.select(species).where(F.col(species).isNotNull()).distinct()
    if names is not None:
        listed = listed.join(names.select(species, *name_cols), species, "left")
    rows = numbered(listed, [species], "__no")
    rows = rows.withColumns({"__block": F.floor(F.col("__no") / width).cast("int"), "__bit": (F.col("__no") % width).cast("int")})
    entry = F.struct("__bit", F.col(species).alias("sp"), *name_cols)
    blocks = rows.groupBy("__block").agg(F.sort_array(F.collect_list(entry)).alias("__species"))
    return Dictionary(rows.select(species, "__block", "__bit"), blocks, rows.agg(F.max("__block")).scalar())


def bit(condition: Column) -> Column:
    """The word in which a record sets its species' bit, if the condition holds."""
    return F.when(condition, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bit"))).otherwise(F.lit(0).cast("long"))


def by_block(blocks: DataFrame, keys: Sequence[str], held: str, *aggs: Column) -> DataFrame:
    """One row per key with ``held`` of each of its blocks as a map."""
    entries = F.map_from_entries(F.collect_list(F.struct("__block", held)))
    return blocks.groupBy(*keys).agg(entries.alias("__held"), *aggs)


def expand(rows: DataFrame, words: Dictionary) -> DataFrame:
    """Each row once for every block, with the block's species and what the row holds there.

    The blocks are joined by their number. Spark broadcasts them while they are small;
    once they are not there are thousands, and every row meets each, so the shuffle is even.
    """
    every = rows.withColumn("__block", F.explode(F.sequence(F.lit(0), words.last)))
    return every.withColumn("__held", F.col("__held")[F.col("__block")]).join(words.blocks, "__block")


def absences(
    df: DataFrame,
    op: str,
    species: str,
    count: str,
    vocabulary: DataFrame,
    op_cols: Sequence[str] = (),
    *,
    width: int = WIDTH,
) -> DataFrame:
    """Every (operation, species) pair without individuals, with count 0.

    That is a pair recorded with count 0 or not recorded at all; a pair with a
    missing count is neither present nor absent. Operations that record no species
    of the vocabulary do not appear. An operation's attributes are those of one of its
    records, the greatest. What an operation holds is gathered as bits of numbered
    species; their complement is exploded, so no pair is generated that is not in the
    result.
    """
    words = dictionary(vocabulary, species, width=width)
    known = df.join(words.codes, species)
    of = F.max(F.struct(F.lit(0).alias("__rank"), *op_cols)).alias("__of")
    held = known.groupBy(op, "__block").agg(F.bit_or(bit(F.col(count).isNull() | (F.col(count) != 0))).alias("__bits"), of)
    per_op = by_block(held, [op], "__bits", F.max("__of").alias("__of"))
    bits = F.coalesce("__held", F.lit(0).cast("long"))
    gone = F.filter("__species", lambda e: F.getbit(bits, e["__bit"]) == 0)
    out = expand(per_op, words).select(op, *[F.col("__of")[c].alias(c) for c in op_cols], F.explode(gone).alias("__e"))
    return out.select(op, *op_cols, F.col("__e.sp").alias(species), F.lit(0.0).alias(count))


def point_table(
    df: DataFrame,
    op: str,
    species: str,
    count: str,
    protocol: str,
    inventory_pattern: str,
    op_cols: Sequence[str] = (),
    vocabulary: DataFrame | None = None,
    names: DataFrame | None = None,
    name_col: str | None = None,
    *,
    width: int = WIDTH,
) -> DataFrame:
    """Presences and absences of every operation, with status, rank and common name.

    Records of one operation and species are merged first. An operation with several
    protocols counts by the highest, whose attributes it takes. ``vocabulary`` holds the
    species with a positive total; it is derived from ``df`` if not given, which
    reads ``df`` once more. Names travel with the dictionary.
    """
    attrs = list(dict.fromkeys([*op_cols, protocol]))
    merged = merge_records(df, op, species, count, protocol_rank(S.pattern_flag(protocol, inventory_pattern)), attrs)
    if vocabulary is None:
        vocabulary = species_ever_present(merged, species, count)
    named = [name_col] if name_col is not None else []
    words = dictionary(vocabulary, species, names, named, width=width)
    known = merged.join(words.codes, species)
    number = F.col("__block") * width + F.col("__bit")
    caught = F.map_from_entries(F.collect_list(F.when(F.col(count) > 0, F.struct(number.alias("no"), F.col(count).alias("n")))))
    per_op = known.groupBy(op).agg(caught.alias("__caught"), F.max("__of").alias("__of"))
    every = per_op.withColumn("__block", F.explode(F.sequence(F.lit(0), words.last)))
    # of an operation's species only those of the block, so that a look-up does not grow with the vocabulary
    first = F.col("__block") * width
    every = every.withColumn("__held", F.map_filter("__caught", lambda no, n: (no >= first) & (no < first + width)))
    each = words.blocks.select("__block", F.inline("__species"))
    both = every.join(each, "__block").select(op, "__of", "sp", *named, F.col("__held")[first + F.col("__bit")].alias("n"))
    rank = F.when(F.col("n").isNotNull(), 3).otherwise(F.col("__of.__rank"))
    out = both.select(
        op, *[F.col("__of")[c].alias(c) for c in attrs], F.col("sp").alias(species), F.coalesce("n", F.lit(0.0)).alias(count), rank.alias("rang"), *named
    )
    label = S.level_label("rang", STATUS_LEVELS).alias("statut")
    return out.select(op, *attrs, species, count, "rang", label, *named)


def status_by(
    df: DataFrame,
    keys: Sequence[str],
    species: str,
    count: str,
    full_inventory: Column,
    vocabulary: DataFrame,
    *,
    width: int = WIDTH,
) -> DataFrame:
    """Highest status of each species by key, straight from the captures.

    A species is present where one of the key's operations holds it, otherwise
    absent if one of them was a full inventory. That is the maximum over the point
    table without building it: one row per key and species instead of one per
    operation and species.
    """
    words = dictionary(vocabulary, species, width=width)
    known = df.join(words.codes, species).withColumn("__rank", protocol_rank(full_inventory))
    blocks = known.groupBy(*keys, "__block").agg(F.bit_or(bit(F.coalesce(F.col(count) > 0, F.lit(False)))).alias("__bits"), F.max("__rank").alias("__rank"))
    grouped = by_block(blocks, keys, "__bits", F.max("__rank").alias("__rank"))
    bits = F.coalesce("__held", F.lit(0).cast("long"))
    each = F.transform("__species", lambda e: F.struct(e["sp"].alias("sp"), F.getbit(bits, e["__bit"]).alias("hit")))
    both = expand(grouped, words).select(*keys, "__rank", F.inline(each))
    out = both.select(*keys, F.col("sp").alias(species), F.when(F.col("hit") == 1, 3).otherwise(F.col("__rank")).alias("rang"))
    return out.withColumn("statut", S.level_label("rang", STATUS_LEVELS))


def status_of(
    df: DataFrame, keys: Sequence[str], species: str, count: str, full_inventory: Column, vocabulary: DataFrame, code: str
) -> DataFrame:
    """Highest status of one species by key: one conditional aggregation, nothing expanded.

    The same as the species' rows of :func:`status_by`.
    """
    listed = vocabulary.select(species).distinct()
    known = df.join(listed, species, "left_semi")
    hit = (F.col(species) == code) & (F.col(count) > 0)
    top = known.groupBy(*keys).agg(F.max(F.when(hit, 3).otherwise(protocol_rank(full_inventory))).alias("rang"))
    top = top.where(listed.agg(F.max(F.col(species) == code)).scalar())
    return top.select(*keys, F.lit(code).alias(species), "rang", S.level_label("rang", STATUS_LEVELS).alias("statut"))


def highest_status(df: DataFrame, keys: Sequence[str], status: str = "statut", levels: Sequence[str] = STATUS_LEVELS) -> DataFrame:
    """Highest ordered label by key; a missing or unlisted label makes it missing."""
    rank = S.level_rank(status, levels)
    top = F.when(F.count(rank) == F.count(F.lit(1)), F.max(rank))
    return df.groupBy(*keys).agg(top.alias("rang")).withColumn(status, S.level_label("rang", levels))


def presence_flag(df: DataFrame, keys: Sequence[str], status: str = "statut", out: str = "presence") -> DataFrame:
    """0/1 presence by key, records without detection left out."""
    hit = F.when(F.col(status) == STATUS_LEVELS[2], 1).otherwise(0)
    return df.where(F.col(status) != STATUS_LEVELS[0]).groupBy(*keys).agg(F.max(hit).alias(out))


def status_map(
    places: DataFrame,
    facts: DataFrame,
    place: str,
    species: str,
    code: str,
    status: str = "statut",
    extra_keys: Sequence[str] = (),
) -> DataFrame:
    """Status of one species at every place; places without data are "not surveyed"."""
    one = highest_status(facts.where(F.col(species) == code), [place, *extra_keys], status)
    return all_places(places, one.drop("rang"), [place], {status: NOT_SURVEYED})


def basin_card(
    df: DataFrame, basins: DataFrame, basin: str, station: str, species: str, count: str, code: str, digits: int = 0
) -> DataFrame:
    """Per basin: individuals, stations and shares of one species, with a three-state presence.

    One conditional aggregation per station, then one per basin: no distinct count is
    left and nothing has to be joined back.
    """
    is_sp = F.col(species) == code
    per_station = df.groupBy(basin, station).agg(
        sum_or_zero(count).alias("__n"),
        sum_or_zero(F.when(is_sp, F.col(count))).alias("__n_sp"),
        F.max(is_sp).alias("__seen"),
        F.max(is_sp & (F.col(count) > 0)).alias("__caught"),
    )
    facts = per_station.groupBy(basin).agg(
        F.sum("__n").alias("n_indiv"),
        F.when(F.max("__seen"), F.sum("__n_sp")).alias("n_indiv_sp"),
        F.count(F.lit(1)).alias("n_stations"),
        F.when(F.max("__caught"), F.count_if("__caught")).alias("n_stations_presence"),
    )
    out = basins.join(facts, basin, "left")
    zero = F.lit(0)
    with_fish = F.col("n_indiv") > 0

    def or_zero(c: Column) -> Column:
        return F.when(with_fish & c.isNull(), zero).otherwise(c)

    share_st = ratio("n_stations_presence", "n_stations")
    share_in = ratio("n_indiv_sp", "n_indiv")
    return out.select(
        *basins.columns,
        "n_indiv",
        or_zero(F.col("n_indiv_sp")).alias("n_indiv_sp"),
        "n_stations",
        or_zero(F.col("n_stations_presence")).alias("n_stations_presence"),
        S.percent_text(or_zero(share_st), digits).alias("pourcent_stations_presence_mini_une_fois"),
        S.percent_text(share_in, digits).alias("pourcent_indiv_captures"),
        S.presence_state(or_zero(F.col("n_indiv_sp"))).alias("presence"),
    )


def station_card(
    df: DataFrame,
    stations: DataFrame,
    station: str,
    when: str,
    species: str,
    count: str,
    code: str,
    n_ops: str | None = None,
    digits: int = 0,
) -> DataFrame:
    """Per station: operations, operations recording the species, individuals, shares, presence.

    Operations recording the species include records with count 0, unlike the
    basin card. ``n_ops`` names a column of ``stations`` with the number of
    operations; without it they are counted as distinct dates.
    """
    is_sp = F.col(species) == code
    per_date = df.groupBy(station, when).agg(
        sum_or_zero(count).alias("__n"),
        F.sum(F.when(is_sp & (F.col(count) > 0), F.col(count))).alias("__n_sp"),
        F.max(is_sp).alias("__seen"),
    )
    aggs = [
        F.when(F.max("__seen"), F.count_if("__seen")).alias("n_peches_sp_presente"),
        F.sum("__n").alias("n_indiv_captures"),
        F.sum("__n_sp").alias("n_indiv_captures_sp"),
    ]
    if n_ops is None:
        aggs.insert(0, F.count(F.lit(1)).alias("n_peches"))
    facts = per_date.groupBy(station).agg(*aggs)
    out = stations.join(facts, station, "left")
    if n_ops is not None:
        out = out.withColumnRenamed(n_ops, "n_peches")
    fished = F.col("n_peches") > 0

    def or_zero(c: Column) -> Column:
        return F.when(fished & c.isNull(), F.lit(0)).otherwise(c)

    return out.select(
        *[c for c in stations.columns if c != n_ops],
        "n_peches",
        or_zero(F.col("n_peches_sp_presente")).alias("n_peches_sp_presente"),
        "n_indiv_captures",
        or_zero(F.col("n_indiv_captures_sp")).alias("n_indiv_captures_sp"),
        S.percent_text(or_zero(ratio("n_indiv_captures_sp", "n_indiv_captures")), digits).alias("pourcent_indiv_sp"),
        S.percent_text(or_zero(ratio("n_peches_sp_presente", "n_peches")), digits).alias("pourcent_peches_sp_presente"),
        S.presence_state(or_zero(F.col("n_indiv_captures_sp"))).alias("presence"),
    )


def absent_everywhere(df: DataFrame, species: str, count: str, codes: DataFrame) -> DataFrame:
    """Listed species without a positive total, with the message shown instead of a card."""
    totals = df.groupBy(species).agg(sum_or_zero(count).alias("__n")).where(F.col("__n") > 0)
    gone = codes.select(species).distinct().join(totals, species, "left_anti")
    return gone.withColumn("message", F.concat(F.col(species), F.lit(" : " + ABSENT_EVERYWHERE)))


def occurrence_rates(
    df: DataFrame, units: Mapping[str, Sequence[str]], species: str, code: str, digits: int = 2, unit: str = "unite"
) -> DataFrame:
    """For each named unit (a combination of keys): how many hold the species, how many
    there are, and the share.

    The rows are reduced to one per combination of all keys first; only those are
    repeated, once for each unit.
    """
    every = list(dict.fromkeys(k for keys in units.values() for k in keys))
    hit = F.when(F.col(species) == code, 1).otherwise(0)
    df = df.groupBy(*every).agg(F.max(hit).alias("__hit"))
    keyed = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("u"), F.array(*[F.col(k).cast("string") for k in keys]).alias("k"))
                for name, keys in units.items()
            ]
        )
    )
    per_key = df.select(keyed.alias("__x"), "__hit").groupBy("__x").agg(F.max("__hit").alias("__hit"))
    totals = per_key.groupBy(F.col("__x.u").alias(unit)).agg(
        F.sum("__hit").cast("bigint").alias("n_presence"), F.count(F.lit(1)).alias("n_total")
    )
    return totals.withColumn("pourcentage", S.signif_percent_text(ratio("n_presence", "n_total"), digits))


def individual_share(df: DataFrame, species: str, count: str, code: str, digits: int = 2) -> DataFrame:
    """Individuals of the species, all individuals, and the share."""
    totals = df.agg(
        sum_or_zero(F.when(F.col(species) == code, F.col(count))).alias("n_indiv_sp"),
        sum_or_zero(count).alias("n_indiv_total"),
    )
    return totals.withColumn("pourcentage", S.signif_percent_text(ratio("n_indiv_sp", "n_indiv_total"), digits))


def occurrence_by_basin(df: DataFrame, basin: str, species: str, code: str) -> DataFrame:
    """Records per basin for one species, with the presence label."""
    n = df.where(F.col(species) == code).groupBy(basin).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("presence", S.two_way(F.col("n") > 0, "Présence", "Absence"))


def unsurveyed(places: DataFrame, df: DataFrame, place: str) -> DataFrame:
    """Places without any operation."""
    return places.join(df.select(place).distinct(), place, "left_anti")


def red_list(
    taxa: DataFrame,
    national: DataFrame,
    regional: DataFrame,
    species: str,
    national_col: str,
    regional_col: str,
    extra_regional: Sequence[tuple[str, str]],
    labels: Mapping[str, str],
) -> DataFrame:
    """Taxonomy with national and regional status, codes spelled out.

    ``extra_regional`` lists (species, status) rows added to the regional list.
    """
    regional = regional.select(species, regional_col)
    if extra_regional:
        extra = F.explode(F.array(*[F.struct(F.lit(a), F.lit(b)) for a, b in extra_regional])).alias("__e")
        rows = regional.sparkSession.range(1).select(extra)
        regional = regional.unionByName(
            rows.select(F.col("__e.col1").alias(species), F.col("__e.col2").alias(regional_col))
        )
    out = lookup(lookup(taxa, national, [species], [national_col]), regional, [species], [regional_col])
    return out.withColumns({c: S.recode(c, labels) for c in (national_col, regional_col)})


def trend_labels(
    df: DataFrame, code: str, rate: str, place_key: str, labels: Mapping[str, str] = TREND_LABELS, digits: int = 3
) -> DataFrame:
    """Trend codes to ordered labels with their rank, rate rounded, rows without a place dropped."""
    kept = df.where(F.col(place_key).isNotNull())
    label = S.case_label(code, labels)
    return kept.withColumns(
        {rate: S.round_even(rate, digits), "rang": S.level_rank(label, list(labels.values())), code: label}
    )
