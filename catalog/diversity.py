"""Presence and absence, species cards, diversity indices, richness estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.standins import CAP, INVENTORY, captures, lots, operations, point_x, point_y, r, table
from creel.functions import scalars as S
from creel.operators import diversity as D, estimators as EST, presence as PR
from creel.operators.grouping import latest_with_ties, sum_by
from creel.operators.prepare import distinct_values

# a third of the species plays "count missing or zero" so that no rule is idle
ZERO = f"""WITH {CAP}, z AS (SELECT * REPLACE (CASE WHEN code_espece = 'Brand#9' THEN 0 WHEN effectif = 7 THEN 0 ELSE effectif END AS effectif) FROM cap)"""
_ATTRS = ["code_station", "annee", "type_peche"]


def zeroed(spark, sf, basin=False):
    d = captures(spark, sf, basin)
    zero = (F.col("code_espece") == "Brand#9") | (F.col("effectif") == 7)
    return d.withColumn("effectif", F.when(zero, 0.0).otherwise(F.col("effectif")))


def vocabulary(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("code_espece")).distinct()


# -- presence and absence -------------------------------------------------------------


@query(
    "pa_species_ever",
    f"""{ZERO} SELECT code_espece FROM z GROUP BY 1
        HAVING count(CASE WHEN code_espece = 'Brand#8' AND effectif = 8 THEN NULL ELSE effectif END) = count(*) AND sum(effectif) > 0""",
)
def pa_species_ever(spark, sf):
    holed = F.when((F.col("code_espece") == "Brand#8") & (F.col("effectif") == 8), None).otherwise(F.col("effectif"))
    return PR.species_ever_present(zeroed(spark, sf).withColumn("effectif", holed), "code_espece", "effectif")


@query(
    "pa_presence",
    f"{ZERO} SELECT DISTINCT ope_id, code_station, code_espece, effectif, 'Présent' AS statut FROM z WHERE effectif > 0",
)
def pa_presence(spark, sf):
    d = zeroed(spark, sf).select("ope_id", "code_station", "code_espece", "effectif")
    return PR.presences(d, "code_espece", "effectif")


_ABSENT = """a AS (
  SELECT o.ope_id, o.code_station, o.annee, o.type_peche, v.code_espece, 0.0::DOUBLE AS effectif
  FROM (SELECT DISTINCT ope_id, code_station, annee, type_peche FROM {src}) o CROSS JOIN {vocab} v
  WHERE NOT EXISTS (SELECT 1 FROM {src} c WHERE c.ope_id = o.ope_id AND c.code_espece = v.code_espece))"""


@query(
    "pa_absences",
    f"""WITH {CAP}, v AS (SELECT DISTINCT p_brand AS code_espece FROM part), {_ABSENT.format(src='cap', vocab='v')}
        SELECT ope_id, code_station, annee, type_peche, code_espece, effectif FROM a""",
)
def pa_absences(spark, sf):
    return PR.absences(captures(spark, sf, basin=False), "ope_id", "code_espece", "effectif", vocabulary(spark, sf), _ATTRS)


@query(
    "pa_status",
    f"""SELECT o_orderkey AS ope_id, CASE WHEN regexp_matches(nullif(o_orderpriority, '2-HIGH'), '{INVENTORY}') THEN 'Absent' ELSE 'Non détecté' END AS statut FROM orders""",
)
def pa_status(spark, sf):
    flag = S.pattern_flag(S.null_if("type_peche", "2-HIGH"), INVENTORY)
    return operations(spark, sf, basin=False).select("ope_id", PR.protocol_status(flag).alias("statut"))


_POINT = f"""{ZERO}, zm AS (SELECT ope_id, code_station, annee, type_peche, code_espece, sum(effectif) AS effectif FROM z GROUP BY ALL),
  k AS (SELECT code_espece FROM zm GROUP BY 1 HAVING sum(effectif) > 0),
  zk AS (SELECT * FROM zm WHERE code_espece IN (SELECT code_espece FROM k)),
  {_ABSENT.format(src='zk', vocab='k')},
  pt AS (
    SELECT DISTINCT ope_id, code_station, annee, type_peche, code_espece, effectif, 'Présent' AS statut FROM zk WHERE effectif > 0
    UNION ALL
    SELECT ope_id, code_station, annee, type_peche, code_espece, effectif,
           CASE WHEN regexp_matches(type_peche, '{INVENTORY}') THEN 'Absent' ELSE 'Non détecté' END
    FROM (SELECT ope_id, code_station, annee, type_peche, code_espece, effectif FROM a
          UNION ALL SELECT ope_id, code_station, annee, type_peche, code_espece, effectif FROM zk WHERE effectif = 0)),
  ptr AS (SELECT *, CAST(CASE statut WHEN 'Présent' THEN 3 WHEN 'Absent' THEN 2 ELSE 1 END AS INTEGER) AS rang FROM pt)"""


def present_species(spark, sf):
    """Species with a positive total; the operations are not needed to tell."""
    zero = (F.col("code_espece") == "Brand#9") | (F.col("effectif") == 7)
    return PR.species_ever_present(lots(spark, sf).withColumn("effectif", F.when(zero, 0.0).otherwise(F.col("effectif"))), "code_espece", "effectif")


@query(
    "pa_point_table",
    _POINT + """ SELECT ope_id, code_station, annee, type_peche, code_espece, effectif, statut, rang,
                        'Poisson ' || lower(code_espece) AS esp_nom_commun FROM ptr""",
)
def pa_point_table(spark, sf):
    names = vocabulary(spark, sf).withColumn("esp_nom_commun", F.concat(F.lit("Poisson "), F.lower("code_espece")))
    return PR.point_table(
        zeroed(spark, sf), "ope_id", "code_espece", "effectif", "type_peche", INVENTORY, _ATTRS,
        present_species(spark, sf), names, "esp_nom_commun",
    )


_LABEL = "CASE max(rang) WHEN 3 THEN 'Présent' WHEN 2 THEN 'Absent' ELSE 'Non détecté' END"


@query(
    "pa_basin_status",
    _POINT + f""" SELECT c_nationkey AS code_exutoire, code_espece, annee, max(rang) AS rang, {_LABEL} AS statut
                  FROM ptr JOIN customer ON code_station = c_custkey GROUP BY 1, 2, 3""",
)
def pa_basin_status(spark, sf):
    d = zeroed(spark, sf, basin=True)
    full = S.pattern_flag("type_peche", INVENTORY)
    return PR.status_by(d, ["code_exutoire", "annee"], "code_espece", "effectif", full, present_species(spark, sf))


@query(
    "pa_status_map",
    _POINT + f""", f AS (SELECT code_station, {_LABEL} AS statut FROM ptr WHERE code_espece = 'Brand#12' GROUP BY 1)
        SELECT c_custkey AS code_station, coalesce(statut, 'Non prospecté') AS statut FROM customer LEFT JOIN f ON c_custkey = code_station""",
)
def pa_status_map(spark, sf):
    places = table(spark, sf, "customer").select(F.col("c_custkey").alias("code_station"))
    full = S.pattern_flag("type_peche", INVENTORY)
    facts = PR.status_of(zeroed(spark, sf), ["code_station"], "code_espece", "effectif", full, present_species(spark, sf), "Brand#12")
    return PR.status_map(places, facts, "code_station", "code_espece", "Brand#12")


def _pct(a: str, b: str) -> str:
    return f"CAST(CAST(round_even(100.0 * ({a} / {b}), 0) AS DECIMAL(18,0)) AS VARCHAR) || '%'"


@query(
    "pa_species_bv_card",
    f"""{ZERO}, y AS (SELECT * FROM z WHERE NOT (code_exutoire = 4 AND code_espece = 'Brand#12') AND code_exutoire <> 5),
        f AS (SELECT code_exutoire, sum(effectif) AS n_indiv, sum(effectif) FILTER (WHERE code_espece = 'Brand#12') AS sp,
                     count(DISTINCT code_station) AS n_stations,
                     nullif(count(DISTINCT code_station) FILTER (WHERE code_espece = 'Brand#12' AND effectif > 0), 0) AS st FROM y GROUP BY 1)
        SELECT n_nationkey AS code_exutoire, n_name AS toponyme, n_indiv,
               CASE WHEN n_indiv > 0 AND sp IS NULL THEN 0 ELSE sp END AS n_indiv_sp, n_stations,
               CASE WHEN n_indiv > 0 AND st IS NULL THEN 0 ELSE st END AS n_stations_presence,
               {_pct('CASE WHEN n_indiv > 0 AND st IS NULL THEN 0 ELSE st END', 'n_stations')} AS pourcent_stations_presence_mini_une_fois,
               {_pct('sp', 'n_indiv')} AS pourcent_indiv_captures,
               CASE WHEN n_indiv > 0 AND coalesce(sp, 0) = 0 THEN 'Absence' WHEN sp > 0 THEN 'Présence' END AS presence
        FROM nation LEFT JOIN f ON n_nationkey = code_exutoire""",
)
def pa_species_bv_card(spark, sf):
    d = zeroed(spark, sf, basin=True).where("NOT (code_exutoire = 4 AND code_espece = 'Brand#12') AND code_exutoire <> 5")
    basins = table(spark, sf, "nation").select(F.col("n_nationkey").alias("code_exutoire"), F.col("n_name").alias("toponyme"))
    return PR.basin_card(d, basins, "code_exutoire", "code_station", "code_espece", "effectif", "Brand#12")


@query(
    "pa_species_station_card",
    f"""{ZERO}, f AS (SELECT code_station, sum(effectif) AS n_indiv_captures,
                     count(DISTINCT date_peche) FILTER (WHERE code_espece = 'Brand#12') AS pe,
                     sum(effectif) FILTER (WHERE code_espece = 'Brand#12' AND effectif > 0) AS sp FROM z GROUP BY 1),
        o AS (SELECT o_custkey, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_peches FROM orders GROUP BY 1),
        g AS (SELECT c_custkey AS code_station, n_peches, CASE WHEN n_peches > 0 THEN coalesce(pe, 0) ELSE pe END AS pe, n_indiv_captures,
                     CASE WHEN n_peches > 0 THEN coalesce(sp, 0) ELSE sp END AS sp
              FROM customer LEFT JOIN o ON c_custkey = o_custkey LEFT JOIN f ON c_custkey = code_station)
        SELECT code_station, n_peches, pe AS n_peches_sp_presente, n_indiv_captures, sp AS n_indiv_captures_sp,
               {_pct("(CASE WHEN n_peches > 0 THEN coalesce(sp / n_indiv_captures, 0) ELSE sp / n_indiv_captures END)", '1')} AS pourcent_indiv_sp,
               {_pct('pe', 'n_peches')} AS pourcent_peches_sp_presente,
               CASE WHEN sp > 0 THEN 'Présence' WHEN sp = 0 THEN 'Absence' END AS presence FROM g""",
)
def pa_species_station_card(spark, sf):
    n_ops = operations(spark, sf, basin=False).groupBy("code_station").agg(F.count_distinct("date_peche").alias("n_ope"))
    stations = table(spark, sf, "customer").select(F.col("c_custkey").alias("code_station")).join(n_ops, "code_station", "left")
    return PR.station_card(
        zeroed(spark, sf), stations, "code_station", "date_peche", "code_espece", "effectif", "Brand#12", n_ops="n_ope"
    )


@query(
    "pa_species_absent_everywhere",
    f"""{ZERO} SELECT p_brand AS code_espece, p_brand || ' : Espèce absente du périmètre de l''étude' AS message
        FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand NOT IN (SELECT code_espece FROM z GROUP BY 1 HAVING sum(effectif) > 0)""",
)
def pa_species_absent_everywhere(spark, sf):
    d = lots(spark, sf)
    zero = (F.col("code_espece") == "Brand#9") | (F.col("effectif") == 7)
    d = d.withColumn("effectif", F.when(zero, 0.0).otherwise(F.col("effectif")))
    return PR.absent_everywhere(d, "code_espece", "effectif", vocabulary(spark, sf))


@query(
    "pa_occurrence_by_basin",
    f"WITH {CAP} SELECT code_exutoire, count(*) AS n, 'Présence' AS presence FROM cap WHERE code_espece = 'Brand#12' GROUP BY 1",
)
def pa_occurrence_by_basin(spark, sf):
    return PR.occurrence_by_basin(captures(spark, sf), "code_exutoire", "code_espece", "Brand#12")


@query(
    "pa_unsurveyed_basins",
    """SELECT c_custkey AS code_exutoire, c_name AS toponyme FROM customer
       WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def pa_unsurveyed_basins(spark, sf):
    places = table(spark, sf, "customer").select(F.col("c_custkey").alias("code_exutoire"), F.col("c_name").alias("toponyme"))
    ops = operations(spark, sf, basin=False).where("type_peche = '1-URGENT'").select(F.col("code_station").alias("code_exutoire"))
    return PR.unsurveyed(places, ops, "code_exutoire")


_LIST = {"LC": "Préoccupation mineure", "NT": "Quasi menacée", "VU": "Vulnérable"}


@query(
    "pa_red_list",
    """WITH nat AS (SELECT p_brand, CASE max(p_size) % 3 WHEN 0 THEN 'LC' WHEN 1 THEN 'NT' ELSE 'VU' END AS s FROM part GROUP BY 1),
       reg AS (SELECT p_brand, CASE min(p_partkey) % 2 WHEN 0 THEN 'LC' ELSE 'DD' END AS s FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') GROUP BY 1
               UNION ALL SELECT 'Brand#1', 'VU')
       SELECT t.p_brand AS code_espece,
              CASE nat.s WHEN 'LC' THEN 'Préoccupation mineure' WHEN 'NT' THEN 'Quasi menacée' WHEN 'VU' THEN 'Vulnérable' ELSE nat.s END AS lr_nationale,
              CASE reg.s WHEN 'LC' THEN 'Préoccupation mineure' WHEN 'NT' THEN 'Quasi menacée' WHEN 'VU' THEN 'Vulnérable' ELSE reg.s END AS lr_regionale
       FROM (SELECT DISTINCT p_brand FROM part) t LEFT JOIN nat ON t.p_brand = nat.p_brand LEFT JOIN reg ON t.p_brand = reg.p_brand""",
)
def pa_red_list(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_brand", "code_espece")
    code = {0: "LC", 1: "NT", 2: "VU"}
    nat = p.groupBy("code_espece").agg(S.case_label(F.max("p_size") % 3, code).alias("lr_nationale"))
    reg = p.where("code_espece NOT IN ('Brand#1', 'Brand#2')").groupBy("code_espece")
    reg = reg.agg(S.case_label(F.min("p_partkey") % 2, {0: "LC", 1: "DD"}).alias("lr_regionale"))
    taxa = distinct_values(p, "code_espece")
    return PR.red_list(taxa, nat, reg, "code_espece", "lr_nationale", "lr_regionale", [("Brand#1", "VU")], _LIST)


@query(
    "pa_trend_labels",
    """SELECT o_orderkey AS pop_id, nullif(o_custkey % 10, 3) AS code_coords, round_even(o_totalprice / 7000, 3) AS taux,
              CASE o_orderpriority WHEN '1-URGENT' THEN 'Hausse' WHEN '2-HIGH' THEN 'Stable / hausse' WHEN '3-MEDIUM' THEN 'Stable' WHEN '5-LOW' THEN 'Baisse' END AS tendance,
              CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 5 END AS INTEGER) AS rang
       FROM orders WHERE o_custkey % 10 <> 3""",
)
def pa_trend_labels(spark, sf):
    codes = {"1-URGENT": "H", "2-HIGH": "Sh", "3-MEDIUM": "S", "5-LOW": "B"}
    d = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pop_id"),
        S.null_if(F.col("o_custkey") % 10, 3).alias("code_coords"),
        (F.col("o_totalprice") / 7000).alias("taux"),
        S.case_label("o_orderpriority", codes).alias("tendance"),
    )
    return PR.trend_labels(d, "tendance", "taux", "code_coords")


# -- diversity -------------------------------------------------------------------------


def _indices_sql(source: str, site: str, extra: str = "") -> str:
    """Indices from a relation (site, sp, n) of summed counts, written over proportions."""
    return f"""p AS (SELECT {site}, code_espece, n, n / sum(n) OVER (PARTITION BY {site}) AS q FROM {source} WHERE n > 0),
      ind AS (SELECT {site}, count(*) AS richesse, CASE WHEN count(*) = 1 THEN 0 ELSE -sum(q * ln(q)) END AS shannon,
                     CASE WHEN count(*) = 1 THEN 0 ELSE (pow(sum(n), 2) - sum(n * n)) / pow(sum(n), 2) END AS simpson FROM p GROUP BY {site}),
      indices AS (SELECT {site}, richesse, shannon, simpson, CASE WHEN richesse > 1 THEN shannon / ln(richesse) END AS pielou FROM ind){extra}"""


# Simpson is a ratio of whole numbers, equal in both engines without rounding
_OUT = "richesse, round(shannon, 6) AS shannon, simpson, round(pielou, 6) AS pielou"
_BY_OPE = "s AS (SELECT ope_id, code_espece, sum(effectif) AS n FROM cap GROUP BY 1, 2)"


def rounded(df, *keys):
    return df.select(*keys, "richesse", r("shannon"), "simpson", r("pielou"))


@query("div_indices_site", f"WITH {CAP}, {_BY_OPE}, {_indices_sql('s', 'ope_id')} SELECT ope_id, {_OUT} FROM indices")
def div_indices_site(spark, sf):
    return rounded(D.indices(lots(spark, sf), "ope_id", "code_espece", "effectif"), "ope_id")


@query(
    "div_indices_presence",
    f"""WITH {CAP}, s AS (SELECT DISTINCT code_station, code_espece, 1.0::DOUBLE AS n FROM cap), {_indices_sql('s', 'code_station')}
        SELECT code_station, {_OUT} FROM indices""",
)
def div_indices_presence(spark, sf):
    return rounded(D.indices_presence(captures(spark, sf, basin=False), "code_station", "code_espece"), "code_station")


@query(
    "div_indices_missing_cells",
    f"""WITH {CAP}, s AS (SELECT code_exutoire, annee, code_espece, sum(effectif) AS n FROM cap GROUP BY ALL), {_indices_sql('s', 'code_exutoire, annee')},
        c AS (SELECT code_exutoire, annee, count(*) = (SELECT count(DISTINCT p_brand) FROM part) AS full_ FROM s GROUP BY ALL)
        SELECT i.code_exutoire, i.annee, richesse, CASE WHEN full_ THEN round(shannon, 6) END AS shannon, CASE WHEN full_ THEN round(simpson, 6) END AS simpson,
               CASE WHEN full_ THEN round(pielou, 6) END AS pielou FROM indices i JOIN c ON i.code_exutoire = c.code_exutoire AND i.annee = c.annee""",
)
def div_indices_missing_cells(spark, sf):
    """As from a wide matrix without a fill value: a site that lacks a species has a richness only."""
    d = captures(spark, sf, by_operation=True)
    out = D.indices(d, ["code_exutoire", "annee"], "code_espece", "effectif", holes="missing", vocabulary=vocabulary(spark, sf))
    return out.select("code_exutoire", "annee", "richesse", r("shannon"), r("simpson"), r("pielou"))


@query(
    "div_indices_bv",
    f"""WITH {CAP}, s AS (SELECT code_exutoire, code_espece, sum(effectif) AS n FROM cap WHERE type_peche NOT IN ('4-NOT SPECIFIED', '5-LOW') GROUP BY 1, 2),
        {_indices_sql('s', 'code_exutoire')} SELECT code_exutoire, {_OUT} FROM indices""",
)
def div_indices_bv(spark, sf):
    ops = operations(spark, sf).where("type_peche NOT IN ('4-NOT SPECIFIED', '5-LOW')").select("ope_id", "code_exutoire")
    d = lots(spark, sf).join(ops, "ope_id")
    return rounded(D.indices(d, "code_exutoire", "code_espece", "effectif"), "code_exutoire")


_LAST_PT = """dern AS (SELECT o_orderkey AS ope_id, o_custkey AS code_station, CAST(o_orderdate AS DATE) AS date_peche, i.* EXCLUDE (ope_id)
    FROM indices i JOIN orders ON i.ope_id = o_orderkey
    QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC) = 1)"""


def latest_indices(spark, sf):
    ops = operations(spark, sf, basin=False)
    return D.latest_per_point(lots(spark, sf), ops, "ope_id", "code_station", "date_peche", "code_espece", "effectif")


@query(
    "div_latest_per_point",
    f"""WITH {CAP}, {_BY_OPE}, {_indices_sql('s', 'ope_id')}, {_LAST_PT}
        SELECT ope_id, code_station, 'richesse' AS name, CAST(richesse AS DOUBLE) AS value FROM dern
        UNION ALL SELECT ope_id, code_station, 'shannon', round(shannon, 6) FROM dern
        UNION ALL SELECT ope_id, code_station, 'simpson', simpson FROM dern
        UNION ALL SELECT ope_id, code_station, 'pielou', round(pielou, 6) FROM dern""",
)
def div_latest_per_point(spark, sf):
    return D.indices_long(rounded(latest_indices(spark, sf), "ope_id", "code_station"), ["ope_id", "code_station"])


@query(
    "div_model_table",
    f"""WITH {CAP}, {_BY_OPE}, {_indices_sql('s', 'ope_id')}, {_LAST_PT}
        SELECT code_station AS pop_id, ope_id, c_acctbal AS altitude, round(((c_custkey * 37) % 1009) / 100.0, 6) AS x_wgs84,
               round(((c_custkey * 53) % 997) / 90.0, 6) AS y_wgs84, c_nationkey AS code_exutoire, {_OUT}
        FROM dern JOIN customer ON code_station = c_custkey WHERE c_acctbal > 0""",
)
def div_model_table(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    env = c.select(k.alias("pop_id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("alt"))
    coords = c.select(k.alias("pop_id"), r(point_x(k), 6, "x"), r(point_y(k), 6, "y"))
    basins = c.select(k.alias("pop_id"), F.col("c_nationkey").alias("bv"))
    columns = {"pop_id": "code_station", "ope_id": "ope_id", "altitude": "alt", "x_wgs84": "x", "y_wgs84": "y", "code_exutoire": "bv"}
    columns |= {c: c for c in D.INDICES}
    out = D.model_table(
        latest_indices(spark, sf), "code_station", [(d, {"code_station": "pop_id"}) for d in (env, coords, basins)], columns,
        ["altitude", "x_wgs84", "y_wgs84"],
    )
    return rounded(out, "pop_id", "ope_id", "altitude", "x_wgs84", "y_wgs84", "code_exutoire")


@query(
    "div_filter_positive",
    f"""WITH {CAP}, {_BY_OPE}, {_indices_sql('s', 'ope_id')} SELECT ope_id, {_OUT}, round(log10(richesse + 1), 6) AS log_richesse
        FROM indices WHERE shannon > 0 AND simpson > 0 AND pielou > 0""",
)
def div_filter_positive(spark, sf):
    ind = D.indices(lots(spark, sf), "ope_id", "code_espece", "effectif")
    kept = D.positive_only(ind, ["shannon", "simpson", "pielou"])
    return rounded(kept.withColumn("log_richesse", F.round("log_richesse", 6)), "ope_id", "log_richesse")


def statuses(spark, sf):
    """One status per operation and species recorded there; counts of both are merged before the operations are joined."""
    zero = (F.col("code_espece") == "Brand#9") | (F.col("effectif") == 7)
    per_op = lots(spark, sf).withColumn("effectif", F.when(zero, 0.0).otherwise(F.col("effectif")))
    per_op = sum_by(per_op, ["ope_id", "code_espece"], "effectif").join(operations(spark, sf), "ope_id")
    return per_op.withColumn("statut", PR.record_status("effectif", S.pattern_flag("type_peche", INVENTORY)))


_STATUS = f"""{ZERO}, st AS (SELECT *, CASE WHEN effectif > 0 THEN 'Présent' WHEN regexp_matches(type_peche, '{INVENTORY}') THEN 'Absent' ELSE 'Non détecté' END AS statut
    FROM (SELECT ope_id, code_station, code_exutoire, annee, type_peche, code_espece, sum(effectif) AS effectif FROM z GROUP BY ALL))"""


@query(
    "div_richness_regional",
    f"{_STATUS} SELECT code_exutoire, count(DISTINCT code_espece) AS rsr FROM st WHERE statut = 'Présent' GROUP BY 1",
)
def div_richness_regional(spark, sf):
    return D.richness(statuses(spark, sf), ["code_exutoire"], "code_espece", F.col("statut") == PR.STATUS_LEVELS[2], out="rsr")


@query(
    "div_richness_local_regional",
    f"""{_STATUS}, i AS (SELECT * FROM st WHERE regexp_matches(type_peche, '{INVENTORY}')),
        b AS (SELECT code_exutoire FROM i GROUP BY 1 HAVING count(DISTINCT code_station) > 4),
        l AS (SELECT DISTINCT code_exutoire, code_station, code_espece FROM (
                SELECT * FROM i WHERE statut = 'Présent' AND code_exutoire IN (SELECT code_exutoire FROM b)
                QUALIFY rank() OVER (PARTITION BY code_station, code_exutoire ORDER BY annee DESC) = 1)),
        loc AS (SELECT code_exutoire, avg(n) AS m FROM (SELECT code_exutoire, code_station, count(*) AS n FROM l GROUP BY 1, 2) GROUP BY 1)
        SELECT l.code_exutoire, count(DISTINCT code_espece) AS richesse_regionale, round(max(m), 6) AS richesse_loc_moy
        FROM l JOIN loc ON l.code_exutoire = loc.code_exutoire GROUP BY 1""",
)
def div_richness_local_regional(spark, sf):
    out = D.local_and_regional(
        statuses(spark, sf), "code_station", "code_exutoire", "code_espece", "annee",
        S.pattern_flag("type_peche", INVENTORY), F.col("statut") == PR.STATUS_LEVELS[2],
    )
    return out.withColumn("richesse_loc_moy", F.round("richesse_loc_moy", 6))


@query(
    "div_richness_operation",
    f"""WITH {CAP}, n AS (SELECT code_station, ope_id, date_peche, count(DISTINCT nullif(code_espece, 'Brand#7')) + max(CASE WHEN code_espece = 'Brand#7' THEN 1 ELSE 0 END) AS rsl
                          FROM cap GROUP BY 1, 2, 3)
        SELECT code_station, ope_id, date_peche, rsl FROM n QUALIFY row_number() OVER (PARTITION BY code_station ORDER BY date_peche DESC, ope_id) = 1""",
)
def div_richness_operation(spark, sf):
    d = captures(spark, sf, basin=False).withColumn("code_espece", S.null_if("code_espece", "Brand#7"))
    return D.operation_richness(d, "ope_id", "code_station", "date_peche", "code_espece")


# -- estimators -----------------------------------------------------------------------------


def _pool_sql(source: str, pool: str, tag: str = "") -> str:
    """CTE ``pool`` + tag: the four estimators per pool; ``tag`` keeps two uses apart."""
    return f"""h{tag} AS (SELECT DISTINCT {pool}, ope_id, code_espece FROM {source}),
      f{tag} AS (SELECT {pool}, code_espece, count(*)::DOUBLE AS f FROM h{tag} GROUP BY 1, 2),
      u{tag} AS (SELECT {pool}, count(DISTINCT ope_id) AS n FROM h{tag} GROUP BY 1),
      a{tag} AS (SELECT f.{pool}, n, count(*) AS s, count(*) FILTER (WHERE f = 1)::DOUBLE AS a1, count(*) FILTER (WHERE f = 2)::DOUBLE AS a2,
                   sum(pow(1 - f / n, n)) AS b FROM f{tag} f JOIN u{tag} u ON f.{pool} = u.{pool} GROUP BY 1, 2),
      pool{tag} AS (SELECT {pool}, n, s AS richesse_observee,
                 s + (n - 1.0e0) / n * CASE WHEN a2 > 0 THEN a1 * a1 / (2 * a2) ELSE a1 * (a1 - 1) / 2 END AS chao,
                 s + a1 * (n - 1.0e0) / n AS jack1,
                 CASE WHEN n > 1 THEN s + a1 * (2.0e0 * n - 3) / n - a2 * (n - 2.0e0) * (n - 2) / (n * (n - 1.0e0)) END AS jack2,
                 s + b AS boot FROM a{tag})"""


@query(
    "est_pool_point",
    f"""WITH {CAP}, {_pool_sql('cap', 'code_station')} SELECT code_station, n, richesse_observee, round_even(chao, 6) AS chao, round_even(jack1, 6) AS jack1,
        round_even(jack2, 6) AS jack2, round_even(boot, 6) AS boot, round_even((chao + jack1 + jack2 + boot) / 4, 6) AS richesse_absolue_moy_estimateurs FROM pool""",
)
def est_pool_point(spark, sf):
    est = EST.pool_estimates(captures(spark, sf, basin=False), "code_station", "ope_id", "code_espece")
    return EST.mean_estimate(est, below_observed_missing=False, digits=6)


_LAST_OPS = """dern AS (SELECT cap.* FROM cap JOIN (SELECT o_orderkey FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC) <= 1) ON ope_id = o_orderkey)"""
_MISSING_BELOW = ", ".join(f"CASE WHEN {c} >= richesse_observee THEN {c} END AS {c}" for c in EST.ESTIMATORS)
_MEAN_KNOWN = "list_avg(list_filter([chao, jack1, jack2, boot], lambda v: v IS NOT NULL))"


def _latest_captures(spark, sf):
    last = latest_with_ties(operations(spark, sf), ["code_station"], "date_peche").select("ope_id", "code_exutoire")
    return lots(spark, sf).join(last, "ope_id")


@query(
    "est_pool_bv",
    f"""WITH {CAP}, {_LAST_OPS}, {_pool_sql('dern', 'code_exutoire')}, m AS (SELECT code_exutoire, n, richesse_observee, {_MISSING_BELOW} FROM pool)
        SELECT code_exutoire, n, richesse_observee, round_even(chao, 6) AS chao, round_even(jack1, 6) AS jack1, round_even(jack2, 6) AS jack2, round_even(boot, 6) AS boot,
               round_even({_MEAN_KNOWN}, 6) AS rich_abs_moy FROM m""",
)
def est_pool_bv(spark, sf):
    est = EST.pool_estimates(_latest_captures(spark, sf), "code_exutoire", "ope_id", "code_espece")
    return EST.mean_estimate(est, below_observed_missing=True, digits=6, out="rich_abs_moy")


@query(
    "est_mean_local",
    f"""WITH {CAP}, {_pool_sql('cap', 'code_station')},
        l AS (SELECT c_nationkey AS code_exutoire, CASE WHEN count(chao + jack1 + jack2 + boot) = count(*) THEN avg((chao + jack1 + jack2 + boot) / 4) END AS lsr
              FROM pool JOIN customer ON code_station = c_custkey GROUP BY 1),
        r AS (SELECT code_exutoire, count(DISTINCT code_espece) AS rsr_obs FROM cap GROUP BY 1)
        SELECT r.code_exutoire, rsr_obs, round(lsr, 6) AS lsr_moy FROM r LEFT JOIN l ON r.code_exutoire = l.code_exutoire""",
)
def est_mean_local(spark, sf):
    d = captures(spark, sf)
    pts = EST.mean_estimate(EST.pool_estimates(d, "code_station", "ope_id", "code_espece"), below_observed_missing=False, digits=9)
    places = table(spark, sf, "customer").select(F.col("c_custkey").alias("code_station"), F.col("c_nationkey").alias("code_exutoire"))
    regional = D.richness(d, ["code_exutoire"], "code_espece", out="rsr_obs")
    out = D.mean_local(pts.join(places, "code_station"), regional, "code_exutoire", "richesse_absolue_moy_estimateurs")
    return out.withColumn("lsr_moy", F.round("lsr_moy", 6))


def _accum_sql(site: str, source: str = "cap") -> str:
    return f"""h AS (SELECT DISTINCT {site}, ope_id, code_espece FROM {source}),
      f AS (SELECT {site}, code_espece, count(*) AS f FROM h GROUP BY 1, 2),
      u AS (SELECT {site}, count(DISTINCT ope_id) AS n FROM h GROUP BY 1),
      g AS (SELECT f.{site}, n, f, count(*) AS m FROM f JOIN u ON f.{site} = u.{site} GROUP BY 1, 2, 3),
      k AS (SELECT *, unnest(range(1, n + 1)) AS n_opes FROM g),
      curve AS (SELECT {site}, n_opes, sum(m * (1 - CASE WHEN n_opes > n - f THEN 0 ELSE
           exp(lgamma(n - f + 1) + lgamma(n - n_opes + 1) - lgamma(n - f - n_opes + 1) - lgamma(n + 1)) END)) AS pt_richesse FROM k GROUP BY 1, 2)"""


@query(
    "acc_curve",
    f"WITH {CAP}, {_accum_sql('code_station')} SELECT code_station, n_opes, round(pt_richesse, 6) AS pt_richesse FROM curve",
)
def acc_curve(spark, sf):
    out = EST.accumulation(captures(spark, sf, basin=False), "code_station", "ope_id", "code_espece")
    return out.withColumn("pt_richesse", F.round("pt_richesse", 6))


@query(
    "acc_well_sampled",
    f"""WITH {CAP}, big AS (SELECT code_station FROM cap GROUP BY 1 HAVING count(DISTINCT ope_id) > 15),
        src AS (SELECT cap.* FROM cap JOIN big ON cap.code_station = big.code_station), {_accum_sql('code_station', 'src')}
        SELECT code_station, n_opes, round(pt_richesse, 6) AS pt_richesse,
               code_station || ' (' || coalesce(CASE WHEN c_nationkey <> 3 THEN c_name END, 'Inconnu') || ')' AS localisation
        FROM curve JOIN customer ON code_station = c_custkey""",
)
def acc_well_sampled(spark, sf):
    labels = table(spark, sf, "customer").where("c_nationkey <> 3")
    labels = labels.select(F.col("c_custkey").alias("code_station"), F.col("c_name").alias("localisation"))
    out = EST.accumulation_well_sampled(
        captures(spark, sf, basin=False), "code_station", "ope_id", "code_espece", 15, labels, "localisation"
    )
    return out.withColumn("pt_richesse", F.round("pt_richesse", 6))


# -- density --------------------------------------------------------------------------------


@query(
    "dens_point",
    """WITH o AS (SELECT * FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC) = 1),
       t AS (SELECT l_orderkey, sum(l_quantity) AS e FROM lineitem GROUP BY 1)
       SELECT o_orderkey AS ope_id, o_custkey AS code_station, coalesce(e, 0) AS effectif, round(coalesce(e, 0) / o_totalprice, 9) AS densite,
              CASE WHEN e > 0 THEN round(ln(e / o_totalprice), 6) END AS log_densite FROM o LEFT JOIN t ON o_orderkey = l_orderkey WHERE o_totalprice > 0""",
)
def dens_point(spark, sf):
    ops = operations(spark, sf, basin=False).select("ope_id", "code_station", "annee", "surface")
    caught = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ope_id"), F.col("l_quantity").alias("effectif"))
    out = D.density_by_point(ops, caught, "code_station", "ope_id", "annee", "surface", "effectif")
    return out.select("ope_id", "code_station", "effectif", r("densite", 9), r("log_densite"))


@query(
    "dens_bv",
    """WITH o AS (SELECT o_orderkey, c_nationkey, o_totalprice, c_nationkey * 10.0 + 5 AS area FROM orders JOIN customer ON o_custkey = c_custkey
                  WHERE c_nationkey <> 3 QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY year(o_orderdate) DESC) = 1)
       SELECT o_orderkey AS ope_id, c_nationkey AS code_exutoire, round(sum(o_totalprice) OVER w, 2) AS effectif_bassin,
              round(sum(o_totalprice) OVER w / area / 1000, 4) AS densite_bassin, round(ln(sum(o_totalprice) OVER w / area), 6) AS log_densite_bassin,
              round(ln(area), 6) AS log_surf FROM o WINDOW w AS (PARTITION BY c_nationkey)""",
)
def dens_bv(spark, sf):
    ops = operations(spark, sf).select("ope_id", "code_exutoire", "annee", "surface")
    ops = ops.withColumn("surf_m2", F.col("code_exutoire") * 10.0 + 5)
    out = D.density_by_basin(ops, "code_exutoire", "annee", "surface", "surf_m2", exclude=[3])
    return out.select(
        "ope_id", "code_exutoire", r("effectif_bassin", 2), r(F.col("densite_bassin") / 1000, 4, "densite_bassin"),
        r("log_densite_bassin"), r("log_surf"),
    )
