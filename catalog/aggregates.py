"""Aggregations, per-group values, limits and samples, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.standins import CAP, INVENTORY, SERIES, captures, level_series, lots, operations, r, table
from creel.functions import scalars as S
from creel.functions.nulls import (
    mean_strict,
    n_distinct,
    n_distinct_if,
    row_mean,
    sum_or_zero,
    sum_strict,
)
from creel.operators import diversity as D, environment as E, grouping as G, prepare as P, presence as PR, series as TS

# quantities equal to 7 play the missing counts
HOLED = f"WITH {CAP}, capn AS (SELECT * REPLACE (nullif(effectif, 7) AS effectif) FROM cap)"


def holed(spark, sf, **kw):
    return captures(spark, sf, **kw).withColumn("effectif", S.null_if("effectif", 7.0))


# -- aggregations -----------------------------------------------------------------


@query("agg_sum_by", f"{HOLED} SELECT ope_id, code_espece, coalesce(sum(effectif), 0) AS effectif FROM capn GROUP BY 1, 2")
def agg_sum_by(spark, sf):
    d = lots(spark, sf).withColumn("effectif", S.null_if("effectif", 7.0))
    return G.sum_by(d, ["ope_id", "code_espece"], "effectif")


@query(
    "agg_sum_strict",
    f"{HOLED} SELECT ope_id, CASE WHEN count(effectif) = count(*) THEN sum(effectif) END AS effectif FROM capn GROUP BY 1",
)
def agg_sum_strict(spark, sf):
    d = lots(spark, sf).withColumn("effectif", S.null_if("effectif", 7.0))
    return G.sum_by(d, ["ope_id"], "effectif", missing="strict")


@query(
    "agg_all_but",
    f"WITH {CAP} SELECT ope_id, code_station, code_espece, annee, sum(effectif) AS effectif FROM cap GROUP BY ALL",
)
def agg_all_but(spark, sf):
    d = captures(spark, sf, basin=False).select("ope_id", "code_station", "code_espece", "annee", "effectif")
    return G.merge_all_but(d, "effectif")


@query(
    "agg_distinct_by",
    f"""WITH {CAP} SELECT code_exutoire, count(DISTINCT code_station) AS n_stations, count(DISTINCT annee) AS n_annees,
        count(DISTINCT date_peche) AS n_dates,
        count(DISTINCT nullif(code_espece, 'Brand#7')) + max(CASE WHEN code_espece = 'Brand#7' THEN 1 ELSE 0 END) AS n_especes
        FROM cap GROUP BY 1""",
)
def agg_distinct_by(spark, sf):
    d = captures(spark, sf).withColumn("code_espece", S.null_if("code_espece", "Brand#7"))
    return d.groupBy("code_exutoire").agg(
        n_distinct("code_station").alias("n_stations"),
        n_distinct("annee").alias("n_annees"),
        n_distinct("date_peche").alias("n_dates"),
        n_distinct("code_espece").alias("n_especes"),
    )


@query(
    "agg_distinct_if",
    f"""SELECT c_nationkey AS code_exutoire,
        count(DISTINCT CASE WHEN regexp_matches(nullif(o_orderpriority, '5-LOW'), '{INVENTORY}') THEN o_custkey END)
          + max(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS n_inventaires
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def agg_distinct_if(spark, sf):
    d = operations(spark, sf).withColumn("inventaire", S.pattern_flag(S.null_if("type_peche", "5-LOW"), INVENTORY))
    return d.groupBy("code_exutoire").agg(n_distinct_if("inventaire", "code_station").alias("n_inventaires"))


@query(
    "agg_effort",
    f"""SELECT c_nationkey AS code_exutoire, count(DISTINCT year(o_orderdate)) AS n_annees, count(DISTINCT o_custkey) AS n_pops,
        count(DISTINCT CASE WHEN regexp_matches(o_orderpriority, '{INVENTORY}') THEN o_custkey END) AS n_inventaires
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def agg_effort(spark, sf):
    d = operations(spark, sf).withColumn("inventaire", S.pattern_flag("type_peche", INVENTORY))
    return P.distinct_values(d, "code_exutoire", "annee", "code_station", "inventaire").groupBy("code_exutoire").agg(
        n_distinct("annee").alias("n_annees"),
        n_distinct("code_station").alias("n_pops"),
        n_distinct_if("inventaire", "code_station").alias("n_inventaires"),
    )


@query("agg_mean_by", "SELECT l_partkey, round(avg(nullif(l_quantity, 7)), 6) AS moyenne FROM lineitem GROUP BY 1")
def agg_mean_by(spark, sf):
    d = table(spark, sf, "lineitem")
    return d.groupBy("l_partkey").agg(r(F.avg(S.null_if("l_quantity", 7.0)), 6, "moyenne"))


@query(
    "agg_mean_strict",
    """SELECT l_partkey, CASE WHEN count(nullif(l_quantity, 7)) = count(*) THEN round(avg(l_quantity), 6) END AS moyenne
       FROM lineitem GROUP BY 1""",
)
def agg_mean_strict(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("l_quantity", S.null_if("l_quantity", 7.0))
    return d.groupBy("l_partkey").agg(r(mean_strict("l_quantity"), 6, "moyenne"))


@query(
    "agg_mean_of_means",
    f"""WITH {CAP}, l AS (SELECT code_exutoire, code_station, count(DISTINCT code_espece) AS n FROM cap GROUP BY 1, 2)
        SELECT code_exutoire, round(avg(n), 6) AS richesse_loc_moy FROM l GROUP BY 1""",
)
def agg_mean_of_means(spark, sf):
    local = D.richness(captures(spark, sf), ["code_exutoire", "code_station"], "code_espece", out="n")
    return local.groupBy("code_exutoire").agg(r(F.avg("n"), 6, "richesse_loc_moy"))


@query(
    "agg_row_mean",
    """SELECT l_orderkey, l_linenumber, l_partkey,
              round((nullif(l_tax, 0) + nullif(l_discount, 0) + l_quantity) / 3, 6) AS stricte,
              round((l_tax + l_discount + l_quantity) / (1 + CAST(l_tax <> 0 AS INTEGER) + CAST(l_discount <> 0 AS INTEGER)), 6) AS lache
       FROM lineitem""",
)
def agg_row_mean(spark, sf):
    d = table(spark, sf, "lineitem").withColumns({c: S.null_if(c, 0.0) for c in ("l_tax", "l_discount")})
    cols = ["l_tax", "l_discount", "l_quantity"]
    return d.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        r(row_mean(*cols), 6, "stricte"), r(row_mean(*cols, ignore_missing=True), 6, "lache"),
    )


@query(
    "agg_summary_stats",
    """SELECT 'l_quantity' AS variable, min(l_quantity) AS mini, round(median(l_quantity), 6) AS med, max(l_quantity) AS maxi FROM lineitem
       UNION ALL SELECT 'l_tax', min(nullif(l_tax, 0)), round(median(nullif(l_tax, 0)), 6), max(nullif(l_tax, 0)) FROM lineitem
       UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), round(median(l_extendedprice), 6), max(l_extendedprice) FROM lineitem""",
)
def agg_summary_stats(spark, sf):
    out = E.summary_stats(table(spark, sf, "lineitem"), ["l_quantity", "l_tax", "l_extendedprice"])
    return out.select("variable", "mini", r("med"), "maxi")


@query(
    "agg_ordered_max",
    """SELECT o_custkey, CASE max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END)
              WHEN 3 THEN 'Présent' WHEN 2 THEN 'Absent' ELSE 'Non détecté' END AS statut FROM orders GROUP BY 1""",
)
def agg_ordered_max(spark, sf):
    label = S.case_label("o_orderpriority", {"1-URGENT": "Présent", "2-HIGH": "Absent"}, default=F.lit("Non détecté"))
    d = table(spark, sf, "orders").select("o_custkey", label.alias("statut"))
    return PR.highest_status(d, ["o_custkey"]).drop("rang")


@query(
    "agg_presence_max",
    """SELECT o_custkey, CAST(max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS INTEGER) AS presence
       FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1""",
)
def agg_presence_max(spark, sf):
    label = S.case_label("o_orderpriority", {"1-URGENT": "Présent", "5-LOW": "Non détecté"}, default=F.lit("Absent"))
    return PR.presence_flag(table(spark, sf, "orders").select("o_custkey", label.alias("statut")), ["o_custkey"])


@query(
    "agg_count_sum_by_year",
    f"WITH {CAP} SELECT annee, round(sum(effectif), 2) AS abondance, count(*) AS n_presences FROM cap WHERE code_espece = 'Brand#12' GROUP BY 1",
)
def agg_count_sum_by_year(spark, sf):
    one = lots(spark, sf).where("code_espece = 'Brand#12'").join(operations(spark, sf, basin=False), "ope_id")
    return one.groupBy("annee").agg(r(sum_strict("effectif"), 2, "abondance"), F.count(F.lit(1)).alias("n_presences"))


@query("agg_distinct_rows", f"WITH {CAP} SELECT DISTINCT code_station, annee, code_espece FROM cap")
def agg_distinct_rows(spark, sf):
    return P.distinct_values(captures(spark, sf, basin=False), "code_station", "annee", "code_espece")


def _signif2(x: str) -> str:
    shift = f"(1 - floor(log10({x})))"
    val = f"CASE WHEN {shift} >= 0 THEN round_even({x} * pow(10, {shift}), 0) / pow(10, {shift}) ELSE round_even({x} / pow(10, -{shift}), 0) * pow(10, -{shift}) END"
    return f"rtrim(rtrim(CAST(CAST({val} AS DECIMAL(27,9)) AS VARCHAR), '0'), '.') || '%'"


def _rate_sql(name: str, keys: str) -> str:
    return f"""SELECT '{name}' AS unite, n_presence, n_total, {_signif2('(100.0 * n_presence / n_total)')} AS pourcentage FROM (
        SELECT count(DISTINCT CASE WHEN code_espece = 'Brand#12' THEN ({keys}) END) AS n_presence, count(DISTINCT ({keys})) AS n_total FROM cap)"""


@query(
    "agg_occurrence_rate",
    f"WITH {CAP} " + " UNION ALL ".join(
        [_rate_sql("peche", "code_station || '_' || date_peche"), _rate_sql("station", "code_station"), _rate_sql("bassin", "code_exutoire")]
    ),
)
def agg_occurrence_rate(spark, sf):
    units = {"peche": ["code_station", "date_peche"], "station": ["code_station"], "bassin": ["code_exutoire"]}
    return PR.occurrence_rates(captures(spark, sf), units, "code_espece", "Brand#12")


@query(
    "agg_individual_share",
    f"""WITH {CAP}, s AS (SELECT sum(effectif) FILTER (WHERE code_espece = 'Brand#12') AS n_indiv_sp, sum(effectif) AS n_indiv_total FROM cap)
        SELECT n_indiv_sp, n_indiv_total, {_signif2('(100.0 * n_indiv_sp / n_indiv_total)')} AS pourcentage FROM s""",
)
def agg_individual_share(spark, sf):
    return PR.individual_share(lots(spark, sf), "code_espece", "effectif", "Brand#12")


# -- per-group values ------------------------------------------------------------------


@query(
    "win_latest_ties",
    """SELECT o_orderkey AS ope_id, o_custkey AS code_station, CAST(o_orderdate AS DATE) AS date_peche FROM orders
       QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC) = 1""",
)
def win_latest_ties(spark, sf):
    ops = operations(spark, sf, basin=False).select("ope_id", "code_station", "date_peche")
    return G.latest_with_ties(ops, ["code_station"], "date_peche")


@query(
    "win_latest_one",
    """SELECT o_orderkey AS ope_id, o_custkey AS code_station, CAST(o_orderdate AS DATE) AS date_peche FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) = 1""",
)
def win_latest_one(spark, sf):
    ops = operations(spark, sf, basin=False).select("ope_id", "code_station", "date_peche")
    return G.latest_one(ops, ["code_station"], "date_peche", ["ope_id"])


@query(
    "win_group_total",
    """SELECT o_orderkey AS ope_id, round(sum(o_totalprice) OVER (PARTITION BY c_nationkey), 2) AS total,
              round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY c_nationkey) * 1000, 6) AS part
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def win_group_total(spark, sf):
    ops = operations(spark, sf).select("ope_id", "code_exutoire", "surface")
    out = G.with_group_values(ops, ["code_exutoire"], {"total": F.sum("surface")})
    return out.select("ope_id", r("total", 2), r(F.col("surface") / F.col("total") * 1000, 6, "part"))


@query(
    "win_first_baseline",
    f"WITH {SERIES} SELECT time, round(level - (SELECT arg_min(level, time) FROM serie), 6) AS level FROM serie",
)
def win_first_baseline(spark, sf):
    return TS.baseline(level_series(spark, sf), "time", "level").select("time", r("level"))


@query(
    "win_argmin",
    """SELECT o_custkey, min(o_totalprice) AS mini, arg_min(o_orderkey, o_totalprice) AS ope_id FROM orders GROUP BY 1""",
)
def win_argmin(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(F.min("o_totalprice").alias("mini"), F.min_by("o_orderkey", "o_totalprice").alias("ope_id"))


# -- limits and samples ---------------------------------------------------------------------


@query(
    "lim_first_row",
    f"""WITH {SERIES} SELECT 'premier' AS quoi, time, round(level, 6) AS level FROM serie QUALIFY row_number() OVER (ORDER BY time) = 1
        UNION ALL (SELECT 'sous_seuil', time, round(level, 6) FROM serie
                   WHERE level < (SELECT arg_min(level, time) FROM serie) ORDER BY time LIMIT 1)""",
)
def lim_first_row(spark, sf):
    s = level_series(spark, sf)
    start = s.agg(F.min_by("level", "time")).scalar()
    first = G.first_rows(s, ["time"], 1).select(F.lit("premier").alias("quoi"), "time", r("level"))
    below = G.first_matching(s, F.col("level") < start, ["time"]).select(F.lit("sous_seuil").alias("quoi"), "time", r("level"))
    return first.unionByName(below)


@query("lim_head_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def lim_head_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return G.first_rows(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 25)


@query("samp_n", "SELECT c_custkey, c_name FROM customer ORDER BY md5('1|' || c_custkey) LIMIT 100")
def samp_n(spark, sf):
    return G.sample_n(table(spark, sf, "customer").select("c_custkey", "c_name"), 100, ["c_custkey"], seed=1)


@query(
    "samp_one_per_group",
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY md5('1|' || o_orderkey)) = 1",
)
def samp_one_per_group(spark, sf):
    return G.sample_one_per_group(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], seed=1)


# -- set operations --------------------------------------------------------------------------


@query(
    "set_stack_sources",
    """SELECT c_custkey AS code, c_name AS libelle, c_acctbal AS solde, NULL::INTEGER AS taille FROM customer
       UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier
       UNION ALL SELECT p_partkey, p_name, NULL, p_size FROM part""",
)
def set_stack_sources(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS code", "c_name AS libelle", "c_acctbal AS solde")
    s = table(spark, sf, "supplier").selectExpr("s_acctbal AS solde", "s_suppkey AS code", "s_name AS libelle")
    p = table(spark, sf, "part").selectExpr("p_partkey AS code", "p_name AS libelle", "p_size AS taille")
    return P.stack_sources(c, s, p)


@query(
    "set_union_aligned",
    "SELECT c_custkey AS code, c_nationkey AS bassin FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier",
)
def set_union_aligned(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS code", "c_nationkey AS bassin")
    s = table(spark, sf, "supplier").selectExpr("s_name AS nom", "s_nationkey AS bassin", "s_suppkey AS code")
    return P.stack_aligned(c, s)


@query("set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_difference(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_custkey AS c_custkey")
    return P.set_difference(table(spark, sf, "customer").select("c_custkey"), urgent)


@query(
    "set_unsurveyed",
    """SELECT o_orderkey AS ope_id, o_custkey AS code_station FROM orders
       WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
)
def set_unsurveyed(spark, sf):
    ops = operations(spark, sf, basin=False).select("ope_id", "code_station")
    return PR.unsurveyed(ops, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ope_id")), "ope_id")


@query("set_distinct_values", "SELECT DISTINCT p_brand, p_type FROM part")
def set_distinct_values(spark, sf):
    return P.distinct_values(table(spark, sf, "part"), "p_brand", "p_type")
