"""The whole analyses on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.diversity import _LAST_OPS, _MEAN_KNOWN, _MISSING_BELOW, _pool_sql, vocabulary
from catalog.models import _LM_OUT, _cells, _ols_ctes, _p_value, lm_out
from catalog.places import _BOX, _PT, basin_polygons
from catalog.standins import CAP, INVENTORY, SERIES, captures, level_series, lots, operations, point_x, point_y, r, table
from creel.plans import atlas as A, levels as L, macroecology as M

RULES = A.Rules(1996, INVENTORY, ["Brand#1", "Brand#2"], {"Brand#25": "Brand#24"})

_CLEAN = f"""{CAP}, src AS (
    SELECT ope_id AS o, code_station, code_exutoire, date_peche, annee, type_peche, CASE code_espece WHEN 'Brand#25' THEN 'Brand#24' ELSE code_espece END AS code_espece, effectif
    FROM cap WHERE code_espece NOT IN ('Brand#1', 'Brand#2') AND annee > 1996),
  net AS (SELECT code_station, code_exutoire, date_peche, annee, type_peche, code_espece, sum(effectif) AS effectif FROM src GROUP BY ALL)"""


def cleaned(spark, sf):
    """Two sources (by protocol) of the captures, cleaned; an operation is a place and day."""
    k = F.col("code_station")
    d = captures(spark, sf).drop("ope_id", "surface").withColumns({"x_wgs84": point_x(k), "y_wgs84": point_y(k)})
    urgent = d.where("type_peche = '1-URGENT'")
    others = d.where("type_peche <> '1-URGENT'")
    return A.clean_captures([urgent, others], RULES)


@query(
    "flow_atlas_captures",
    f"""WITH {_CLEAN} SELECT code_station, code_exutoire, date_peche, annee, type_peche, code_espece, effectif FROM net""",
)
def flow_atlas_captures(spark, sf):
    cols = ["code_station", "code_exutoire", "date_peche", "annee", "type_peche", "code_espece", "effectif"]
    return cleaned(spark, sf).select(*cols)


@query(
    "flow_atlas_points",
    f"""WITH {_CLEAN}, v AS (SELECT code_espece FROM net GROUP BY 1 HAVING sum(effectif) > 0),
        hit AS (SELECT c_custkey, n_nationkey, n_name FROM ({_PT}) JOIN ({_BOX}) ON x >= x0 AND x < x0 + 2.3 AND y >= y0 AND y < y0 + 2.3),
        o AS (SELECT code_station, date_peche, annee, max({{'r': CASE WHEN regexp_matches(type_peche, '{INVENTORY}') THEN 2 ELSE 1 END, 't': type_peche}}) AS p
              FROM net WHERE annee >= 1996 AND code_espece IN (SELECT code_espece FROM v) GROUP BY ALL),
        n AS (SELECT code_station, date_peche, code_espece, sum(effectif) AS effectif FROM net GROUP BY ALL)
        SELECT o.code_station, o.date_peche, o.annee, p.t AS type_peche, v.code_espece, 'Poisson ' || lower(v.code_espece) AS esp_nom_commun, coalesce(effectif, 0) AS effectif,
               CASE WHEN effectif > 0 THEN 'Présent' WHEN p.r = 2 THEN 'Absent' ELSE 'Non détecté' END AS statut, n_nationkey AS bassin, n_name AS toponyme
        FROM o JOIN hit ON o.code_station = c_custkey CROSS JOIN v
        LEFT JOIN n ON n.code_station = o.code_station AND n.date_peche = o.date_peche AND n.code_espece = v.code_espece""",
)
def flow_atlas_points(spark, sf):
    """The basin comes from the polygons; the one that the stand-in stations carry is not used."""
    basins = basin_polygons(spark, sf).withColumnRenamed("code_exutoire", "bassin")
    names = vocabulary(spark, sf).withColumn("esp_nom_commun", F.concat(F.lit("Poisson "), F.lower("code_espece")))
    out = A.placed_statuses(cleaned(spark, sf), basins, ["bassin", "toponyme"], "rings", RULES, names=names, name_col="esp_nom_commun")
    cols = ["code_station", "date_peche", "annee", "type_peche", "code_espece", "esp_nom_commun", "effectif", "statut", "bassin", "toponyme"]
    return out.select(*cols)


@query(
    "flow_atlas_basins",
    f"""WITH {_CLEAN}, v AS (SELECT DISTINCT code_espece FROM net WHERE effectif > 0),
        g AS (SELECT code_exutoire, annee, max(CASE WHEN regexp_matches(type_peche, '{INVENTORY}') THEN 2 ELSE 1 END) AS full_ FROM net GROUP BY 1, 2),
        h AS (SELECT DISTINCT code_exutoire, annee, code_espece FROM net WHERE effectif > 0)
        SELECT g.code_exutoire, g.annee, v.code_espece,
               CASE WHEN h.code_espece IS NOT NULL THEN 'Présent' WHEN full_ = 2 THEN 'Absent' ELSE 'Non détecté' END AS statut
        FROM g CROSS JOIN v LEFT JOIN h ON g.code_exutoire = h.code_exutoire AND g.annee = h.annee AND v.code_espece = h.code_espece""",
)
def flow_atlas_basins(spark, sf):
    out = A.basin_statuses(cleaned(spark, sf), "code_exutoire", RULES)
    return out.select("code_exutoire", "annee", "code_espece", "statut")


@query(
    "flow_atlas_effort",
    f"""WITH {_CLEAN} SELECT code_exutoire, count(DISTINCT annee) AS n_annees, count(DISTINCT code_station) AS n_pops,
        count(DISTINCT CASE WHEN regexp_matches(type_peche, '{INVENTORY}') THEN code_station END) AS n_inventaires
        FROM (SELECT * REPLACE (nullif(annee, 1998) AS annee) FROM net) WHERE annee IS NOT NULL GROUP BY 1""",
)
def flow_atlas_effort(spark, sf):
    # the place key is a pair of coordinates, one per station for up to a million stations
    d = captures(spark, sf).drop("ope_id", "surface").withColumns({"x_wgs84": F.col("code_station") / 8, "y_wgs84": F.lit(1.0)})
    d = d.withColumn("annee", F.when(F.col("annee") != 1998, F.col("annee")))  # one year plays the unknown one
    return A.basin_effort(A.clean_captures([d], RULES), "code_exutoire", RULES)


@query(
    "flow_index_models",
    f"""WITH {CAP}, s AS (SELECT ope_id, code_station, date_peche, code_espece, sum(effectif) AS n FROM cap WHERE regexp_matches(type_peche, '{INVENTORY}') GROUP BY ALL),
        p AS (SELECT *, n / sum(n) OVER (PARTITION BY ope_id) AS q FROM s),
        i AS (SELECT ope_id, code_station, date_peche, count(*)::DOUBLE AS richesse, -sum(q * ln(q)) AS shannon FROM p GROUP BY ALL),
        d AS (SELECT * FROM i QUALIFY rank() OVER (PARTITION BY code_station ORDER BY date_peche DESC) = 1),
        m AS (SELECT richesse, shannon, c_acctbal / 1000 AS x, ((c_custkey * 37) % 1009) / 100.0 AS z FROM d JOIN customer ON code_station = c_custkey),
        rr AS (SELECT 'richesse' AS response, richesse AS y, x, z FROM m UNION ALL SELECT 'shannon', shannon, x, z FROM m),
        {_ols_ctes('rr', ['response'])} {_cells(['response'])}""",
)
def flow_index_models(spark, sf):
    k = F.col("c_custkey")
    env = table(spark, sf, "customer").select(k.alias("pop_id"), (F.col("c_acctbal") / 1000).alias("x"), point_x(k).alias("z"))
    points = M.point_diversity(
        lots(spark, sf), operations(spark, sf, basin=False), "ope_id", "code_station", "date_peche", "code_espece", "effectif",
        inventory=F.col("type_peche").rlike(INVENTORY),
    )
    return M.index_models(points, env, "code_station", "pop_id", ["x", "z"], ["richesse", "shannon"])


def _ols3_sql(source: str) -> str:
    """Least squares of y on a, b and c by the inverse of their 3 x 3 sums of squares; CTE ``coef`` has one row per term."""
    pairs = ["aa", "ab", "ac", "bb", "bc", "cc", "ay", "by", "cy", "yy"]
    sums = ", ".join(f"covar_pop({p}, {q}) * count(*) AS s{p}{q}" for p, q in pairs)
    inverse = {
        "aa": "sbb * scc - sbc * sbc", "ab": "sac * sbc - sab * scc", "ac": "sab * sbc - sac * sbb",
        "bb": "saa * scc - sac * sac", "bc": "sab * sac - saa * sbc", "cc": "saa * sbb - sab * sab",
    }
    cells = ", ".join(f"({e}) / det AS i{k}" for k, e in inverse.items())
    return f"""sm AS (SELECT count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my, {sums} FROM {source}),
      dt AS (SELECT *, saa * (sbb * scc - sbc * sbc) - sab * (sab * scc - sbc * sac) + sac * (sab * sbc - sbb * sac) AS det FROM sm),
      iv AS (SELECT *, {cells} FROM dt),
      bt AS (SELECT *, iaa * say + iab * sby + iac * scy AS ba, iab * say + ibb * sby + ibc * scy AS bb, iac * say + ibc * sby + icc * scy AS bc FROM iv),
      vr AS (SELECT *, (syy - ba * say - bb * sby - bc * scy) / (n - 4) AS s2, 1 - (syy - ba * say - bb * sby - bc * scy) / syy AS r2 FROM bt),
      cf AS (SELECT n, r2, 'a' AS term, ba AS est, sqrt(s2 * iaa) AS se FROM vr UNION ALL SELECT n, r2, 'b', bb, sqrt(s2 * ibb) FROM vr
        UNION ALL SELECT n, r2, 'c', bc, sqrt(s2 * icc) FROM vr
        UNION ALL SELECT n, r2, '(Intercept)', my - ba * ma - bb * mb - bc * mc, sqrt(s2 * (1 / n + ma * ma * iaa + mb * mb * ibb + mc * mc * icc
          + 2 * (ma * mb * iab + ma * mc * iac + mb * mc * ibc))) FROM vr),
      coef AS (SELECT *, {_p_value('(est / se)', '(n - 4)')} AS p FROM cf)"""


@query(
    "flow_density_model_points",
    f"""WITH o AS (SELECT * FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC) = 1),
        t AS (SELECT l_orderkey, sum(l_quantity) AS e FROM lineitem GROUP BY 1),
        d AS (SELECT ln(e / (o_totalprice / 1e5)) AS y, ((o_custkey * 37) % 1009) / 100.0 AS a, ((o_custkey * 53) % 997) / 90.0 AS b, o_totalprice / 1e5 AS c
              FROM o JOIN t ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 0 AND e > 0), {_ols3_sql('d')}
        SELECT 'log_densite' AS response, CASE term WHEN 'a' THEN 'x_wgs84' WHEN 'b' THEN 'y_wgs84' WHEN 'c' THEN 'surface' ELSE term END AS term, round(est, 5) AS estimate,
               round(se, 6) AS std_error, round(est / se, 3) AS t_value, round(p, 6) AS p_value, CAST(n AS BIGINT) AS n, round(r2, 6) AS r2,
               round(1 - (1 - r2) * (n - 1) / (n - 4), 6) AS adj_r2 FROM coef""",
)
def flow_density_model_points(spark, sf):
    k = F.col("c_custkey")
    ops = operations(spark, sf, basin=False).withColumn("surface", F.col("surface") / F.lit(1e5))
    coords = table(spark, sf, "customer").select(k.alias("code_station"), point_x(k).alias("x_wgs84"), point_y(k).alias("y_wgs84"))
    caught = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ope_id"), F.col("l_quantity").alias("effectif"))
    return lm_out(M.point_density_model(ops, caught, coords, "code_station", "ope_id", "annee", "surface", "effectif", "x_wgs84", "y_wgs84"), "response")


@query(
    "flow_density_model_basins",
    f"""WITH o AS (SELECT c_nationkey AS bv, o_totalprice / 1e6 AS e FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3
                   QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY year(o_orderdate) DESC) = 1),
        t AS (SELECT bv, sum(e) AS e, count(*) AS k FROM o GROUP BY 1), h AS (SELECT c_nationkey AS bv, max(c_acctbal) / 1000 AS alt FROM customer GROUP BY 1),
        q AS (SELECT t.e / (o.bv / 10.0 + 0.5) AS y, o.bv / 10.0 + 0.5 AS x, alt AS z FROM o JOIN t ON o.bv = t.bv JOIN h ON o.bv = h.bv), {_ols_ctes('q', [])}
        SELECT 'densite_bassin' AS response, CASE term WHEN 'x' THEN 'surf_m2' WHEN 'z' THEN 'alt_max' ELSE term END AS term, {_LM_OUT} FROM co""",
)
def flow_density_model_basins(spark, sf):
    rows = operations(spark, sf).select("code_exutoire", "annee", (F.col("surface") / F.lit(1e6)).alias("effectif"))
    k = F.col("c_nationkey")
    basins = table(spark, sf, "customer").groupBy(k.alias("code_exutoire")).agg((F.max("c_acctbal") / 1000).alias("alt_max"))
    basins = basins.withColumn("surf_m2", F.col("code_exutoire") / F.lit(10.0) + 0.5)
    return lm_out(M.basin_density_model(rows, basins, "code_exutoire", "annee", "effectif", "surf_m2", "alt_max", [3]), "response")


@query(
    "flow_local_and_basin_richness",
    f"""WITH {CAP}, {_pool_sql('cap', 'code_station')},
        l AS (SELECT c_nationkey AS code_exutoire, CASE WHEN count(jack2) = count(*) THEN avg(round_even((chao + jack1 + jack2 + boot) / 4, 2)) END AS lsr
              FROM pool JOIN customer ON code_station = c_custkey GROUP BY 1),
        {_LAST_OPS}, {_pool_sql('dern', 'code_exutoire', '_bv')},
        m AS (SELECT code_exutoire, n, richesse_observee, {_MISSING_BELOW} FROM pool_bv)
        SELECT m.code_exutoire, n AS n_pop, richesse_observee AS rsr_obs, round_even({_MEAN_KNOWN}, 2) AS rsr_abs, round(lsr, 6) AS lsr_moy
        FROM m LEFT JOIN l ON m.code_exutoire = l.code_exutoire""",
)
def flow_local_and_basin_richness(spark, sf):
    out = M.local_and_basin_richness(
        lots(spark, sf), operations(spark, sf), "ope_id", "code_station", "code_exutoire", "date_peche", "code_espece"
    )
    return out.select("code_exutoire", "n_pop", "rsr_obs", "rsr_abs", r("lsr_moy"))


@query(
    "flow_level_to_year",
    f"""WITH {SERIES}, s AS (SELECT time, level - (SELECT arg_min(level, time) FROM serie) AS level FROM serie WHERE time < 60),
        k AS (SELECT min(time) AS k FROM s WHERE level = (SELECT min(level) FROM s)),
        cut AS (SELECT * FROM s QUALIFY row_number() OVER (ORDER BY time) <= (SELECT k FROM k)),
        q AS (SELECT c_custkey, ((c_custkey * 61) % 801 - 400) / 40.0 AS niveau FROM customer),
        f AS (SELECT c_custkey, niveau, min(time) AS t FROM q LEFT JOIN cut ON level < niveau GROUP BY 1, 2)
        SELECT c_custkey, round(niveau, 6) AS niveau, round(t + (niveau - i.level) / (i.level - p.level), 6) AS annee_niveau
        FROM f LEFT JOIN cut i ON i.time = t LEFT JOIN cut p ON p.time = t - 1""",
)
def flow_level_to_year(spark, sf):
    k = F.col("c_custkey")
    asked = table(spark, sf, "customer").select("c_custkey", (((k * 61) % 801 - 400) / F.lit(40.0)).alias("niveau"))
    out = L.level_to_time(asked, level_series(spark, sf), "niveau", "time", "level", before=60)
    return out.select("c_custkey", r("niveau"), r("annee_niveau"))
