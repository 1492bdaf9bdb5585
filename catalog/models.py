"""Environment, distributions, correlation, components and linear models."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.standins import CAP, captures, operations, r, table
from creel.functions import scalars as S
from creel.operators import environment as E, regression as R
from creel.operators.absorption import factor_models

# -- environment and distributions -------------------------------------------------


@query(
    "env_point_means",
    """SELECT l_suppkey, round(avg(nullif(l_tax, 0)), 6) AS l_tax, round(avg(nullif(l_discount, 0)), 6) AS l_discount, round(avg(l_quantity), 6) AS l_quantity
       FROM lineitem GROUP BY 1""",
)
def env_point_means(spark, sf):
    out = E.point_means(table(spark, sf, "lineitem"), "l_suppkey", ["l_tax", "l_discount", "l_quantity"], ["l_tax", "l_discount"])
    return out.select("l_suppkey", r("l_tax"), r("l_discount"), r("l_quantity"))


@query(
    "env_transform",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_extendedprice), 6) AS l_extendedprice,
              CASE WHEN l_discount > 0 THEN round(log10(1 + l_discount), 6) END AS l_discount,
              CASE WHEN l_quantity >= 3 THEN l_quantity END AS l_quantity, round(asin(sqrt(l_tax / 100)), 6) AS l_tax FROM lineitem""",
)
def env_transform(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_quantity", "l_tax")
    out = E.transform(
        d, log=["l_extendedprice"], log1p10=["l_discount"], arcsine=["l_tax"], missing_below={"l_quantity": 3.0}, missing_zero=["l_discount"]
    )
    return out.select("l_orderkey", "l_linenumber", "l_partkey", r("l_extendedprice"), r("l_discount"), "l_quantity", r("l_tax"))


def _hist_sql(axis: str, bins: int) -> str:
    return f"""WITH v AS (SELECT 'l_quantity' AS variable, {axis.format('l_quantity')} AS v FROM lineitem
          UNION ALL SELECT 'l_extendedprice', {axis.format('l_extendedprice')} FROM lineitem),
        b AS (SELECT variable, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1)
        SELECT v.variable, least(CAST(floor((v - lo) * {bins} / (hi - lo)) AS BIGINT) + 1, {bins}) AS bin,
               round(lo + (least(CAST(floor((v - lo) * {bins} / (hi - lo)) AS BIGINT) + 1, {bins}) - 1) * ((hi - lo) / {bins}), 6) AS bin_start, count(*) AS n
        FROM v JOIN b ON v.variable = b.variable GROUP BY ALL"""


@query("dist_histogram", _hist_sql("{0}", 20))
def dist_histogram(spark, sf):
    return E.histogram(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], 20).withColumn("bin_start", F.round("bin_start", 6))


@query("dist_histogram_log", _hist_sql("log10({0})", 30))
def dist_histogram_log(spark, sf):
    out = E.histogram(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], 30, log_axis=True)
    return out.withColumn("bin_start", F.round("bin_start", 6))


@query(
    "dist_bar",
    """SELECT 'o_orderpriority' AS variable, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2
       UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2""",
)
def dist_bar(spark, sf):
    return E.bar_counts(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"])


@query(
    "dist_box",
    """SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS mini, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(median(o_totalprice), 4) AS med,
              round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS maxi FROM orders GROUP BY 1""",
)
def dist_box(spark, sf):
    out = E.five_numbers(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderpriority", "n", "mini", r("q1", 4), r("med", 4), r("q3", 4), "maxi")


# -- correlation ---------------------------------------------------------------------

_VARS = ["l_quantity", "l_extendedprice", "l_tax", "l_discount"]


def _cor_sql(use: str) -> str:
    """Correlations over lineitem with zeros of tax and discount as missing."""
    src = "SELECT l_quantity, l_extendedprice, nullif(l_tax, 0) AS l_tax, nullif(l_discount, 0) AS l_discount FROM lineitem"
    cells = []
    for a in _VARS:
        for b in _VARS:
            val = f"round(corr({a}, {b}), 6)"
            if use == "everything":
                val = f"CASE WHEN count({a}) = count(*) AND count({b}) = count(*) THEN {val} END"
            cells.append(f"SELECT '{a}' AS var_x, '{b}' AS var_y, {val} AS r FROM s")
    where = " WHERE l_tax <> 0 AND l_discount <> 0" if use == "complete" else ""
    return f"WITH s AS ({src}{where}) " + " UNION ALL ".join(cells)


def _holed_lines(spark, sf):
    return table(spark, sf, "lineitem").withColumns({c: S.null_if(c, 0.0) for c in ("l_tax", "l_discount")})


@query("cor_matrix", _cor_sql("complete"))
def cor_matrix(spark, sf):
    return R.correlations(_holed_lines(spark, sf), _VARS, "complete").withColumn("r", F.round("r", 6))


@query("cor_matrix_everything", _cor_sql("everything"))
def cor_matrix_everything(spark, sf):
    return R.correlations(_holed_lines(spark, sf), _VARS, "everything").withColumn("r", F.round("r", 6))


@query("cor_pairwise", _cor_sql("pairwise"))
def cor_pairwise(spark, sf):
    return R.correlations(_holed_lines(spark, sf), _VARS, "pairwise").withColumn("r", F.round("r", 6))


# -- model data: one row per operation with catches -------------------------------------

MR = """mr AS (
  SELECT o_orderkey AS ope_id, c_nationkey AS bv, o_orderpriority AS protocole, sum(l_quantity) / 10 AS y, avg(l_discount) * 10 AS w,
         count(*)::DOUBLE AS x, o_totalprice / 1e5 AS z, sum(l_extendedprice) / 1e5 AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def model_rows(spark, sf, basin=True):
    sums = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("ope_id"))
        .agg(
            (F.sum("l_quantity") / 10).alias("y"),
            (F.avg("l_discount") * 10).alias("w"),
            F.count(F.lit(1)).cast("double").alias("x"),
            (F.sum("l_extendedprice") / F.lit(1e5)).alias("v"),
        )
    )
    ops = operations(spark, sf, basin)
    cols = ["ope_id", F.col("type_peche").alias("protocole"), (F.col("surface") / F.lit(1e5)).alias("z")]
    if basin:
        cols.append(F.col("code_exutoire").alias("bv"))
    return sums.join(ops.select(*cols), "ope_id")


# -- components ----------------------------------------------------------------------------


def _power(name: str, matrix: str, rounds: int = 400) -> str:
    """Recursive CTE: leading eigenvector (a, b, c) and eigenvalue l of a 3 x 3 relation."""
    return f"""{name}_it AS (
      SELECT 0 AS i, 1.0::DOUBLE AS a, 0.61::DOUBLE AS b, 0.37::DOUBLE AS c, 0.0::DOUBLE AS l
      UNION ALL
      SELECT i + 1, na / s, nb / s, nc / s, s FROM (
        SELECT i, na, nb, nc, sqrt(na * na + nb * nb + nc * nc) AS s FROM (
          SELECT i, m11 * a + m12 * b + m13 * c AS na, m12 * a + m22 * b + m23 * c AS nb, m13 * a + m23 * b + m33 * c AS nc
          FROM {name}_it, {matrix} WHERE i < {rounds}))),
    {name} AS (SELECT a * sign(a) AS a, b * sign(a) AS b, c * sign(a) AS c, l FROM {name}_it WHERE i = {rounds})"""


def _deflate(name: str, matrix: str, vec: str) -> str:
    return f"""{name} AS (SELECT m11 - l * a * a AS m11, m12 - l * a * b AS m12, m13 - l * a * c AS m13, m22 - l * b * b AS m22,
        m23 - l * b * c AS m23, m33 - l * c * c AS m33 FROM {matrix}, {vec})"""


_C0 = "c0 AS (SELECT 1.0::DOUBLE AS m11, corr(x, y) AS m12, corr(x, v) AS m13, 1.0::DOUBLE AS m22, corr(y, v) AS m23, 1.0::DOUBLE AS m33 FROM mr)"


@query(
    "pca_scores",
    f"""WITH RECURSIVE {MR}, {_C0}, {_power('p1', 'c0')},
        st AS (SELECT avg(x) AS mx, avg(y) AS my, avg(v) AS mv, stddev_pop(x) AS sx, stddev_pop(y) AS sy, stddev_pop(v) AS sv FROM mr)
        SELECT ope_id, round(a * (x - mx) / sx + b * (y - my) / sy + c * (v - mv) / sv, 5) AS taille FROM mr, p1, st""",
)
def pca_scores(spark, sf):
    return R.pca_scores(model_rows(spark, sf, basin=False), ["x", "y", "v"]).select("ope_id", r("axe1", 5, "taille"))


_LOAD = " UNION ALL ".join(
    f"SELECT CAST({k} AS INTEGER) AS axis, '{n}' AS variable, round(l, 5) AS eigenvalue, round({col} * sqrt(l), 5) AS coord, round(100 * {col} * {col}, 4) AS contrib FROM p{k}"
    for k in (1, 2, 3)
    for n, col in (("x", "a"), ("y", "b"), ("v", "c"))
)


@query(
    "pca_loadings",
    f"""WITH RECURSIVE {MR}, {_C0}, {_power('p1', 'c0')}, {_deflate('c1', 'c0', 'p1')}, {_power('p2', 'c1')}, {_deflate('c2', 'c1', 'p2')},
        {_power('p3', 'c2')} {_LOAD}""",
)
def pca_loadings(spark, sf):
    out = R.pca_loadings(model_rows(spark, sf, basin=False), ["x", "y", "v"])
    return out.select("axis", "variable", r("eigenvalue", 5), r("coord", 5), r("contrib", 4))


# -- linear models ----------------------------------------------------------------------------


def _p_value(t: str, nu: str) -> str:
    """Two-sided p-value of Student's t by Simpson's rule over the angle."""
    th = f"atan(abs({t}) / sqrt({nu}))"
    step = f"((least(pi() / 2, {th} + 40 / sqrt({nu})) - {th}) / 2000)"
    body = f"pow(greatest(cos({th} + i * {step}), 0), {nu} - 1)"
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"(list_sum(list_transform(range(0, 2001), lambda i: ({weight}) * {body})) * {step} / 3)"
    return f"(2 * exp(lgamma(({nu} + 1) / 2.0e0) - lgamma({nu} / 2.0e0)) / sqrt(pi()) * {area})"


def _ols_ctes(source: str, keys: list[str], intercept: bool = True, name: str = "") -> str:
    """Least squares of y on x and z per key, closed form; CTE ``co`` has one row per term."""
    k = ", ".join(keys)
    kk = f"{k}, " if keys else ""
    group = f"GROUP BY {k}" if keys else ""
    if intercept:
        sums = "var_pop(x) * count(*) AS sxx, var_pop(z) * count(*) AS szz, var_pop(y) * count(*) AS syy, covar_pop(x, z) * count(*) AS sxz, covar_pop(x, y) * count(*) AS sxy, covar_pop(z, y) * count(*) AS szy"
        b0 = f"UNION ALL SELECT {kk}0, '(Intercept)', my - bx * mx - bz * mz, sqrt(s2 * (1 / n + (mx * mx * szz - 2 * mx * mz * sxz + mz * mz * sxx) / det)), n, df, rss, r2, adj FROM fi{name}"
    else:
        sums = "sum(x * x) AS sxx, sum(z * z) AS szz, sum(y * y) AS syy, sum(x * z) AS sxz, sum(x * y) AS sxy, sum(z * y) AS szy"
        b0 = ""
    rank, i = (3, 1) if intercept else (2, 0)
    return f"""su{name} AS (SELECT {kk}count(*)::DOUBLE AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, {sums} FROM {source}
            WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL {group}),
      be{name} AS (SELECT *, sxx * szz - sxz * sxz AS det, (szz * sxy - sxz * szy) / (sxx * szz - sxz * sxz) AS bx,
                    (sxx * szy - sxz * sxy) / (sxx * szz - sxz * sxz) AS bz FROM su{name}),
      rs{name} AS (SELECT *, syy - bx * sxy - bz * szy AS rss, n - {rank} AS df FROM be{name}),
      fi{name} AS (SELECT *, rss / df AS s2, 1 - rss / syy AS r2, 1 - (rss / syy) * (n - {i}) / df AS adj FROM rs{name}),
      ce{name} AS (SELECT {kk}1 AS o, 'x' AS term, bx AS b, sqrt(s2 * szz / det) AS se, n, df, rss, r2, adj FROM fi{name}
             UNION ALL SELECT {kk}2, 'z', bz, sqrt(s2 * sxx / det), n, df, rss, r2, adj FROM fi{name} {b0}),
      co{name} AS (SELECT *, b / se AS t, {_p_value('(b / se)', 'df')} AS p FROM ce{name})"""


_LM_OUT = "round(b, 5) AS estimate, round(se, 6) AS std_error, round(t, 3) AS t_value, round(p, 6) AS p_value, CAST(n AS BIGINT) AS n, round(r2, 6) AS r2, round(adj, 6) AS adj_r2"


def lm_out(df, *keys):
    return df.select(
        *keys, "term", r("estimate", 5), r("std_error"), r("t_value", 3), r("p_value"), "n", r("r2"), r("adj_r2")
    )


@query("lm_fit", f"WITH {MR}, {_ols_ctes('mr', [])} SELECT 'y' AS response, term, {_LM_OUT} FROM co")
def lm_fit(spark, sf):
    return lm_out(R.linear_models(model_rows(spark, sf, basin=False), ["y"], ["x", "z"]), "response")





@query(
    "lm_fit_factor",
    f"""WITH {MR}, g AS (SELECT protocole, count(*)::DOUBLE AS nl, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, var_pop(y) * count(*) AS syy,
              covar_pop(x, y) * count(*) AS sxy FROM mr GROUP BY 1),
        w AS (SELECT sum(nl) AS n, sum(sxx) AS sxx, sum(sxy) / sum(sxx) AS b, (sum(syy) - sum(sxy) * sum(sxy) / sum(sxx)) / (sum(nl) - 6) AS s2 FROM g),
        g0 AS (SELECT * FROM g WHERE protocole = '1-URGENT'),
        ce AS (SELECT '(Intercept)' AS term, g0.my - b * g0.mx AS b, sqrt(s2 * (1 / g0.nl + g0.mx * g0.mx / w.sxx)) AS se, n FROM w, g0
               UNION ALL SELECT 'x', b, sqrt(s2 / w.sxx), n FROM w
               UNION ALL SELECT 'protocole' || g.protocole, g.my - g0.my - b * (g.mx - g0.mx),
                    sqrt(s2 * (1 / g.nl + 1 / g0.nl + (g.mx - g0.mx) * (g.mx - g0.mx) / w.sxx)), n FROM g, g0, w WHERE g.protocole <> '1-URGENT')
        SELECT term, round(b, 5) AS estimate, round(se, 6) AS std_error, round({_p_value('(b / se)', '(n - 6)')}, 6) AS p_value, CAST(n AS BIGINT) AS n FROM ce""",
)
def lm_fit_factor(spark, sf):
    rows = model_rows(spark, sf, basin=False)
    fits = factor_models(rows, ["y"], ["x"], "protocole")
    return fits.select("term", r("estimate", 5), r("std_error"), r("p_value"), "n")


LOCREG = """lr AS (SELECT code_station, count(DISTINCT code_espece)::DOUBLE AS y, count(DISTINCT ope_id)::DOUBLE AS x FROM cap GROUP BY 1),
  q AS (SELECT y, x, x * x AS z FROM lr)"""


def richness_by_effort(spark, sf):
    d = captures(spark, sf, basin=False)
    pairs = d.select("code_station", "ope_id", "code_espece").distinct()
    return pairs.groupBy("code_station").agg(
        F.count_distinct("code_espece").cast("double").alias("y"), F.count_distinct("ope_id").cast("double").alias("x")
    )





@query(
    "lm_no_intercept_quad",
    f"WITH {CAP}, {LOCREG}, {_ols_ctes('q', [], intercept=False)} SELECT 'y' AS response, CASE term WHEN 'z' THEN 'x^2' ELSE term END AS term, {_LM_OUT} FROM co",
)
def lm_no_intercept_quad(spark, sf):
    return lm_out(R.quadratic(richness_by_effort(spark, sf), "y", "x", intercept=False), "response")


@query(
    "lm_quad_smooth",
    f"WITH {CAP}, {LOCREG}, {_ols_ctes('q', [])} SELECT 'y' AS response, CASE term WHEN 'z' THEN 'x^2' ELSE term END AS term, {_LM_OUT} FROM co",
)
def lm_quad_smooth(spark, sf):
    return lm_out(R.quadratic(richness_by_effort(spark, sf), "y", "x"), "response")


_NUM3 = "rtrim(rtrim(CAST(CAST(round_even({0}, 3) AS DECIMAL(24,3)) AS VARCHAR), '0'), '.')"
_STARS = """CASE WHEN p > 0.05 AND p < 0.1 THEN '(.)' WHEN p > 0.01 AND p < 0.05 THEN '(*)' WHEN p > 0.001 AND p < 0.01 THEN '(**)' WHEN p < 0.001 THEN '(***)' ELSE '' END"""


def _cells(keys: list[str], name: str = "") -> str:
    k = "".join(f"{c}, " for c in keys)
    return f"""SELECT {k}CAST(o AS INTEGER) AS term_order, term, {_NUM3.format('b')} || {_STARS} AS cell FROM co{name}
      UNION ALL SELECT {k}10000, 'adj.r.squared', {_NUM3.format('adj')} FROM fi{name}"""


@query(
    "lm_table",
    f"""WITH {MR}, rr AS (SELECT 'y' AS response, y, x, z FROM mr UNION ALL SELECT 'w', w, x, z FROM mr UNION ALL SELECT 'v', v, x, z FROM mr),
        {_ols_ctes('rr', ['response'])} {_cells(['response'])}""",
)
def lm_table(spark, sf):
    return R.model_table(model_rows(spark, sf, basin=False), ["y", "w", "v"], ["x", "z"])


@query(
    "lm_table_subsets",
    f"""WITH {MR}, rr AS (SELECT 'complet' AS subset, 'y' AS response, y, x, z FROM mr UNION ALL SELECT 'sans 1', 'y', y, x, z FROM mr WHERE bv NOT IN (0)
          UNION ALL SELECT 'sans 4', 'y', y, x, z FROM mr WHERE bv NOT IN (0, 1, 2, 3) UNION ALL SELECT 'sans 6', 'y', y, x, z FROM mr WHERE bv NOT IN (0, 1, 2, 3, 4, 5)),
        {_ols_ctes('rr', ['subset', 'response'])} {_cells(['subset', 'response'])}""",
)
def lm_table_subsets(spark, sf):
    bv = F.col("bv")
    subsets = {"complet": F.lit(True), "sans 1": bv > 0, "sans 4": bv > 3, "sans 6": bv > 5}
    return R.model_table(R.tag_subsets(model_rows(spark, sf), subsets), ["y"], ["x", "z"], by=["subset"])


_STEP = """pa AS (SELECT bv, n, syy, n * ln(rss / n) + 6 AS axz, n * ln((syy - sxy * sxy / sxx) / n) + 4 AS ax, n * ln((syy - szy * szy / szz) / n) + 4 AS az,
        n * ln(syy / n) + 2 AS a0 FROM rs),
    ch AS (SELECT bv, CASE WHEN least(ax, az) >= axz THEN 'x+z' WHEN ax <= az THEN CASE WHEN a0 < ax THEN '' ELSE 'x' END ELSE CASE WHEN a0 < az THEN '' ELSE 'z' END END AS termes,
              n, axz, ax, az, a0 FROM pa)"""


@query(
    "lm_step_aic",
    f"""WITH {MR}, sw AS (SELECT bv, w AS y, x, z FROM mr), {_ols_ctes('sw', ['bv'])}, {_STEP}
        SELECT bv, termes, round(CASE termes WHEN 'x+z' THEN axz WHEN 'x' THEN ax WHEN 'z' THEN az ELSE a0 END + n * (ln(2 * pi()) + 1) + 2, 4) AS aic FROM ch""",
)
def lm_step_aic(spark, sf):
    fits = R.linear_models(model_rows(spark, sf), ["w"], ["x", "z"], by=["bv"], step=True)
    # a model has one row per term, at most three here
    kept = F.sort_array(F.collect_list(F.when(F.col("term") != R.INTERCEPT, F.col("term"))))
    return fits.groupBy("bv").agg(F.array_join(kept, "+").alias("termes"), r(F.max("aic"), 4, "aic"))


@query(
    "lm_table_step",
    f"""WITH {MR}, sw AS (SELECT bv, w AS y, x, z FROM mr), {_ols_ctes('sw', ['bv'])}, {_STEP},
        one AS (SELECT s.*, termes, CASE termes WHEN 'x' THEN sxx ELSE szz END AS s1, CASE termes WHEN 'x' THEN sxy ELSE szy END AS c1,
                  CASE termes WHEN 'x' THEN mx ELSE mz END AS m1 FROM su s JOIN ch ON s.bv = ch.bv WHERE termes IN ('x', 'z')),
        single AS (SELECT *, c1 / s1 AS b1, (syy - c1 * c1 / s1) / (n - 2) AS s2, 1 - (syy - c1 * c1 / s1) / syy * (n - 1) / (n - 2) AS adj FROM one),
        none AS (SELECT s.* FROM su s JOIN ch ON s.bv = ch.bv WHERE termes = ''),
        co_step AS (SELECT bv, o, term, b, p FROM co WHERE bv IN (SELECT bv FROM ch WHERE termes = 'x+z')
            UNION ALL SELECT bv, o, term, b, {_p_value('(b / se)', 'nu')} FROM (
                SELECT bv, CASE termes WHEN 'x' THEN 1 ELSE 2 END AS o, termes AS term, b1 AS b, sqrt(s2 / s1) AS se, n - 2 AS nu FROM single
                UNION ALL SELECT bv, 0, '(Intercept)', my - b1 * m1, sqrt(s2 * (1 / n + m1 * m1 / s1)), n - 2 FROM single
                UNION ALL SELECT bv, 0, '(Intercept)', my, sqrt(syy / (n - 1) / n), n - 1 FROM none)),
        fi_step AS (SELECT bv, adj FROM fi WHERE bv IN (SELECT bv FROM ch WHERE termes = 'x+z') UNION ALL SELECT bv, adj FROM single UNION ALL SELECT bv, 0.0 FROM none)
        SELECT bv, 'w' AS response, * EXCLUDE (bv) FROM ({_cells(['bv'], '_step')})""",
)
def lm_table_step(spark, sf):
    return R.model_table(model_rows(spark, sf), ["w"], ["x", "z"], by=["bv"], step=True)


@query("lm_aic", f"WITH {MR}, {_ols_ctes('mr', ['bv'])} SELECT bv, round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 8, 4) AS aic FROM rs")
def lm_aic(spark, sf):
    fits = R.linear_models(model_rows(spark, sf), ["y"], ["x", "z"], by=["bv"])
    return fits.where(F.col("term") == "x").select("bv", r("aic", 4))


@query(
    "lm_residuals",
    f"""WITH {MR}, {_ols_ctes('mr', [])} SELECT ope_id, round(my + bx * (x - mx) + bz * (z - mz), 5) AS fitted, round(y - (my + bx * (x - mx) + bz * (z - mz)), 5) AS residual FROM mr, fi""",
)
def lm_residuals(spark, sf):
    return R.residuals(model_rows(spark, sf, basin=False), "y", ["x", "z"]).select("ope_id", r("fitted", 5), r("residual", 5))


@query(
    "lm_residual_summary",
    f"""WITH {MR}, {_ols_ctes('mr', [])}, e AS (SELECT y - (my + bx * (x - mx) + bz * (z - mz)) AS e FROM mr, fi)
        SELECT count(*) AS n, round(min(e), 5) AS mini, round(quantile_cont(e, 0.25), 5) AS q1, round(median(e), 5) AS med, round(quantile_cont(e, 0.75), 5) AS q3,
               round(max(e), 5) AS maxi FROM e""",
)
def lm_residual_summary(spark, sf):
    res = R.residuals(model_rows(spark, sf, basin=False), "y", ["x", "z"])
    return E.five_numbers(res, [], "residual").select("n", *[r(c, 5) for c in ("mini", "q1", "med", "q3", "maxi")])


@query(
    "lm_leverage",
    f"""WITH {MR}, {_ols_ctes('mr', [])} SELECT ope_id, round(1000 * (1 / n + ((x - mx) * (x - mx) * szz - 2 * (x - mx) * (z - mz) * sxz + (z - mz) * (z - mz) * sxx) / det), 6) AS levier
        FROM mr, fi""",
)
def lm_leverage(spark, sf):
    res = R.residuals(model_rows(spark, sf, basin=False), "y", ["x", "z"])
    return res.select("ope_id", r(F.col("leverage") * 1000, 6, "levier"))


@query(
    "lm_trend_test",
    f"""WITH {CAP}, a AS (SELECT code_exutoire, code_espece, annee::DOUBLE AS x, sum(effectif) / 100 AS y FROM cap GROUP BY ALL),
        s AS (SELECT code_exutoire, code_espece, count(*)::DOUBLE AS n, var_pop(x) * count(*) AS sxx, var_pop(y) * count(*) AS syy, covar_pop(x, y) * count(*) AS sxy FROM a GROUP BY 1, 2),
        b AS (SELECT *, sxy / sxx AS slope, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS se FROM s WHERE n > 2 AND sxx > 0),
        t AS (SELECT *, {_p_value('(slope / se)', '(n - 2)')} AS p FROM b)
        SELECT code_exutoire, code_espece, CAST(n AS BIGINT) AS n, round(slope, 6) AS slope, round(p, 6) AS p_value, p < 0.05 AS significant FROM t""",
)
def lm_trend_test(spark, sf):
    yearly = captures(spark, sf).groupBy("code_exutoire", "code_espece", F.col("annee").cast("double").alias("annee"))
    yearly = yearly.agg((F.sum("effectif") / 100).alias("abondance"))
    out = R.trend_test(yearly, ["code_exutoire", "code_espece"], "annee", "abondance").where("n > 2")
    return out.select("code_exutoire", "code_espece", "n", r("slope"), r("p_value"), "significant")


# the derivative of the least sum of squares by the logarithm of the rate, for one value of it
_GRADIENT = """SELECT i, lo, hi, g, slope * (sqv - sq * sv / tot - slope * (seq - se * sq / tot)) AS d, mu + sv / tot - slope * se / tot AS asym, slope,
    svv - sv * sv / tot - slope * (sev - se * sv / tot) AS rss
  FROM (SELECT *, (sev - se * sv / tot) / (see - se * se / tot) AS slope FROM (
    SELECT i, lo, hi, g, tot, mu, sum(n * e) AS se, sum(n * q) AS sq, sum(n * v) AS sv, sum(n * e * e) AS see, sum(n * e * q) AS seq, sum(n * e * v) AS sev,
           sum(n * q * v) AS sqv, sum(n * (v * v + s)) AS svv
    FROM (SELECT p.*, tot, mu, n, m - mu AS v, bx.v AS s, exp(-exp(g) * x) AS e, exp(g) * x * exp(-exp(g) * x) AS q FROM {points} p, bx, t)
    GROUP BY i, lo, hi, g, tot, mu))"""


@query(
    "nls_asymptote",
    f"""WITH RECURSIVE {CAP}, {LOCREG}, bx AS (SELECT x, count(*)::DOUBLE AS n, avg(y) AS m, var_pop(y) AS v FROM lr GROUP BY 1),
        t AS (SELECT sum(n) AS tot, sum(n * m) / sum(n) AS mu FROM bx),
        grid AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 0.0::DOUBLE AS hi, -8 + unnest(range(0, 45)) * 0.2::DOUBLE AS g),
        start AS ({_GRADIENT.format(points='grid')}),
        half AS (SELECT 0 AS i, arg_min(g, rss) - 0.2 AS lo, arg_min(g, rss) + 0.2 AS hi FROM start
          UNION ALL
          SELECT i + 1, CASE WHEN d < 0 THEN g ELSE lo END, CASE WHEN d < 0 THEN hi ELSE g END
          FROM ({_GRADIENT.format(points='(SELECT i, lo, hi, (lo + hi) / 2 AS g FROM half WHERE i < 50)')})),
        z AS (SELECT 0 AS i, lo, hi, (lo + hi) / 2 AS g FROM half WHERE i = 50)
        SELECT round(asym, 3) AS "Asym", round(asym + slope, 3) AS "R0", round(g, 3) AS lrc, round(rss, 2) AS rss FROM ({_GRADIENT.format(points='z')})""",
)
def nls_asymptote(spark, sf):
    """The SQL halves an interval around the place where the gradient is zero."""
    best = R.asymptote(richness_by_effort(spark, sf), "x", "y")
    found = spark.createDataFrame([tuple(best[c] for c in ("Asym", "R0", "lrc", "rss"))], "Asym double, R0 double, lrc double, rss double")
    return found.select(r("Asym", 3), r("R0", 3), r("lrc", 3), r("rss", 2))
