"""Scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.standins import r, table
from creel.functions import scalars as S


@query(
    "fn_title_case",
    """SELECT p_partkey, array_to_string(list_transform(string_split(p_name || '-D''OR', '-'),
          lambda m: array_to_string(list_transform(string_split(m, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')), '-') AS titre
       FROM part""",
)
def fn_title_case(spark, sf):
    text = F.concat(F.upper("p_name"), F.lit("-D'OR"))
    return table(spark, sf, "part").select("p_partkey", S.title_case(text).alias("titre"))


@query(
    "fn_toponym_rules",
    """SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'Bassin non nommé' ELSE
          upper(p_name[1]) || lower(string_split(p_name, ' ')[1][2:]) || ' de l''Aber ' ||
          upper(string_split(p_name, ' ')[2][1]) || string_split(p_name, ' ')[2][2:] || '-Malo' END AS toponyme
       FROM part""",
)
def fn_toponym_rules(spark, sf):
    word = F.split("p_name", " ")
    raw = F.concat(F.upper(word[0]), F.lit(" DE L'ABER "), F.upper(word[1]), F.lit("-MALO"))
    raw = F.when(F.col("p_type") == "SMALL", "NR").otherwise(raw)
    return table(spark, sf, "part").select("p_partkey", S.toponym(raw).alias("toponyme"))


@query(
    "fn_pad_left",
    """SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR) < 3 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END AS code
       FROM customer""",
)
def fn_pad_left(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.pad_left(F.col("c_custkey").cast("string"), 3).alias("code"))


def _num(x: str, d: int = 6) -> str:
    return f"rtrim(rtrim(CAST(CAST(round_even({x}, {d}) AS DECIMAL(24,6)) AS VARCHAR), '0'), '.')"


@query(
    "fn_key_concat",
    f"""SELECT c_custkey, {_num('c_acctbal / 7000')} || '_' || {_num('c_custkey / 7.0e0')} || coalesce(nullif(c_nationkey, 3)::VARCHAR, 'NA') AS cle
        FROM customer""",
)
def fn_key_concat(spark, sf):
    key = S.coordinate_key(F.col("c_acctbal") / 7000, F.col("c_custkey") / F.lit(7.0))
    return table(spark, sf, "customer").select("c_custkey", S.paste(key, S.null_if("c_nationkey", 3)).alias("cle"))


@query(
    "fn_pattern_flag",
    "SELECT o_orderkey, regexp_matches(nullif(o_orderpriority, '5-LOW'), 'URGENT|HIGH') AS inventaire FROM orders",
)
def fn_pattern_flag(spark, sf):
    flag = S.pattern_flag(S.null_if("o_orderpriority", "5-LOW"), "URGENT|HIGH")
    return table(spark, sf, "orders").select("o_orderkey", flag.alias("inventaire"))


@query(
    "fn_case_label",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Hausse' WHEN 'O' THEN 'Baisse' END AS tendance,
              CASE o_orderpriority WHEN '1-URGENT' THEN 'Truite' ELSE o_orderpriority END AS nom FROM orders""",
)
def fn_case_label(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        S.case_label("o_orderstatus", {"F": "Hausse", "O": "Baisse"}).alias("tendance"),
        S.recode("o_orderpriority", {"1-URGENT": "Truite"}).alias("nom"),
    )


@query(
    "fn_two_way",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 THEN NULL WHEN l_tax > 0.04 THEN 'haut' ELSE 'bas' END AS niveau FROM lineitem""",
)
def fn_two_way(spark, sf):
    level = S.two_way(S.null_if("l_tax", 0.0) > 0.04, "haut", "bas")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", level.alias("niveau"))


@query(
    "fn_presence_3state",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN NULL WHEN p_size % 3 > 0 THEN 'Présence' ELSE 'Absence' END AS presence FROM part""",
)
def fn_presence_3state(spark, sf):
    n = S.null_if(F.col("p_size") % 3, 2)
    return table(spark, sf, "part").select("p_partkey", S.presence_state(n).alias("presence"))


@query(
    "fn_percent_text",
    "SELECT p_partkey, CAST(CAST(round_even(100.0 * p_size / 64, 1) AS DECIMAL(18,1)) AS VARCHAR) || '%' AS part_pc FROM part",
)
def fn_percent_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.percent_text(F.col("p_size") / F.lit(64.0), 1).alias("part_pc"))


@query(
    "fn_signif",
    """WITH t AS (SELECT o_orderkey, o_totalprice / 3 AS x, 2 - 1 - floor(log10(o_totalprice / 3)) AS s FROM orders)
       SELECT o_orderkey, CASE WHEN s >= 0 THEN round_even(x * pow(10, s), 0) / pow(10, s)
              ELSE round_even(x / pow(10, -s), 0) * pow(10, -s) END AS arrondi FROM t""",
)
def fn_signif(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.signif(F.col("o_totalprice") / 3, 2).alias("arrondi"))


@query("fn_round", "SELECT p_partkey, round_even(p_retailprice / 8, 2) AS prix, round_even(p_size / 2.0e0, 0) AS moitie FROM part")
def fn_round(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", S.round_even(F.col("p_retailprice") / 8, 2).alias("prix"), S.round_even(F.col("p_size") / 2).alias("moitie")
    )


@query(
    "fn_logs",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS l, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS l10,
              CASE WHEN c_acctbal > -1 THEN round(ln(1 + c_acctbal), 6) END AS l1p, CASE WHEN c_acctbal > -1 THEN round(log10(1 + c_acctbal), 6) END AS l1p10
       FROM customer""",
)
def fn_logs(spark, sf):
    c = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        "c_custkey", r(F.ln(c), 6, "l"), r(F.log10(c), 6, "l10"), r(F.log1p(c), 6, "l1p"), r(S.log1p10(c), 6, "l1p10")
    )


@query(
    "fn_arcsine_share",
    "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(round(asin(sqrt(nullif(l_quantity, 7) / 100)), 6), 0) AS part FROM lineitem",
)
def fn_arcsine_share(spark, sf):
    part = S.arcsine_share(S.null_if("l_quantity", 7.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(part, 6, "part"))


@query(
    "fn_null_if",
    """SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_tax, 0) AS zero, CASE WHEN l_quantity >= 5 THEN l_quantity END AS petit,
              CASE WHEN l_tax >= l_discount THEN l_tax END AS dessous FROM lineitem""",
)
def fn_null_if(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        S.null_if("l_tax", 0.0).alias("zero"), S.null_below("l_quantity", 5).alias("petit"),
        S.null_below("l_tax", F.col("l_discount")).alias("dessous"),
    )


@query("fn_unit_change", "SELECT o_orderkey, round(o_totalprice / 1e6, 9) AS km2, round(o_totalprice / 1000, 6) AS km FROM orders")
def fn_unit_change(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", r(p / F.lit(1e6), 9, "km2"), r(p / 1000, 6, "km"))


@query(
    "fn_casts",
    """SELECT p_partkey, TRY_CAST(CASE WHEN p_size > 25 THEN p_size || '.75' ELSE p_name END AS DOUBLE) AS nombre,
              CAST(trunc(TRY_CAST(CASE WHEN p_size > 25 THEN p_size || '.75' ELSE p_name END AS DOUBLE)) AS INTEGER) AS entier,
              TRY_CAST('2001-01-' || lpad(p_size::VARCHAR, 2, '0') AS DATE) AS jour, p_partkey::VARCHAR AS texte FROM part""",
)
def fn_casts(spark, sf):
    text = F.when(F.col("p_size") > 25, F.concat(F.col("p_size").cast("string"), F.lit(".75"))).otherwise(F.col("p_name"))
    day = F.concat(F.lit("2001-01-"), S.pad_left(F.col("p_size").cast("string"), 2))
    return table(spark, sf, "part").select(
        "p_partkey", S.to_number(text).alias("nombre"), S.to_whole(text).alias("entier"), S.to_day(day).alias("jour"),
        F.col("p_partkey").cast("string").alias("texte"),
    )


@query("fn_reencode", "SELECT p_partkey, replace(p_name, 'e', 'é') AS libelle, replace(p_name, 'o', 'œ') AS intact FROM part")
def fn_reencode(spark, sf):
    garbled = F.replace("p_name", F.lit("e"), F.lit("Ã©"))
    return table(spark, sf, "part").select(
        "p_partkey", S.repair_utf8(garbled).alias("libelle"), S.repair_utf8(F.replace("p_name", F.lit("o"), F.lit("œ"))).alias("intact")
    )


@query("fn_square_term", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + l_quantity * l_quantity AS terme FROM lineitem")
def fn_square_term(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") + S.square("l_quantity")).alias("terme")
    )
