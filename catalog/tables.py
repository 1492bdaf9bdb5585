"""Sources, sinks, projection, reshaping, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.models import _ols_ctes
from catalog.standins import CAP, INVENTORY, captures, lots, operations, point_x, point_y, r, table
from creel.functions import columns as C, scalars as S
from creel.functions.nulls import sum_or_zero
from creel.operators import prepare as P, presence as PR
from creel.operators.grouping import sum_by
from creel.operators.order import bind_by_position
from creel.operators.regression import residuals
from creel.operators.spatial import rectangle, ring_edges
from creel.sources import tables as IO

# -- sources and sinks -----------------------------------------------------------


@query("src_delimited", "SELECT c_custkey AS code_station, c_name AS libelle, c_nationkey AS code_exutoire, c_acctbal AS valeur FROM customer")
def src_delimited(spark, sf):
    path = IO.shared_dir(spark)
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]
    table(spark, sf, "customer").select(*cols).write.csv(path, sep="\t", header=True)
    return IO.read_delimited(
        spark,
        path,
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double",
        rename={"c_custkey": "code_station", "c_name": "libelle", "c_nationkey": "code_exutoire", "c_acctbal": "valeur"},
    )


@query(
    "src_tables",
    """SELECT 'orders' AS tab, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem
       UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'customer', count(*) FROM customer""",
)
def src_tables(spark, sf):
    loaded = IO.read_tables(spark, sf, ["orders", "lineitem", "part", "customer"])
    return P.stack_sources(*[d.agg(F.lit(n).alias("tab"), F.count(F.lit(1)).alias("n")) for n, d in loaded.items()])


@query("src_latest_snapshot", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_acctbal > 0")
def src_latest_snapshot(spark, sf):
    folder = IO.shared_dir(spark)
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    c.drop("c_acctbal").write.parquet(f"{folder}/tables_2021_11_30")
    c.where("c_acctbal > 0").drop("c_acctbal").write.parquet(f"{folder}/tables_2022_05_30")
    c.where("c_acctbal < 0").drop("c_acctbal").write.parquet(f"{folder}/other_2023_01_01")
    return IO.read_latest(spark, folder, "^tables")


@query(
    "src_layer_attributes",
    """SELECT c_custkey AS code_exutoire, c_name AS toponyme, CAST(4 AS INTEGER) AS n_cotes,
              round(((c_custkey * 37) % 1009) / 100.0, 6) AS x_min FROM customer""",
)
def src_layer_attributes(spark, sf):
    path = IO.shared_dir(spark)
    k = F.col("c_custkey")
    x, y = point_x(k), point_y(k)
    shape = rectangle(x, y, x + 1, y + 1)
    table(spark, sf, "customer").select("c_custkey", "c_name", shape.alias("rings")).write.parquet(path)
    layer = IO.read_layer(spark, path, {"code_exutoire": "c_custkey", "toponyme": "c_name"})
    edges = ring_edges(F.col("rings"))
    return layer.select(
        "code_exutoire",
        "toponyme",
        F.size(edges).alias("n_cotes"),
        r(F.array_min(F.transform(edges, lambda e: e["x1"])), 6, "x_min"),
    )


@query("src_sheet_filter", "SELECT p_partkey AS code_espece, p_retailprice AS statut FROM part WHERE p_type = 'PROMO'")
def src_sheet_filter(spark, sf):
    return IO.sheet_rows(
        table(spark, sf, "part"), F.col("p_type") == "PROMO", {"code_espece": "p_partkey", "statut": "p_retailprice"}
    )


@query(
    "sink_tables",
    f"WITH {CAP} SELECT annee, count(*) AS n, round(sum(effectif), 2) AS effectif FROM cap GROUP BY annee",
)
def sink_tables(spark, sf):
    rows = captures(spark, sf, basin=False).select("ope_id", "code_espece", "effectif", "annee")
    paths = IO.write_tables({"captures": rows}, IO.shared_dir(spark), {"captures": ["annee"]})
    back = spark.read.parquet(paths["captures"])
    return back.groupBy("annee").agg(F.count(F.lit(1)).alias("n"), r(F.sum("effectif"), 2, "effectif"))


# -- projection and reshaping -------------------------------------------------------


@query(
    "proj_select_rename",
    "SELECT c_custkey AS code_station, c_name AS localisation, c_nationkey, c_acctbal FROM customer",
)
def proj_select_rename(spark, sf):
    return C.select_rename(
        table(spark, sf, "customer"),
        {"code_station": "c_custkey", "localisation": "c_name"},
        everything=True,
        drop=["c_mktsegment"],
    )


@query(
    "proj_cols_between",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
)
def proj_cols_between(spark, sf):
    d = table(spark, sf, "lineitem")
    return d.select("l_orderkey", *C.cols_between(d, "l_linenumber", "l_tax"))


@query(
    "proj_map_columns",
    """SELECT p_partkey, p_name, CAST(p_size + 1 AS INTEGER) AS p_size, round(ln(p_retailprice), 6) AS p_retailprice,
              upper(p_brand) AS p_brand, upper(p_type) AS p_type FROM part""",
)
def proj_map_columns(spark, sf):
    d = table(spark, sf, "part")
    d = C.map_columns(d, C.cols_of_type(d, "double"), lambda c: F.round(F.ln(c), 6))
    d = C.map_columns(d, C.cols_between(d, "p_brand", "p_type"), F.upper)
    return C.map_columns(d, [c for c in C.cols_starting(d, "p_s")], lambda c: c + 1)


@query(
    "reshape_unpivot",
    """SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) AS value FROM part
       UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""",
)
def reshape_unpivot(spark, sf):
    d = table(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return C.to_long(d, ["p_partkey"], ["p_size", "p_retailprice"])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_SHORT = {p: f"p{i}" for i, p in enumerate(PRIORITIES, 1)}


def _pivot_sql(fill: bool) -> str:
    cells = []
    for p, short in _SHORT.items():
        cell = f"round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '{p}'), 2)"
        cells.append(f"{'coalesce(' + cell + ', 0)' if fill else cell} AS {short}")
    return f"SELECT o_custkey, {', '.join(cells)} FROM orders GROUP BY o_custkey"


def _pivot(spark, sf, fill):
    d = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    wide = C.to_wide(d, ["o_custkey"], "o_orderpriority", "o_totalprice", PRIORITIES, fill, F.sum)
    return wide.select("o_custkey", *[r(F.col(f"`{p}`"), 2, s) for p, s in _SHORT.items()])


@query("reshape_pivot", _pivot_sql(True))
def reshape_pivot(spark, sf):
    return _pivot(spark, sf, 0.0)


@query("reshape_pivot_nofill", _pivot_sql(False))
def reshape_pivot_nofill(spark, sf):
    return _pivot(spark, sf, None)


@query(
    "proj_ordered_level",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Présent' WHEN o_orderpriority = '2-HIGH' THEN 'Absent'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'Non détecté' END AS statut,
              CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 END AS INTEGER) AS rang
       FROM orders""",
)
def proj_ordered_level(spark, sf):
    label = S.case_label("o_orderpriority", {"1-URGENT": "Présent", "2-HIGH": "Absent", "3-MEDIUM": "Non détecté"})
    d = table(spark, sf, "orders").select("o_orderkey", label.alias("statut"))
    return d.withColumn("rang", S.level_rank("statut", PR.STATUS_LEVELS))


@query(
    "proj_link_text",
    """SELECT p_partkey, '<a href=''https://example.org/cd/' || p_partkey || ''' target=''_blank''>' || p_name || '</a>' AS fiche FROM part""",
)
def proj_link_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.link_text("https://example.org/cd/", "p_partkey", "p_name").alias("fiche"))


# -- filters -------------------------------------------------------------------------


@query(
    "filt_in_list",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def filt_in_list(spark, sf):
    kept = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return P.in_table(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), kept, ["o_custkey"])


@query(
    "filt_not_in_list",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def filt_not_in_list(spark, sf):
    gone = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return P.not_in_table(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query(
    "filt_species_recode",
    """SELECT CASE p_brand WHEN 'Brand#25' THEN 'Brand#24' ELSE p_brand END AS code_espece, round(sum(l_quantity), 2) AS effectif
       FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1""",
)
def filt_species_recode(spark, sf):
    d = P.recode_and_filter(lots(spark, sf), "code_espece", ["Brand#1", "Brand#2", "Brand#3"], {"Brand#25": "Brand#24"})
    return sum_by(d, ["code_espece"], "effectif").withColumn("effectif", F.round("effectif", 2))


@query(
    "filt_period",
    """WITH o AS (SELECT o_orderkey, CAST(nullif(year(o_orderdate), 1997) AS INTEGER) AS annee FROM orders)
       SELECT o_orderkey, annee, 'stricte' AS borne FROM o WHERE annee > 1998 OR annee IS NULL
       UNION ALL SELECT o_orderkey, annee, 'incluse' FROM o WHERE annee >= 1998""",
)
def filt_period(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", S.null_if(F.year("o_orderdate"), 1997).alias("annee"))
    strict = d.where(P.period("annee", 1998, inclusive=False, keep_missing=True)).withColumn("borne", F.lit("stricte"))
    closed = d.where(P.period("annee", 1998, inclusive=True, keep_missing=False)).withColumn("borne", F.lit("incluse"))
    return P.stack_aligned(strict, closed)


@query("filt_pattern", f"SELECT o_orderkey, o_orderpriority FROM orders WHERE regexp_matches(o_orderpriority, '{INVENTORY}')")
def filt_pattern(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").where(S.pattern_flag("o_orderpriority", INVENTORY))


@query(
    "filt_zero_is_missing",
    """SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax' AS name, l_tax AS value FROM lineitem WHERE l_tax <> 0
       UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount', l_discount FROM lineitem""",
)
def filt_zero_is_missing(spark, sf):
    d = C.to_long(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_tax", "l_discount"])
    return P.drop_zero_as_missing(d, "name", "value", ["l_tax"])


def _holes(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", S.null_if("l_tax", 0.0).alias("l_tax"), S.null_if("l_discount", 0.0).alias("l_discount")
    )


@query("filt_complete_rows", "SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax <> 0 AND l_discount <> 0")
def filt_complete_rows(spark, sf):
    return P.complete_rows(_holes(spark, sf), ["l_tax", "l_discount"])


@query("filt_nonnull_positive", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_acctbal < 9000 AND c_nationkey <> 3")
def filt_nonnull_positive(spark, sf):
    d = table(spark, sf, "customer").withColumn("code_exutoire", S.null_if("c_nationkey", 3))
    kept = d.where(F.col("code_exutoire").isNotNull() & (F.col("c_acctbal") > 0) & (F.col("c_acctbal") < 9000))
    return kept.select("c_custkey", "c_acctbal")


@query(
    "dq_null_counts",
    """SELECT 'l_orderkey' AS "column", count(*) - count(l_orderkey) AS n_missing FROM lineitem
       UNION ALL SELECT 'l_linenumber', count(*) - count(l_linenumber) FROM lineitem
       UNION ALL SELECT 'l_tax', count(*) - count(nullif(l_tax, 0)) FROM lineitem
       UNION ALL SELECT 'l_discount', count(*) - count(nullif(l_discount, 0)) FROM lineitem""",
)
def dq_null_counts(spark, sf):
    return P.null_counts(_holes(spark, sf))


@query("dq_level_counts", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def dq_level_counts(spark, sf):
    return P.level_counts(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


# -- joins --------------------------------------------------------------------------


@query(
    "join_lookup",
    "SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def join_lookup(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return P.lookup(o, table(spark, sf, "customer"), {"o_custkey": "c_custkey"}, ["c_name", "c_nationkey"])


@query(
    "join_lookup_natural",
    """SELECT c_custkey AS code_station, c_nationkey AS code_exutoire, n_name AS toponyme
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2""",
)
def join_lookup_natural(spark, sf):
    places = table(spark, sf, "customer").select(F.col("c_custkey").alias("code_station"), F.col("c_nationkey").alias("code_exutoire"))
    names = table(spark, sf, "nation").where("n_regionkey <> 2")
    names = names.select(F.col("n_nationkey").alias("code_exutoire"), F.col("n_name").alias("toponyme"))
    return P.lookup(places, names, ["code_exutoire"], check_unique=True)


@query(
    "join_map_all_places",
    """WITH f AS (SELECT o_custkey, min(o_orderpriority) AS statut FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)
       SELECT c_custkey AS code_station, coalesce(statut, 'Non prospecté') AS statut FROM customer LEFT JOIN f ON c_custkey = o_custkey""",
)
def join_map_all_places(spark, sf):
    places = table(spark, sf, "customer").select(F.col("c_custkey").alias("code_station"))
    facts = operations(spark, sf, basin=False).where("annee = 1996").groupBy("code_station").agg(F.min("type_peche").alias("statut"))
    return P.all_places(places, facts, ["code_station"], {"statut": PR.NOT_SURVEYED})


@query(
    "join_right",
    """WITH f AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
       SELECT c_custkey AS code_station, n, c_name FROM f RIGHT JOIN customer ON o_custkey = c_custkey""",
)
def join_right(spark, sf):
    facts = operations(spark, sf, basin=False).where("type_peche = '1-URGENT'").groupBy("code_station").agg(F.count(F.lit(1)).alias("n"))
    places = table(spark, sf, "customer").select(F.col("c_custkey").alias("code_station"), "c_name")
    return facts.join(places, "code_station", "right")


@query(
    "join_fk_enrich",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(o_orderdate AS DATE) AS ope_date, o_orderpriority AS pro_libelle, p_brand, s_name
       FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
            LEFT JOIN supplier ON l_suppkey = s_suppkey""",
)
def join_fk_enrich(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ops = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("ope_date"), F.col("o_orderpriority").alias("pro_libelle")
    )
    links = [
        P.Link("l_orderkey", ops, "o_orderkey", ("ope_date", "pro_libelle")),
        P.Link("l_partkey", table(spark, sf, "part"), "p_partkey", ("p_brand",)),
        P.Link("l_suppkey", table(spark, sf, "supplier"), "s_suppkey", ("s_name",)),
    ]
    return P.enrich(items, links).drop("l_suppkey")


@query(
    "join_multi_card",
    """WITH f AS (SELECT o_custkey, count(*) AS n_peches, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
                         round(sum(o_totalprice), 2) AS total,
                         round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 0), 2) AS total_urgent
                  FROM orders GROUP BY 1)
       SELECT c_custkey AS code_station, n_peches, n_urgent, total, total_urgent FROM customer LEFT JOIN f ON c_custkey = o_custkey""",
)
def join_multi_card(spark, sf):
    urgent = F.col("type_peche") == "1-URGENT"
    facts = (
        operations(spark, sf, basin=False)
        .groupBy("code_station")
        .agg(
            F.count(F.lit(1)).alias("n_peches"),
            F.count_if(urgent).alias("n_urgent"),
            r(F.sum("surface"), 2, "total"),
            r(sum_or_zero(F.when(urgent, F.col("surface"))), 2, "total_urgent"),
        )
    )
    places = table(spark, sf, "customer").select(F.col("c_custkey").alias("code_station"))
    return places.join(facts, "code_station", "left")


@query(
    "join_bridge_text_key",
    """SELECT o_orderkey AS ope_id, CAST(o_custkey AS VARCHAR) AS code_station,
              CASE WHEN o_orderpriority = '5-LOW' THEN 'base B' ELSE 'base A' END AS source_donnee,
              CASE WHEN o_orderpriority <> '5-LOW' AND c_nationkey <> 3 THEN c_custkey * 10 END AS pop_id
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def join_bridge_text_key(spark, sf):
    source = F.when(F.col("type_peche") == "5-LOW", "base B").otherwise("base A")
    facts = operations(spark, sf, basin=False).select("ope_id", "code_station", source.alias("source_donnee"))
    bridge = table(spark, sf, "customer").select(
        (F.col("c_custkey") * 10).alias("pop_id"), F.when(F.col("c_nationkey") != 3, F.col("c_custkey")).alias("sta_id")
    )
    return P.bridge_by_text_key(facts, bridge, "code_station", "sta_id", "source_donnee", "base A", ["pop_id"])


_PLACES = """mr AS (SELECT c_custkey AS code_station, c_acctbal / 1000 AS y, ((c_custkey * 37) % 1009) / 100.0 AS x, ((c_custkey * 53) % 997) / 90.0 AS z FROM customer)"""


def place_rows(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("code_station"), (F.col("c_acctbal") / 1000).alias("y"), point_x(k).alias("x"), point_y(k).alias("z"))


@query(
    "join_positional",
    f"""WITH {_PLACES}, {_ols_ctes('mr', [])},
        res AS (SELECT row_number() OVER (ORDER BY x, z, code_station) AS i, y - (my + bx * (x - mx) + bz * (z - mz)) AS residual FROM mr, fi),
        layer AS (SELECT row_number() OVER (ORDER BY c_custkey DESC) AS i, c_custkey AS code_station, c_name AS toponyme FROM customer)
        SELECT code_station, toponyme, round(residual, 5) AS residual FROM layer JOIN res ON layer.i = res.i""",
)
def join_positional(spark, sf):
    """Residuals beside the rows of a layer, first with first; the two share no key."""
    layer = table(spark, sf, "customer").select(F.col("c_custkey").alias("code_station"), F.col("c_name").alias("toponyme"), (-F.col("c_custkey")).alias("ordre"))
    found = residuals(place_rows(spark, sf), "y", ["x", "z"]).select("residual", "x", "z", F.col("code_station").alias("cle"))
    out = bind_by_position(layer, found, ["ordre"], ["x", "z", "cle"])
    return out.select("code_station", "toponyme", r("residual", 5))


@query(
    "join_residuals_layer",
    f"""WITH {_PLACES}, {_ols_ctes('mr', [])}
        SELECT c_custkey AS code_station, c_name AS toponyme, round(y - (my + bx * (x - mx) + bz * (z - mz)), 5) AS residual
        FROM customer JOIN mr ON c_custkey = code_station, fi""",
)
def join_residuals_layer(spark, sf):
    """The same table as it should be made: residuals joined to the layer by key."""
    layer = table(spark, sf, "customer").select(F.col("c_custkey").alias("code_station"), F.col("c_name").alias("toponyme"))
    found = residuals(place_rows(spark, sf), "y", ["x", "z"]).select("code_station", "residual")
    return layer.join(found, "code_station").select("code_station", "toponyme", r("residual", 5))
