"""Polygons, projections and the level series."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.standins import SERIES, level_series, operations, point_x, point_y, r, table
from creel.operators import series as TS, spatial as SP

_PT = "SELECT c_custkey, ((c_custkey * 37) % 1009) / 100.0 AS x, ((c_custkey * 53) % 997) / 90.0 AS y FROM customer"
_BOX = "SELECT n_nationkey, n_name, (n_nationkey % 5) * 2.0 AS x0, (n_nationkey // 5) * 2.0 AS y0 FROM nation"


def station_points(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("code_station"), point_x(k).alias("x"), point_y(k).alias("y"))


def basin_polygons(spark, sf):
    """Overlapping squares, one per basin."""
    k = F.col("n_nationkey")
    x0, y0 = (k % 5) * 2.0, F.floor(k / 5) * 2.0
    return table(spark, sf, "nation").select(
        k.alias("code_exutoire"), F.col("n_name").alias("toponyme"), SP.rectangle(x0, y0, x0 + 2.3, y0 + 2.3).alias("rings")
    )


@query(
    "geo_point_in_polygon",
    f"""WITH p AS ({_PT}), b AS ({_BOX}) SELECT c_custkey AS code_station, n_nationkey AS code_exutoire, n_name AS toponyme FROM p JOIN b
        ON x >= x0 AND x < x0 + 2.3 AND y >= y0 AND y < y0 + 2.3""",
)
def geo_point_in_polygon(spark, sf):
    out = SP.point_in_polygon(station_points(spark, sf), basin_polygons(spark, sf), "x", "y", "rings", ["code_exutoire", "toponyme"])
    return out.select("code_station", "code_exutoire", "toponyme")


_E = "0.08181919104281579"
_ITER = ", ".join(
    f"l{i} AS (SELECT * REPLACE (2 * atan(pow((1 + {_E} * sin(lat)) / (1 - {_E} * sin(lat)), {_E} / 2) * exp(iso)) - pi() / 2 AS lat) FROM l{i - 1})"
    for i in range(1, 7)
)


@query(
    "geo_reproject",
    f"""WITH s AS (SELECT c_custkey, [2154, 4326, 27572][c_nationkey % 3 + 1] AS epsg, CASE c_nationkey % 3 WHEN 0 THEN 100000 + (c_custkey * 37) % 1009 * 300.0 ELSE ((c_custkey * 37) % 1009) / 100.0 END AS x,
               CASE c_nationkey % 3 WHEN 0 THEN 6700000 + (c_custkey * 53) % 997 * 200.0 ELSE ((c_custkey * 53) % 997) / 90.0 END AS y FROM customer),
        l0 AS (SELECT *, iso0 AS iso, 2 * atan(exp(iso0)) - pi() / 2 AS lat FROM (SELECT *, -ln(sqrt(pow(x - 700000, 2) + pow(12655612.0498760 - y, 2)) / 11754255.4260960) / 0.7256077650532670 AS iso0 FROM s)),
        {_ITER}
        SELECT c_custkey AS pop_id, round(CASE epsg WHEN 2154 THEN degrees(radians(3.0) + atan((x - 700000) / (12655612.0498760 - y)) / 0.7256077650532670) WHEN 4326 THEN x END, 9) AS x_wgs84,
               round(CASE epsg WHEN 2154 THEN degrees(lat) WHEN 4326 THEN y END, 9) AS y_wgs84, epsg <> 27572 AS crs_known FROM l6""",
)
def geo_reproject(spark, sf):
    k, kind = F.col("c_custkey"), F.col("c_nationkey") % 3
    conic = kind == 0
    d = table(spark, sf, "customer").select(
        k.alias("pop_id"),
        F.when(conic, 100000 + (k * 37) % 1009 * F.lit(300.0)).otherwise(point_x(k)).alias("x"),
        F.when(conic, 6700000 + (k * 53) % 997 * F.lit(200.0)).otherwise(point_y(k)).alias("y"),
        F.when(conic, 2154).when(kind == 1, 4326).otherwise(27572).alias("epsg"),
    )
    out = SP.reproject(d, "x", "y", "epsg")
    return out.select("pop_id", r("x_wgs84", 9), r("y_wgs84", 9), "crs_known")


@query(
    "geo_centroid",
    f"""WITH p AS ({_PT}) SELECT c_custkey AS code_exutoire, round((3 * x + 3) / 3, 6) AS x_centroid, round((3 * y + 2) / 3, 6) AS y_centroid FROM p""",
)
def geo_centroid(spark, sf):
    def corner(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    x, y = F.col("x"), F.col("y")
    triangle = F.array(F.array(corner(x, y), corner(x + 3, y), corner(x, y + 2)))
    layer = station_points(spark, sf).select(F.col("code_station").alias("code_exutoire"), triangle.alias("rings"))
    return SP.with_centroid(layer, "rings").select("code_exutoire", r("x_centroid"), r("y_centroid"))


def _great_circle_sql(corners: dict[str, tuple[str, str]]) -> str:
    """Centroid on the sphere of a counter-clockwise polygon, from its corners' longitudes and latitudes."""
    names = list(corners)
    unit = ", ".join(
        f"cos(radians({y})) * cos(radians({x})) AS {n}x, cos(radians({y})) * sin(radians({x})) AS {n}y, sin(radians({y})) AS {n}z"
        for n, (x, y) in corners.items()
    )
    edges = " UNION ALL ".join(
        f"SELECT k, {a}y * {b}z - {a}z * {b}y AS nx, {a}z * {b}x - {a}x * {b}z AS ny, {a}x * {b}y - {a}y * {b}x AS nz, {a}x * {b}x + {a}y * {b}y + {a}z * {b}z AS d FROM u"
        for a, b in zip(names, names[1:] + names[:1])
    )
    return f"""u AS (SELECT c_custkey AS k, {unit} FROM p), e AS ({edges}), s AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS s FROM e),
        m AS (SELECT k, sum(nx * atan2(s, d) / s) AS x, sum(ny * atan2(s, d) / s) AS y, sum(nz * atan2(s, d) / s) AS z FROM s GROUP BY 1)
        SELECT k AS code_exutoire, round(degrees(atan2(y, x)), 6) AS x_centroid, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS y_centroid FROM m"""


@query(
    "geo_centroid_sphere",
    f"WITH p AS ({_PT}), " + _great_circle_sql({"u": ("x", "y"), "v": ("x + 30", "y"), "w": ("x", "y + 20")}),
)
def geo_centroid_sphere(spark, sf):
    def corner(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    x, y = F.col("x"), F.col("y")
    clockwise = F.array(F.array(corner(x, y), corner(x, y + 20), corner(x + 30, y)))
    layer = station_points(spark, sf).select(F.col("code_station").alias("code_exutoire"), clockwise.alias("rings"))
    return SP.with_spherical_centroid(layer, "rings").select("code_exutoire", r("x_centroid"), r("y_centroid"))


@query(
    "geo_points_distinct",
    f"""SELECT DISTINCT o_custkey AS code_station, round(((o_custkey * 37) % 1009) / 100.0, 6) AS x_wgs84, round(((o_custkey * 53) % 997) / 90.0, 6) AS y_wgs84 FROM orders""",
)
def geo_points_distinct(spark, sf):
    k = F.col("code_station")
    seen = SP.distinct_places(operations(spark, sf, basin=False), "code_station")
    return seen.select(k, r(point_x(k), 6, "x_wgs84"), r(point_y(k), 6, "y_wgs84"))


# -- level series -----------------------------------------------------------------------

_BASE = f"{SERIES}, base AS (SELECT time, level - (SELECT arg_min(level, time) FROM serie) AS level FROM serie)"


def shifted(spark, sf, before=None):
    return TS.baseline(level_series(spark, sf), "time", "level", before)


@query("ts_baseline", f"WITH {_BASE} SELECT time, round(level, 6) AS level FROM base WHERE time < 30")
def ts_baseline(spark, sf):
    return shifted(spark, sf, 30).select("time", r("level"))


@query("ts_minimum", f"WITH {_BASE} SELECT time, round(level, 6) AS level FROM base WHERE level = (SELECT min(level) FROM base)")
def ts_minimum(spark, sf):
    return TS.minimum(shifted(spark, sf), "time", "level").select("time", r("level"))


@query(
    "ts_until_minimum",
    f"""WITH {_BASE}, k AS (SELECT min(time) AS k FROM base WHERE level = (SELECT min(level) FROM base))
        SELECT time, round(level, 6) AS level FROM base QUALIFY row_number() OVER (ORDER BY time) <= (SELECT k FROM k)""",
)
def ts_until_minimum(spark, sf):
    return TS.until_minimum(shifted(spark, sf), "time", "level").select("time", r("level"))


@query(
    "ts_inverse_interp",
    f"""WITH {_BASE}, q AS (SELECT c_custkey, ((c_custkey * 61) % 801 - 400) / 40.0 AS niveau FROM customer),
        f AS (SELECT c_custkey, niveau, min(time) AS t FROM q LEFT JOIN base ON level < niveau GROUP BY 1, 2)
        SELECT c_custkey, round(niveau, 6) AS niveau, round(t + (niveau - i.level) / (i.level - s.level), 6) AS annee_niveau
        FROM f LEFT JOIN base i ON i.time = t LEFT JOIN base s ON s.time = t - 1""",
)
def ts_inverse_interp(spark, sf):
    k = F.col("c_custkey")
    asked = table(spark, sf, "customer").select("c_custkey", (((k * 61) % 801 - 400) / F.lit(40.0)).alias("niveau"))
    out = TS.inverse_level(asked, shifted(spark, sf), "niveau", "time", "level")
    return out.select("c_custkey", r("niveau"), r("annee_niveau"))
