"""Points, polygons and the two coordinate systems in use.

A polygon is an array of rings, a ring an array of ``struct<x, y>``. Parity over
all rings decides inside/outside, so holes and several parts need no marking.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import pi

from pyspark.sql import Column, DataFrame, functions as F

from creel.operators.grouping import salted_join
from creel.sources.tables import materialise


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Counter-clockwise single-ring polygon of a rectangle."""

    def pt(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return F.array(F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1)))


def ring_edges(rings: Column) -> Column:
    """All edges of all rings as ``struct<x1, y1, x2, y2>``; rings close themselves."""

    def edges(ring: Column) -> Column:
        last = F.size(ring) - 1
        return F.transform(
            ring,
            lambda p, i: F.struct(
                p["x"].alias("x1"),
                p["y"].alias("y1"),
                F.get(ring, F.when(i < last, i + 1).otherwise(0))["x"].alias("x2"),
                F.get(ring, F.when(i < last, i + 1).otherwise(0))["y"].alias("y2"),
            ),
        )

    return F.flatten(F.transform(rings, edges))


def covers(edges: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside. On a boundary, low x and low y edges belong to the polygon."""
    crossed = F.filter(
        edges,
        lambda e: ((e["y1"] > y) != (e["y2"] > y))
        & (x < e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))),
    )
    return F.size(crossed) % 2 == 1


# a border cell with more edges than this is split into 8 x 8, and its parts again, so many times
CELL_EDGES, SPLITS = 12, 2


# steps on a cell (k, cx, cy, edges, flip, done); as text, since they are long and built for every split
_CORNERS = ["cx * s AS x0", "cy * s AS y0", "(cx + 1) * s AS x1", "(cy + 1) * s AS y1"]
# edges that can decide about a point of the cell
_DECIDE = "filter(edges, e -> least(e.y1, e.y2) <= y1 AND greatest(e.y1, e.y2) >= y0 AND greatest(e.x1, e.x2) >= x0)"
# edges that are crossed from every point of the cell
_THROUGH = "least(e.x1, e.x2) > x1 AND least(e.y1, e.y2) <= y0 AND greatest(e.y1, e.y2) >= y1"
# which side of an edge a corner is on
_SIDE = "(e.x2 - e.x1) * ({y} - e.y1) - (e.y2 - e.y1) * ({x} - e.x1)"
_SIDES = ", ".join(_SIDE.format(x=x, y=y) for x in ("x0", "x1") for y in ("y0", "y1"))
# rounding of these products; a cell that is taken for a border cell costs a test, no more
_SLACK = "1e-14 * (abs(e.x2 - e.x1) * (abs(y0) + abs(y1) + abs(e.y1)) + abs(e.y2 - e.y1) * (abs(x0) + abs(x1) + abs(e.x1)))"
# whether an edge may pass through the cell: their boxes meet and the cell is not all on one side of it
_TOUCHES = f"least(e.x1, e.x2) <= x1 AND greatest(e.x1, e.x2) >= x0 AND least({_SIDES}) <= {_SLACK} AND greatest({_SIDES}) >= -{_SLACK}"
_PART = "struct(k - 3 AS k, cx * 8 + i % 8 AS cx, cy * 8 + i div 8 AS cy, edges, flip, false AS done)"
_SELF = "array(struct(k, cx, cy, if(even, slice(edges, 1, 0), edges) AS edges, flip, true AS done))"


def cell_cover(polygons: DataFrame, rings: str, columns: Sequence[str]) -> DataFrame:
    """Cells of grids with sides 2 ** k that together cover each polygon: k, cx, cy, edges, flip, columns.

    A polygon begins with at most 2 x 2 cells of about its own size, so nothing has to
    be known about sizes. A cell that no edge passes through is inside, and has no edges,
    or is left out. A border cell carries the edges that decide about its points: those
    in its band of y and not to its left. Edges wholly to its right that run through the
    whole band are crossed from every point, so only whether their number is odd is kept,
    as ``flip``. A cell with many edges is split into 8 x 8.
    """
    vertices = F.flatten(F.col(rings))
    xs, ys = F.transform(vertices, lambda p: p["x"]), F.transform(vertices, lambda p: p["y"])
    box = polygons.select(
        *columns, ring_edges(F.col(rings)).alias("edges"), F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1")
    )
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    # every third, so that polygons of all sizes share few grids
    box = box.where(extent > 0).withColumn("k", (3 * F.ceil(F.log2(extent) / 3)).cast("int"))

    def side(k: Column) -> Column:
        return F.pow(F.lit(2.0), k.cast("double"))

    def span(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(low) / side(F.col("k"))), F.floor(F.col(high) / side(F.col("k"))))

    cells = box.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    cells = cells.select(*columns, "k", "cx", "cy", "edges", F.lit(False).alias("flip"), F.lit(False).alias("done"))
    for split in range(SPLITS + 1):
        cells = cells.selectExpr("*", "pow(2D, cast(k AS double)) AS s").selectExpr("*", *_CORNERS)
        cells = cells.withColumn("edges", F.expr(f"if(done, edges, {_DECIDE})"))
        flip = F.expr(f"if(done, flip, flip <> (size(filter(edges, e -> {_THROUGH})) % 2 = 1))")
        cells = cells.withColumns({"flip": flip, "edges": F.expr(f"if(done, edges, filter(edges, e -> NOT ({_THROUGH})))")})
        cells = cells.withColumn("even", F.expr(f"NOT done AND NOT exists(edges, e -> {_TOUCHES})"))
        middle = covers(F.col("edges"), (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
        cells = cells.where(~F.col("even") | (middle != F.col("flip")))
        ended = f"done OR even OR size(edges) <= {CELL_EDGES}" if split < SPLITS else "true"
        cells = cells.selectExpr(*columns, f"inline(if({ended}, {_SELF}, transform(sequence(0, 63), i -> {_PART})))")
    return cells.drop("done")


def point_in_polygon(
    points: DataFrame,
    polygons: DataFrame,
    x: str,
    y: str,
    rings: str,
    columns: Sequence[str],
    **skew: int,
) -> DataFrame:
    """Attach polygon columns to the points inside; points in no polygon are dropped.

    A point in two polygons gives two rows. Polygons are cut into cells of grids that
    follow their sizes (:func:`cell_cover`); a point carries its cell of each grid in
    use, and the join is an equi-join on the cell. Points in cells wholly inside are
    done; in border cells the few edges there decide. Points crowding in one cell are
    split over several tasks.
    """
    renamed = {c: f"__c{i}" for i, c in enumerate(columns)}
    listed = materialise(cell_cover(polygons.withColumnsRenamed(renamed), rings, list(renamed.values())))
    listed = listed.withColumnsRenamed({"k": "__k", "cx": "__cx", "cy": "__cy", "edges": "__edges", "flip": "__flip"})
    # the exponents of the grids in use: a few dozen numbers at most
    grids = listed.agg(F.collect_set("__k")).scalar()
    placed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__k", F.explode(grids))
    size = F.pow(F.lit(2.0), F.col("__k").cast("double"))
    placed = placed.withColumns({"__cx": F.floor(F.col(x) / size), "__cy": F.floor(F.col(y) / size)})
    joined = salted_join(placed, listed, ["__k", "__cx", "__cy"], "inner", **skew)
    inside = joined.where((F.size("__edges") == 0) | (covers(F.col("__edges"), F.col(x), F.col(y)) != F.col("__flip")))
    return inside.select(*points.columns, *[F.col(new).alias(old) for old, new in renamed.items()])


def centroid(rings: Column) -> tuple[Column, Column]:
    """Area-weighted planar centroid; holes must turn against their outer ring."""

    def total(f) -> Column:
        return F.aggregate(ring_edges(rings), F.lit(0.0), lambda acc, e: acc + f(e))

    def cross(e: Column) -> Column:
        return e["x1"] * e["y2"] - e["x2"] * e["y1"]

    area2 = total(cross)
    cx = F.try_divide(total(lambda e: (e["x1"] + e["x2"]) * cross(e)), area2 * 3)
    cy = F.try_divide(total(lambda e: (e["y1"] + e["y2"]) * cross(e)), area2 * 3)
    return cx, cy


def with_centroid(polygons: DataFrame, rings: str, x: str = "x_centroid", y: str = "y_centroid") -> DataFrame:
    cx, cy = centroid(F.col(rings))
    return polygons.withColumns({x: cx, y: cy})


def spherical_centroid(rings: Column) -> Column:
    """Centroid on the sphere as ``struct<x, y>`` of degrees, edges being parts of great circles.

    The sum of the positions of a region is half the sum, over its edges, of the edge's
    angle times the unit normal of its plane. Rings may turn either way: what lies within
    an odd number of the other rings is a hole. Each ring must lie well within half the
    sphere; a polygon without area has no centroid. Rounding is about 1e-16 over the
    area in square radians, so a metre for a polygon of 200 m.
    """
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "xyz"])

    def vector(p: Column) -> Column:
        lon, lat = F.radians(p["x"]), F.radians(p["y"])
        return F.struct((F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))

    def dot(a: Column, b: Column) -> Column:
        return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]

    def scaled(a: Column, by: Column) -> Column:
        return F.struct(*[(a[c] * by).alias(c) for c in "xyz"])

    def total(vectors: Column) -> Column:
        return F.aggregate(vectors, zero, lambda acc, v: F.struct(*[(acc[c] + v[c]).alias(c) for c in "xyz"]))

    def edge(a: Column, b: Column) -> Column:
        normal = [(a[p] * b[q] - a[q] * b[p]).alias(c) for c, p, q in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))]
        return F.struct(F.struct(*normal).alias("n"), dot(a, b).alias("d"))

    def weighed(e: Column) -> Column:
        length = F.sqrt(dot(e["n"], e["n"]))
        return scaled(e["n"], F.when(length > 0, F.atan2(length, e["d"]) / length).otherwise(0.0))

    def around(vectors: Column) -> Column:
        following = F.concat(F.slice(vectors, 2, F.size(vectors)), F.slice(vectors, 1, 1))
        return total(F.transform(F.zip_with(vectors, following, edge), weighed))

    def is_hole(ring: Column, i: Column) -> Column:
        start = F.get(ring, F.lit(0))
        outside = F.filter(rings, lambda other, j: (i != j) & covers(ring_edges(F.array(other)), start["x"], start["y"]))
        return F.size(outside) % 2 == 1

    corners = F.transform(rings, lambda ring, i: F.struct(F.transform(ring, vector).alias("v"), is_hole(ring, i).alias("hole")))
    sums = F.transform(corners, lambda r: F.struct(around(r["v"]).alias("m"), total(r["v"]).alias("c"), r["hole"].alias("hole")))
    whole = total(F.transform(sums, lambda s: scaled(s["m"], F.when((dot(s["m"], s["c"]) < 0) != s["hole"], -1.0).otherwise(1.0))))
    # a place of its own, so that the sum is found once
    place = F.transform(
        F.array(whole),
        lambda m: F.when(
            dot(m, m) > 0,
            F.struct(
                F.degrees(F.atan2(m["y"], m["x"])).alias("x"),
                F.degrees(F.atan2(m["z"], F.sqrt(m["x"] * m["x"] + m["y"] * m["y"]))).alias("y"),
            ),
        ),
    )
    return F.get(place, F.lit(0))


def with_spherical_centroid(polygons: DataFrame, rings: str, x: str = "x_centroid", y: str = "y_centroid") -> DataFrame:
    place = spherical_centroid(F.col(rings))
    return polygons.withColumns({x: place["x"], y: place["y"]})


@dataclass(frozen=True)
class ConicProjection:
    """Lambert conformal conic constants: exponent, radius scale, pole offset, meridian, eccentricity."""

    n: float
    c: float
    xs: float
    ys: float
    lon0: float
    e: float


# Published constants of Lambert-93 (EPSG 2154) on GRS80.
LAMBERT_93 = ConicProjection(
    n=0.7256077650532670,
    c=11754255.4260960,
    xs=700000.0,
    ys=12655612.0498760,
    lon0=3.0 * pi / 180.0,
    e=0.08181919104281579,
)


def conic_to_lonlat(x: Column, y: Column, p: ConicProjection = LAMBERT_93) -> tuple[Column, Column]:
    """Longitude and latitude in degrees.

    The latitude is the usual series in the conformal latitude (to e⁸, below a
    tenth of a millimetre), so the expression stays small; unrolled iterations
    would double it each time.
    """
    dx, dy = x - F.lit(p.xs), F.lit(p.ys) - y
    lon = F.lit(p.lon0) + F.atan(dx / dy) / F.lit(p.n)
    conformal = F.lit(pi / 2) - F.lit(2.0) * F.atan(F.pow(F.sqrt(dx * dx + dy * dy) / F.lit(p.c), F.lit(1 / p.n)))
    e2 = p.e * p.e
    series = [
        e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360,
        7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520,
        7 * e2**3 / 120 + 81 * e2**4 / 1120,
        4279 * e2**4 / 161280,
    ]
    lat = conformal
    for k, a in enumerate(series, 1):
        lat = lat + F.lit(a) * F.sin(conformal * (2.0 * k))
    return F.degrees(lon), F.degrees(lat)


def lonlat_to_conic(lon: Column, lat: Column, p: ConicProjection = LAMBERT_93) -> tuple[Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    es = F.lit(p.e) * F.sin(phi)
    iso = F.ln(F.tan(F.lit(pi / 4) + phi / 2) * F.pow((1 - es) / (1 + es), F.lit(p.e / 2)))
    r = F.lit(p.c) * F.exp(-F.lit(p.n) * iso)
    angle = F.lit(p.n) * (lam - F.lit(p.lon0))
    return F.lit(p.xs) + r * F.sin(angle), F.lit(p.ys) - r * F.cos(angle)


def reproject(df: DataFrame, x: str, y: str, code: str, lon: str = "x_wgs84", lat: str = "y_wgs84") -> DataFrame:
    """Longitude/latitude from per-row projection codes 2154 and 4326.

    Any other code gives missing coordinates and ``crs_known`` false.
    """
    px, py = conic_to_lonlat(F.col(x), F.col(y))
    is_conic, is_lonlat = F.col(code) == 2154, F.col(code) == 4326
    return df.withColumns(
        {
            lon: F.when(is_conic, px).when(is_lonlat, F.col(x)),
            lat: F.when(is_conic, py).when(is_lonlat, F.col(y)),
            "crs_known": F.coalesce(is_conic | is_lonlat, F.lit(False)),
        }
    )


def distinct_places(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()
