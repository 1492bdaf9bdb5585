import random
from math import asin, atan2, cos, degrees, hypot, pi, radians, sin, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import HOT, rows
from creel.operators import series as TS, spatial as SP

POLY = "array<array<struct<x:double,y:double>>>"


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
                odd = not odd
    return odd


@pytest.mark.parametrize("skew", [{}, HOT])
@pytest.mark.parametrize("edges", [0, 1, 12])
def test_point_in_polygon_brute_force(spark, skew, edges, monkeypatch):
    monkeypatch.setattr(SP, "CELL_EDGES", edges)  # all cells are split, those with several edges, none
    rng = random.Random(4)
    shapes = {
        "diamond": [[(0.0, -2.0), (2.0, 0.0), (0.0, 2.0), (-2.0, 0.0)]],
        "ring": [[(1.0, 1.0), (6.0, 1.0), (6.0, 6.0), (1.0, 6.0)], [(2.0, 2.0), (2.0, 4.0), (4.0, 4.0), (4.0, 2.0)]],
        "closed": [[(-5.0, -5.0), (-3.0, -5.0), (-4.0, -2.0), (-5.0, -5.0)]],
    }
    pts = [(i, rng.uniform(-6, 7), rng.uniform(-6, 7)) for i in range(400)] + [(900, 1.5, 1.5), (901, None, 1.0), (902, 1.5, 1.5)]
    polys = spark.createDataFrame([(n, [[{"x": a, "y": b} for a, b in r] for r in rs]) for n, rs in shapes.items()], f"nom string, rings {POLY}")
    df = spark.createDataFrame(pts, "i int, x double, y double")
    got = SP.point_in_polygon(df, polys, "x", "y", "rings", ["nom"], **skew)
    want = sorted((i, n) for i, x, y in pts if x is not None for n, rs in shapes.items() if inside(rs, x, y))
    assert rows(got.select("i", "nom")) == want


def star(x, y, size, n):
    """A polygon of n corners, alternately far and near."""
    return [(x + size * (1 if i % 2 else 0.9) * cos(2 * pi * i / n), y + size * (1 if i % 2 else 0.9) * sin(2 * pi * i / n)) for i in range(n)]


def test_polygons_of_very_different_size(spark):
    rng = random.Random(8)
    shapes = {"large": [star(3.0, -7.0, 1000.0, 600)], "small": [star(100.0, 50.0, 1.0, 80)], "tiny": [star(-3.3, 2.2, 0.01, 40)]}
    pts = [(rng.uniform(-1100, 1100), rng.uniform(-1100, 1100)) for _ in range(500)]
    pts += [(100 + rng.uniform(-1, 1), 50 + rng.uniform(-1, 1)) for _ in range(300)] + [(-3.3 + rng.uniform(-0.01, 0.01), 2.2 + rng.uniform(-0.01, 0.01)) for _ in range(300)]
    pts += [p for rings in shapes.values() for p in rings[0][:40]]  # corners
    polys = spark.createDataFrame([(n, [[{"x": a, "y": b} for a, b in r] for r in rs]) for n, rs in shapes.items()], f"nom string, rings {POLY}")
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "i int, x double, y double")
    got = SP.point_in_polygon(df, polys, "x", "y", "rings", ["nom"])
    assert rows(got.select("i", "nom")) == sorted((i, n) for i, (x, y) in enumerate(pts) for n, rs in shapes.items() if inside(rs, x, y))
    cells = SP.cell_cover(polys, "rings", ["nom"]).selectExpr("nom", "k", "size(edges) n").collect()
    assert len(cells) < 4000 and any(c.n == 0 for c in cells) and min(c.k for c in cells if c.nom == "large") > max(c.k for c in cells if c.nom == "tiny")
    assert max(c.n for c in cells if c.nom == "large") < 100  # of 600


def test_columns_of_the_grid_may_be_the_users(spark):
    one = spark.range(1).select(SP.rectangle(F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("rings"), F.lit("c").alias("k"), F.lit("e").alias("edges"))
    pts = spark.createDataFrame([(0.5, 0.5, 7)], "x double, y double, cx int")
    assert rows(SP.point_in_polygon(pts, one, "x", "y", "rings", ["k", "edges"])) == [(0.5, 0.5, 7, "c", "e")]
    flat = spark.createDataFrame([([[{"x": 1.0, "y": 1.0}]], "p")], f"rings {POLY}, k string")
    assert SP.point_in_polygon(pts, flat, "x", "y", "rings", ["k"]).count() == 0


def test_boundary_rule(spark):
    one = spark.range(1).select(SP.rectangle(F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("rings"))
    pts = spark.createDataFrame([(0.0, 0.0), (1.0, 0.5), (0.5, 1.0), (0.0, 0.5), (0.5, 0.5), (2.0, 2.0)], "x double, y double")
    got = SP.point_in_polygon(pts, one.withColumn("id", F.lit(1)), "x", "y", "rings", ["id"])
    assert rows(got.select("x", "y")) == [(0.0, 0.0), (0.0, 0.5), (0.5, 0.5)]


def test_centroid_with_hole(spark):
    outer = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(2.0, 1.0), (2.0, 3.0), (4.0, 3.0), (4.0, 1.0)]  # turns the other way
    df = spark.createDataFrame([([[{"x": a, "y": b} for a, b in r] for r in (outer, hole)],), ([[{"x": 1.0, "y": 1.0}]],)], f"rings {POLY}")
    got = SP.with_centroid(df, "rings").select("x_centroid", "y_centroid").collect()
    assert tuple(got[0]) == pytest.approx(((16 * 2 - 4 * 3) / 12, 2.0)) and tuple(got[1]) == (None, None)


def test_centroid_on_the_sphere(spark):
    octant, back = [(0.0, 0.0), (90.0, 0.0), (0.0, 90.0)], [(0.0, 90.0), (90.0, 0.0), (0.0, 0.0)]
    hole = [(10.0, 10.0), (40.0, 10.0), (10.0, 40.0)]  # turns as its ring does
    over = [(170.0, 0.0), (-170.0, 0.0), (-170.0, 1.0), (170.0, 1.0)]
    shapes = [[octant], [back], [octant, hole], [back, hole], [over], [[(1.0, 1.0)]], []]
    df = spark.createDataFrame([(i, [[{"x": a, "y": b} for a, b in ring] for ring in s]) for i, s in enumerate(shapes)], f"i int, rings {POLY}")
    got = [tuple(r) for r in SP.with_spherical_centroid(df, "rings").orderBy("i").select("x_centroid", "y_centroid").collect()]
    middle = (45.0, degrees(asin(1 / sqrt(3))))
    assert got[0] == pytest.approx(middle) and got[1] == pytest.approx(middle)
    # points dealt evenly over the sphere
    n = 400_000
    z = 1 - (2 * np.arange(n) + 1) / n
    turn = np.arange(n) * np.pi * (3 - sqrt(5))
    p = np.stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z], 1)
    corner = [np.array([cos(radians(b)) * cos(radians(a)), cos(radians(b)) * sin(radians(a)), sin(radians(b))]) for a, b in hole]
    within = np.all([p @ np.cross(corner[i], corner[(i + 1) % 3]) > 0 for i in range(3)], axis=0)
    x, y, h = p[(p > 0).all(axis=1) & ~within].sum(axis=0)
    want = (degrees(atan2(y, x)), degrees(atan2(h, hypot(x, y))))
    assert got[2] == pytest.approx(want, abs=0.05) and got[3] == pytest.approx(got[2])
    assert abs(got[4][0]) == pytest.approx(180.0) and 0 < got[4][1] < 1 and got[5] == got[6] == (None, None)


def test_conic_published_example(spark):
    # the projection authority's worked example of the inverse formula (Clarke 1880)
    p = SP.ConicProjection(n=0.760405966, c=11603796.9767, xs=600000.0, ys=5657616.674, lon0=0.04079234433, e=0.0824832568)
    lon, lat = SP.conic_to_lonlat(F.lit(1029705.083), F.lit(272723.849), p)
    got = spark.range(1).select(lon, lat).first()
    assert tuple(got) == pytest.approx((degrees(0.145512099), degrees(0.872664626)), abs=1e-7)


def test_lambert_93_round_trip_and_codes(spark):
    pts = [(lon / 10, lat / 10) for lon in range(-50, 100, 13) for lat in range(412, 512, 9)]
    df = spark.createDataFrame(pts, "lon double, lat double")
    x, y = SP.lonlat_to_conic(F.col("lon"), F.col("lat"))
    df = df.withColumns({"x": x, "y": y})
    back = SP.conic_to_lonlat(F.col("x"), F.col("y"))
    worst = df.select(F.max(F.abs(back[0] - F.col("lon"))), F.max(F.abs(back[1] - F.col("lat")))).first()
    assert max(worst) < 1e-9
    mixed = spark.createDataFrame([(700000.0, 6600000.0, 2154), (3.0, 46.5, 4326), (1.0, 1.0, 27572), (1.0, 1.0, None)], "x double, y double, epsg int")
    got = SP.reproject(mixed, "x", "y", "epsg").collect()
    assert (got[0]["x_wgs84"], got[0]["y_wgs84"]) == pytest.approx((3.0, 46.5), abs=1e-9)
    assert [r["crs_known"] for r in got] == [True, True, False, False] and got[2]["x_wgs84"] is None


def test_baseline_minimum_until(spark):
    df = spark.createDataFrame([(0, 2.0), (1, -8.0), (2, -28.0), (3, -28.0), (40, 0.0)], "t int, l double")
    shifted = TS.baseline(df, "t", "l", before=30)
    assert rows(shifted) == [(0, 0.0), (1, -10.0), (2, -30.0), (3, -30.0)]
    assert rows(TS.minimum(shifted, "t", "l")) == [(2, -30.0), (3, -30.0)]
    assert rows(TS.until_minimum(shifted, "t", "l")) == [(0, 0.0), (1, -10.0)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_inverse_level_brute_force(spark, seed):
    rng = random.Random(seed)
    level, data = 0.0, []
    for t in range(300):
        level += rng.uniform(-3, 2.5)
        if t not in (17, 80):
            data.append((float(t), round(level, 3)))
    asked = [(i, rng.uniform(min(v for _, v in data) - 5, max(v for _, v in data) + 5)) for i in range(200)] + [(900, data[5][1]), (901, None)]
    got = TS.inverse_level(
        spark.createDataFrame(asked, "i int, niveau double"), spark.createDataFrame(data, "t double, l double").repartition(3), "niveau", "t", "l"
    )
    by_time = dict(data)
    want = {}
    for i, q in asked:
        low = next((t for t, v in data if q is not None and v < q), None)
        sup = by_time.get(low - 1) if low is not None else None
        if sup is None or sup == by_time[low]:
            want[i] = None
        else:
            a = by_time[low] - sup
            want[i] = pytest.approx((q - (sup - a * (low - 1))) / a, abs=1e-9)
    assert {r["i"]: r["annee_niveau"] for r in got.collect()} == want


def test_inverse_level_hand_worked(spark):
    series = spark.createDataFrame([(0, 0.0), (1, -10.0), (2, -30.0)], "t int, l double")
    asked = spark.createDataFrame([(-20.0,), (-5.0,), (-99.0,), (3.0,)], "niveau double")
    got = {r[0]: r[1] for r in TS.inverse_level(asked, series, "niveau", "t", "l").collect()}
    assert got == {-20.0: 1.5, -5.0: 0.5, -99.0: None, 3.0: None}
