"""Row numbers, positional binding and running minima over several ranges, and the series on top of them."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from creel.operators import order as O, series as TS
from creel.plans import levels as L


@pytest.fixture
def ranges(spark):
    """Several ranges also for small tables."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_numbered_is_the_order(ranges):
    rng = random.Random(1)
    data = [(rng.choice([None, 1, 1, 1, 2, rng.randrange(1000)]), i) for i in range(2000)]
    df = ranges.createDataFrame(data, "k int, i int").repartition(5)
    want = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert rows(O.numbered(df, ["k"]), "rang_ligne") == [(*x, n) for n, x in enumerate(want)]
    sizes = [n for _, n in O.ranged(df, ["k"]).groupBy(O.RANGE).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 800  # half of the rows have k = 1, in several ranges
    assert O.numbered(df.limit(0), ["k"]).count() == 0


def test_equal_rows_get_numbers_of_their_own(ranges):
    df = ranges.createDataFrame([(1,)] * 50, "k int")
    assert [n for _, n in rows(O.numbered(df, ["k"]))] == list(range(50))


def test_bind(ranges):
    a = ranges.createDataFrame([(i, f"a{i:03}") for i in range(300)], "i int, a string").repartition(4)
    b = ranges.createDataFrame([(f"b{i:03}", -i) for i in range(300)], "b string, j int").repartition(3)
    got = rows(O.bind_by_position(a, b, ["a"], ["j"]), "i")
    assert got == [(i, f"a{i:03}", f"b{299 - i:03}", i - 299) for i in range(300)]
    with pytest.raises(ValueError):
        O.bind_by_position(a, a, ["a"], ["a"])
    with pytest.raises(Exception, match="differ in length"):
        O.bind_by_position(a, b.where("j <> -5"), ["a"], ["j"]).collect()


def first_below(data, asked, step):
    by_time, out = dict(data), []
    for q in asked:
        low = next((t for t, v in data if q is not None and v < q), None)
        sup = by_time.get(low - step) if low is not None else None
        gone = sup is None or sup == by_time[low]
        out.append(None if gone else pytest.approx(low + (q - by_time[low]) * step / (by_time[low] - sup), abs=1e-9))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_of_a_series_that_crowds_at_one_end(ranges, seed):
    rng = random.Random(seed)
    level, data = 0.0, []
    for t in [*range(400), *range(10**6, 10**6 + 5), 10**9]:
        level += rng.uniform(-3, 2.5)
        if t != 33:
            data.append((float(t), round(level, 3)))
    lows = [v for _, v in data]
    asked = [rng.uniform(min(lows) - 5, max(lows) + 5) for _ in range(150)] + [data[5][1]] * 60 + [None, min(lows), max(lows) + 1]
    df = ranges.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, niveau double")
    series = ranges.createDataFrame(data, "t double, l double").repartition(6)
    got = TS.inverse_level(df, series, "niveau", "t", "l").select("i", "annee_niveau")
    assert [y for _, y in rows(got, "i")] == first_below(data, asked, 1.0)
    assert TS.inverse_level(df, series.limit(0), "niveau", "t", "l").where("annee_niveau is not null").count() == 0


def test_until_minimum_counts_rows(ranges):
    data = [(t, float((t - 40) ** 2)) for t in range(100)]
    df = ranges.createDataFrame(data, "t int, l double").repartition(5)
    assert rows(TS.until_minimum(df, "t", "l"), "t") == data[:40]
    assert TS.until_minimum(df.limit(0), "t", "l").count() == 0


def test_level_to_time_by_hand(ranges):
    series = ranges.createDataFrame([(0, 5.0), (1, -5.0), (2, -25.0), (3, -45.0), (4, 0.0), (5, -90.0)], "t int, l double")
    asked = ranges.createDataFrame([(-20.0,), (-5.0,), (-35.0,), (-60.0,)], "niveau double")
    # shifted by 5, cut before its minimum at 3: 0, -10, -30
    got = {x[0]: x[1] for x in L.level_to_time(asked, series, "niveau", "t", "l", before=5).collect()}
    assert got == {-20.0: 1.5, -5.0: 0.5, -35.0: None, -60.0: None}
