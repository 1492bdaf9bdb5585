import pytest
from pyspark.sql import functions as F

from conftest import HOT, rows
from creel.operators import grouping as G, prepare as P


@pytest.fixture
def visits(spark):
    data = [(i, None if i % 11 == 0 else ("hot" if i % 3 else f"p{i % 7}"), i % 13) for i in range(400)]
    return spark.createDataFrame(data, "op int, pt string, d int").repartition(3)


@pytest.mark.parametrize("skew", [{}, HOT, {"min_rows": 100, "share": 1024}, {"min_rows": 1, "share": 3}])
def test_group_values_with_and_without_hot_groups(visits, skew):
    out = G.with_group_values(visits, ["pt"], {"m": F.max("d"), "n": F.count(F.lit(1))}, **skew)
    data = [tuple(r) for r in visits.collect()]
    want = []
    for op, pt, d in data:
        same = [x for x in data if x[1] == pt]
        want.append((op, pt, d, max(x[2] for x in same), len(same)))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("skew", [{}, HOT])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, visits, skew, how):
    dim = spark.createDataFrame([("hot", 1), ("hot", 2), ("p1", 3), ("zz", 4)], "pt string, v int")
    got = G.salted_join(visits, dim, ["pt"], how, **skew)
    want = visits.join(dim, "pt", how)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_equal_rows_of_a_hot_group_spread(spark):
    copies = spark.range(6400).select(F.lit("same").alias("k")).repartition(8)
    per_salt = copies.groupBy(G.spread_salt(copies).alias("s")).count().collect()
    assert len(per_salt) > 1


def test_latest_ties_and_one(spark):
    data = [(1, "a", 5), (2, "a", 5), (3, "a", 4), (4, "b", 1), (5, "c", None), (6, "c", 2), (7, None, 3)]
    df = spark.createDataFrame(data, "op int, pt string, d int")
    for skew in ({}, HOT):
        assert rows(G.latest_with_ties(df, ["pt"], "d", **skew).select("op"), "op") == [(1,), (2,), (4,), (6,), (7,)]
        strict = G.latest_with_ties(df, ["pt"], "d", strict_dates=True, **skew)
        assert rows(strict.select("op"), "op") == [(1,), (2,), (4,), (7,)]
    assert rows(G.latest_one(df, ["pt"], "d", ["op"]).select("op"), "op") == [(1,), (4,), (6,), (7,)]


def test_samples_repeat_whatever_the_partitions(visits):
    a = rows(G.sample_n(visits.repartition(1), 20, ["op"], seed=4), "op")
    assert a == rows(G.sample_n(visits.repartition(7), 20, ["op"], seed=4), "op") and len(a) == 20
    assert a != rows(G.sample_n(visits, 20, ["op"], seed=5), "op")
    one = G.sample_one_per_group(visits, ["pt"], ["op"], seed=1)
    assert one.count() == visits.select("pt").distinct().count()
    assert rows(one, "op") == rows(G.sample_one_per_group(visits.repartition(1), ["pt"], ["op"], seed=1), "op")


def test_merge_all_but(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, 2.0), ("b", 1, None)], "k string, y int, n double")
    assert rows(G.merge_all_but(df, "n"), "k") == [("a", None, 3.0), ("b", 1, 0.0)]


def test_periods(spark):
    df = spark.createDataFrame([(2013,), (2014,), (2015,), (None,)], "y int")
    assert [r[0] for r in df.where(P.period("y", 2014, inclusive=False, keep_missing=True)).collect()] == [2015, None]
    assert [r[0] for r in df.where(P.period("y", 2014, inclusive=True, keep_missing=False)).collect()] == [2014, 2015]


def test_zero_as_missing_three_valued(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("a", None), ("b", None), ("a", 1.0)], "name string, value double")
    kept = P.drop_zero_as_missing(df, "name", "value", ["a"])
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [("b", 0.0), ("b", None), ("a", 1.0)]))


def test_recode_and_filter_keeps_missing(spark):
    df = spark.createDataFrame([("TRM",), ("PCC",), (None,), ("GAR",)], "sp string")
    out = P.recode_and_filter(df, "sp", ["PCC"], {"TRM": "TRF"})
    assert [r[0] for r in out.collect()] == ["TRF", None, "GAR"]


def test_lookup_rejects_duplicate_keys(spark):
    fact = spark.createDataFrame([(1,), (None,)], "k int")
    dim = spark.createDataFrame([(1, "x"), (1, "y")], "id int, v string")
    with pytest.raises(P.DuplicateKeyError):
        P.lookup(fact, dim, {"k": "id"}, ["v"], check_unique=True)
    nulls = spark.createDataFrame([(None, "n")], "id int, v string")
    assert rows(P.lookup(fact, nulls, {"k": "id"}, ["v"], null_safe=True), "k") == [(None, "n"), (1, None)]
    assert rows(P.lookup(fact, nulls, {"k": "id"}, ["v"]), "k") == [(None, None), (1, None)]


def test_all_places_and_bridge(spark):
    places = spark.createDataFrame([(1,), (2,)], "p int")
    facts = spark.createDataFrame([(1, "Absent")], "p int, s string")
    assert rows(P.all_places(places, facts, ["p"], {"s": "Non prospecté"}), "p") == [(1, "Absent"), (2, "Non prospecté")]
    recs = spark.createDataFrame([(7, "base A"), (7, "base B"), (8, "base A")], "st int, src string")
    bridge = spark.createDataFrame([(7, 70), (7, 70), (None, 1)], "sta int, pop int")
    out = P.bridge_by_text_key(recs, bridge, "st", "sta", "src", "base A", ["pop"])
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [("7", "base A", 70), ("7", "base B", None), ("8", "base A", None)]))


def test_stack_and_difference(spark):
    a = spark.createDataFrame([(1, "x")], "k int, t string")
    b = spark.createDataFrame([(2, 5.0)], "k int, v double")
    assert rows(P.stack_sources(a, b), "k") == [(1, "x", None), (2, None, 5.0)]
    c = spark.createDataFrame([("y", 9.0, 3)], "t string, v double, k int")
    assert rows(P.stack_aligned(a, c), "k") == [(1, "x"), (3, "y")]
    d = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert rows(P.set_difference(d, d.where("k = 2"))) == [(1,)]
    assert rows(P.null_counts(a.unionByName(b, True)), "column") == [("k", 0), ("t", 1), ("v", 1)]


def test_dealt_bounds_the_rows_of_a_task(spark):
    df = spark.range(4000).select((F.col("id") % 1000).alias("k"), "id")
    out = G.dealt(df, ["k"], 4000, most=200)
    assert out.rdd.getNumPartitions() == 20
    place = out.select("k", F.spark_partition_id().alias("p"))
    assert place.groupBy("k").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0
    assert place.groupBy("p").count().agg(F.max("count")).first()[0] < 2 * 200
    assert rows(out) == rows(df)
    # as many tasks as there are cores, and an empty table, are left to Spark
    assert G.dealt(df, ["k"], 4000, most=1000) is df and G.dealt(df.limit(0), ["k"], 0).count() == 0
