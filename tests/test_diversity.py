from itertools import combinations
from math import comb, log
import random

import pytest
from pyspark.sql import functions as F

from conftest import HOT, rows
from creel.operators import diversity as D, estimators as E


def test_indices_hand_worked(spark):
    data = [("a", "x", 1.0), ("a", "y", 1.0), ("b", "x", 3.0), ("c", "x", 0.0), ("d", "x", 1.0), ("d", "x", 2.0), ("d", "y", 1.0)]
    df = spark.createDataFrame(data, "s string, sp string, n double")
    got = {r["s"]: tuple(r)[1:] for r in D.indices(df, "s", "sp", "n").collect()}
    assert set(got) == {"a", "b", "d"}
    assert got["a"] == pytest.approx((2, log(2), 0.5, 1.0))
    assert got["b"] == (1, 0.0, 0.0, None)
    h = -(0.75 * log(0.75) + 0.25 * log(0.25))
    assert got["d"] == pytest.approx((2, h, 1 - 0.75**2 - 0.25**2, h / log(2)))


def test_indices_invariants(spark):
    rng = random.Random(3)
    data = [(s, f"x{rng.randrange(12)}", float(rng.randrange(1, 50))) for s in range(60) for _ in range(rng.randrange(1, 9))]
    for r in D.indices(spark.createDataFrame(data, "s int, sp string, n double"), "s", "sp", "n").collect():
        assert 0 <= r["simpson"] < 1 and 0 <= r["shannon"] <= log(r["richesse"]) + 1e-12
        assert (r["pielou"] is None) == (r["richesse"] == 1)


def test_holes_rule_and_missing_counts(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0), ("b", "x", 2.0), ("c", "x", 1.0), ("c", "y", None)], "s string, sp string, n double")
    vocab = spark.createDataFrame([("x",), ("y",)], "sp string")
    got = {r["s"]: r for r in D.indices(df, "s", "sp", "n", holes="missing", vocabulary=vocab).collect()}
    assert got["a"]["shannon"] == pytest.approx(log(2)) and got["b"]["shannon"] is None and got["c"]["simpson"] is None
    with pytest.raises(ValueError):
        D.indices(df, "s", "sp", "n", holes="missing")


def test_presence_indices(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("a", "z")], "s string, sp string")
    got = D.indices_presence(df, "s", "sp").first()
    assert (got["richesse"], got["shannon"], got["simpson"]) == (3, pytest.approx(log(3)), pytest.approx(2 / 3))


def test_latest_model_table_and_positive(spark):
    ind = spark.createDataFrame([(1, 2, 0.5, 0.4, 0.7), (2, 1, 0.0, 0.0, None), (3, 3, 1.0, 0.6, 0.9)], "op int, richesse int, shannon double, simpson double, pielou double")
    # 4 and 5 are later, but hold no individuals, or only of a species with a missing count
    caught = [(1, "a", 2.0), (1, "b", 2.0), (2, "a", 3.0), (3, "a", 1.0), (3, "b", 1.0), (3, "c", 1.0), (4, "a", 0.0), (5, "a", 4.0), (5, "a", None), (6, "a", 1.0)]
    caught = spark.createDataFrame(caught, "op int, sp string, n double")
    ops = [(1, "p", 5), (1, "p", 5), (2, "p", 5), (3, "p", 4), (4, "p", 6), (5, "p", 7), (6, "q", 1), (3, "q", None)]
    bridge = spark.createDataFrame(ops, "op int, pt string, d int")
    last = D.latest_per_point(caught, bridge, "op", "pt", "d", "sp", "n", **HOT)
    got = {r["op"]: r for r in last.collect()}
    assert set(got) == {1, 2} and got[1]["shannon"] == pytest.approx(log(2)) and got[2]["richesse"] == 1  # q has an unknown date
    assert D.indices_long(last, ["op"]).count() == 8
    env = spark.createDataFrame([("p", None, 1.0)], "pop string, alt double, x double")
    assert D.model_table(last, "pt", [(env, {"pt": "pop"})], {"op": "op", "x": "x"}, ["x"]).count() == 2
    assert D.model_table(last, "pt", [(env, {"pt": "pop"})], {"op": "op", "alt": "alt"}, ["alt"]).count() == 0
    assert rows(D.positive_only(ind).select("op")) == [(1,), (3,)]


def test_local_and_regional_brute_force(spark):
    rng = random.Random(5)
    data = [
        (f"b{p % 3}", p, f"x{rng.randrange(6)}", rng.choice([2019, 2020, 2021, None]), rng.choice(["in", "out"]), rng.choice([0, 1, 2]))
        for p in range(24) for _ in range(rng.randrange(1, 8))
    ]
    df = spark.createDataFrame(data, "bv string, pt int, sp string, y int, proto string, n int")
    got = D.local_and_regional(df, "pt", "bv", "sp", "y", F.col("proto") == "in", F.col("n") > 0, min_points=3)
    want = {}
    for b in {d[0] for d in data}:
        inv = [d for d in data if d[0] == b and d[4] == "in"]
        if len({d[1] for d in inv}) <= 3:
            continue
        local, region = [], set()
        for p in {d[1] for d in inv}:
            pres = [d for d in inv if d[1] == p and d[5] > 0 and d[3] is not None]
            if pres:
                kept = {d[2] for d in pres if d[3] == max(x[3] for x in pres)}
                local.append(len(kept))
                region |= kept
        if region:
            want[b] = (len(region), pytest.approx(sum(local) / len(local)))
    assert {r["bv"]: (r["richesse_regionale"], r["richesse_loc_moy"]) for r in got.collect()} == want


def test_operation_richness_and_density(spark):
    lots = spark.createDataFrame([(1, "p", 3, "a"), (1, "p", 3, None), (2, "p", 3, "a"), (3, "q", 1, "a")], "op int, pt string, d int, sp string")
    assert rows(D.operation_richness(lots, "op", "pt", "d", "sp").select("op", "rsl")) == [(1, 2), (3, 1)]
    ops = spark.createDataFrame([(1, "p", 2020, 4.0), (2, "p", 2020, 0.0), (3, "p", 2019, 1.0), (4, "q", 2018, 2.0)], "op int, pt string, y int, surf double")
    catch = spark.createDataFrame([(1, 3.0), (1, None), (1, 5.0)], "op int, n double")
    got = D.density_by_point(ops, catch, "pt", "op", "y", "surf", "n", **HOT)
    assert rows(got.select("op", "effectif", "densite", "log_densite"), "op") == [(1, 8.0, 2.0, pytest.approx(log(2))), (4, 0.0, 0.0, None)]
    rows_bv = spark.createDataFrame([(1, "b", 2020, 3.0, 10.0), (2, "b", 2020, 5.0, 10.0), (3, "b", 2019, 9.0, 10.0), (4, "x", 2020, 1.0, 1.0)], "op int, bv string, y int, n double, area double")
    got = D.density_by_basin(rows_bv, "bv", "y", "n", "area", exclude=["x"], **HOT)
    assert rows(got.select("op", "effectif_bassin", "densite_bassin"), "op") == [(1, 8.0, 0.8), (2, 8.0, 0.8)]


def test_pool_hand_worked(spark):
    df = spark.createDataFrame([("p", 1, "a"), ("p", 1, "b"), ("p", 2, "b"), ("p", 2, "c"), ("q", 9, "a")], "p string, u int, sp string")
    got = {r["p"]: r.asDict() for r in E.pool_estimates(df, "p", "u", "sp").collect()}
    p = got["p"]
    assert (p["n"], p["richesse_observee"], p["chao"], p["jack1"], p["jack2"], p["boot"]) == (2, 3, 4.0, 4.0, 4.0, 3.5)
    assert got["q"]["jack2"] is None and got["q"]["jack1"] == 1.0
    est = E.pool_estimates(df, "p", "u", "sp")
    plain = {r["p"]: r["richesse_absolue_moy_estimateurs"] for r in E.mean_estimate(est, below_observed_missing=False).collect()}
    assert plain == {"p": 3.88, "q": None}
    known = {r["p"]: r["richesse_absolue_moy_estimateurs"] for r in E.mean_estimate(est, below_observed_missing=True).collect()}
    assert known == {"p": 3.88, "q": 1.0}


@pytest.mark.parametrize("block", [4096, 2])
def test_accumulation_equals_enumeration(spark, block):
    rng = random.Random(1)
    held = {s: {u: {f"x{rng.randrange(7)}" for _ in range(rng.randrange(1, 4))} for u in range(n)} for s, n in (("a", 7), ("b", 1), ("c", 5))}
    data = [(s, u, sp) for s, us in held.items() for u, sps in us.items() for sp in sps]
    got = E.accumulation(spark.createDataFrame(data + data[:5], "s string, u int, sp string"), "s", "u", "sp", block=block)
    got = {(r["s"], r["n_opes"]): r["pt_richesse"] for r in got.collect()}
    assert len(got) == 13
    for s, us in held.items():
        n = len(us)
        for k in range(1, n + 1):
            sizes = [len(set().union(*(us[u] for u in pick))) for pick in combinations(range(n), k)]
            assert got[s, k] == pytest.approx(sum(sizes) / len(sizes), abs=1e-10)


def test_missed_share_at_large_counts(spark):
    cases = [(n, f, k) for n in (30, 400, 3000) for f in (1, 2, 17, n // 2, n) for k in (1, 3, n // 3, n - 17, n)]
    cases = [(n, f, k) for n, f, k in cases if f <= n and 1 <= k <= n]
    df = spark.createDataFrame(cases, "n long, f long, k long").withColumn("r", E.missed_share(F.col("n"), F.col("f"), F.col("k")))
    for r in df.collect():
        want = comb(r["n"] - r["f"], r["k"]) / comb(r["n"], r["k"]) if r["n"] - r["f"] >= r["k"] else 0.0
        assert r["r"] == pytest.approx(want, rel=1e-9, abs=1e-300)
    big = spark.range(1).select(E.missed_share(F.lit(10**9), F.lit(10), F.lit(10**8))).first()[0]
    assert big == pytest.approx(0.9**10, rel=1e-7)


def test_well_sampled(spark):
    data = [("a", u, f"x{u % 3}") for u in range(5)] + [("b", u, "x") for u in range(2)] + [("c", u, "x") for u in range(4)]
    labels = spark.createDataFrame([("a", "Pont"), ("a", "Pont"), ("c", None)], "s string, lieu string")
    got = E.accumulation_well_sampled(spark.createDataFrame(data, "s string, u int, sp string"), "s", "u", "sp", 3, labels, "lieu")
    assert {(r["s"], r["lieu"]) for r in got.collect()} == {("a", "a (Pont)"), ("c", "c (Inconnu)")}
    assert got.count() == 9
