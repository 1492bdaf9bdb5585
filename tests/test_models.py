import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from creel.functions.probability import two_sided_t
from creel.operators import environment as E, quantiles as Q, regression as R
from creel.operators.absorption import factor_models


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 300
    x, z = rng.normal(5, 2, n), rng.normal(-3, 1, n)
    f = rng.integers(0, 3, n)
    y = 2 + 0.5 * x - 1.5 * z + np.array([0, 1, -1])[f] + rng.normal(0, 1, n)
    w = 1 + 0.02 * x + rng.normal(0, 1, n)
    g = rng.integers(0, 4, n)
    return {"x": x, "z": z, "f": f, "y": y, "w": w, "g": g}


@pytest.fixture(scope="module")
def frame(spark, data):
    recs = [(float(a), float(b), "ABC"[c], float(d), float(e), int(h)) for a, b, c, d, e, h in zip(*[data[k] for k in "xzfywg"])]
    return spark.createDataFrame(recs + [(None, 1.0, "A", 1.0, 1.0, 0), (1.0, 1.0, None, None, 2.0, 0)], "x double, z double, f string, y double, w double, g int").repartition(5)


def ols(cols, y, intercept=True):
    m = np.column_stack(([np.ones(len(y))] if intercept else []) + list(cols))
    b, *_ = np.linalg.lstsq(m, y, rcond=None)
    rss = float(((y - m @ b) ** 2).sum())
    df = len(y) - m.shape[1]
    se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * rss / df)
    return b, se, rss, df


def test_t_distribution_known_values():
    # published quantiles of Student's t
    for t, df, p in [(12.7062, 1, 0.05), (2.2281, 10, 0.05), (3.1693, 10, 0.01), (1.9600, 10**7, 0.05), (0.0, 5, 1.0), (2.0150, 5, 0.1)]:
        assert R._two_sided_t(t, df) == pytest.approx(p, abs=2e-5)
    # one and two degrees of freedom have closed forms
    for t in (0.1, 1.0, 7.5):
        assert R._two_sided_t(t, 1) == pytest.approx(1 - 2 / np.pi * np.arctan(t), rel=1e-10)
        assert R._two_sided_t(t, 2) == pytest.approx(1 - t / np.sqrt(2 + t * t), rel=1e-9)


def test_linear_models_match_lstsq(frame, data):
    got = R.linear_models(frame, ["y", "w"], ["x", "z"]).collect()
    extra = {"y": ([], [], []), "w": ([1.0], [1.0], [2.0])}  # the row without y still serves w
    for resp in ("y", "w"):
        x = np.append(data["x"], extra[resp][0])
        z = np.append(data["z"], extra[resp][1])
        y = np.append(data[resp], extra[resp][2])
        b, se, rss, df = ols([x, z], y)
        terms = sorted((r for r in got if r["response"] == resp), key=lambda r: r["term_order"])
        assert [r["term"] for r in terms] == ["(Intercept)", "x", "z"]
        assert [r["estimate"] for r in terms] == pytest.approx(b) and [r["std_error"] for r in terms] == pytest.approx(se)
        assert terms[0]["n"] == len(y) and terms[0]["df_residual"] == df and terms[0]["rss"] == pytest.approx(rss)
        r2 = 1 - rss / ((y - y.mean()) ** 2).sum()
        assert terms[0]["r2"] == pytest.approx(r2) and terms[0]["adj_r2"] == pytest.approx(1 - (1 - r2) * (len(y) - 1) / df)
        n = len(y)
        assert terms[0]["aic"] == pytest.approx(n * (np.log(2 * np.pi) + np.log(rss / n) + 1) + 2 * 4)


def test_factor_and_groups(frame, data):
    got = R.linear_models(frame, ["y"], ["x", "f"], factors={"f": ["A", "B", "C"]})
    b, *_ = ols([data["x"], data["f"] == 1, data["f"] == 2], data["y"])
    assert {r["term"]: r["estimate"] for r in got.collect()} == pytest.approx(dict(zip(["(Intercept)", "x", "fB", "fC"], b)))
    by = R.linear_models(frame.where("y is not null and x is not null"), ["y"], ["x"], by=["g"]).where("term = 'x'")
    for r in by.collect():
        keep = data["g"] == r["g"]
        assert r["estimate"] == pytest.approx(ols([data["x"][keep]], data["y"][keep])[0][1])


def test_dependent_predictor_has_no_estimate(frame):
    df = frame.withColumn("x2", F.col("x") * 2 + 1)
    got = {r["term"]: r["estimate"] for r in R.linear_models(df, ["y"], ["x", "x2", "z"]).collect()}
    plain = {r["term"]: r["estimate"] for r in R.linear_models(df, ["y"], ["x", "z"]).collect()}
    assert got.pop("x2") is None and got == pytest.approx(plain)


def test_quadratic_without_intercept(frame, data):
    got = {r["term"]: r for r in R.quadratic(frame, "y", "x", intercept=False).collect()}
    b, se, rss, df = ols([data["x"], data["x"] ** 2], data["y"], intercept=False)
    assert [got[t]["estimate"] for t in ("x", "x^2")] == pytest.approx(b)
    assert got["x"]["r2"] == pytest.approx(1 - rss / (data["y"] ** 2).sum())


def test_step_follows_brute_force_path(spark):
    rng = np.random.default_rng(11)
    n = 120
    cols = {f"v{i}": rng.normal(0, 1, n) for i in range(5)}
    fac = rng.integers(0, 3, n)
    y = cols["v0"] + 0.25 * cols["v1"] + rng.normal(0, 1, n)
    df = spark.createDataFrame([(float(y[i]), *[float(cols[c][i]) for c in cols], "abc"[fac[i]]) for i in range(n)], "y double, " + ", ".join(f"{c} double" for c in cols) + ", f string")
    blocks = {**{c: [cols[c]] for c in cols}, "f": [fac == 1, fac == 2]}

    def aic(names):
        m = [c for b in names for c in blocks[b]]
        rss = ols(m, y)[2] if m else ((y - y.mean()) ** 2).sum()
        return n * np.log(rss / n) + 2 * (len(m) + 1)

    names = list(blocks)
    while names:
        best = min((aic([x for x in names if x != d]), d) for d in names)
        if best[0] >= aic(names):
            break
        names.remove(best[1])
    got = R.linear_models(df, ["y"], [*cols, "f"], factors={"f": ["a", "b", "c"]}, step=True)
    kept = {r["term"] for r in got.collect()} - {"(Intercept)"}
    assert kept == {t for b in names for t in ({"fb", "fc"} if b == "f" else {b})}


def test_model_table_and_subsets(frame, data):
    tagged = R.tag_subsets(frame, {"tous": F.lit(True), "sans 0": F.col("g") > 0})
    got = R.model_table(tagged, ["y"], ["x", "z"], by=["subset"]).collect()
    cells = {(r["subset"], r["term"]): r["cell"] for r in got}
    assert len(cells) == 8
    keep = data["g"] > 0
    b, se, rss, df = ols([data["x"][keep], data["z"][keep]], data["y"][keep])
    y = data["y"][keep]
    adj = 1 - (rss / ((y - y.mean()) ** 2).sum()) * (len(y) - 1) / df
    assert cells["sans 0", "adj.r.squared"] == f"{adj:.3f}".rstrip("0")
    assert cells["sans 0", "x"].startswith(f"{b[1]:.3f}".rstrip("0")) and cells["sans 0", "x"].endswith("(***)")


def test_residuals_and_leverage(frame, data):
    got = R.residuals(frame, "y", ["x", "z"]).select("x", "residual", "leverage").collect()
    m = np.column_stack([np.ones(300), data["x"], data["z"]])
    hat = m @ np.linalg.inv(m.T @ m) @ m.T
    want = {round(float(x), 9): (float(e), float(h)) for x, e, h in zip(data["x"], data["y"] - hat @ data["y"], np.diag(hat))}
    assert len(got) == 300
    for r in got:
        assert (r["residual"], r["leverage"]) == pytest.approx(want[round(r["x"], 9)], abs=1e-9)
    bare = R.residuals(frame, "y", ["x"], intercept=False).agg(F.sum("leverage")).first()[0]
    assert bare == pytest.approx(1.0)


def test_t_as_columns_equals_the_loop_and_tables(spark):
    pairs = [(t, d) for t in (0.0, 1e-8, 0.1, 1.0, -2.5, 7.5, 40.0, 1e5) for d in (1, 2, 3, 10, 98, 998, 10**5)]
    # n = 3 and n = 1000 of a slope have 1 and 998 degrees of freedom
    known = [(12.7062, 1, 0.05), (-12.7062, 1, 0.05), (63.6567, 1, 0.01), (1.96235, 998, 0.05), (-2.58074, 998, 0.01), (1.959964, 10**9, 0.05)]
    frame = spark.createDataFrame([(float(t), float(d)) for t, d, *_ in [*pairs, *known]] + [(None, 1.0), (1.0, 0.0)], "t double, d double")
    got = [r[0] for r in frame.coalesce(1).select(two_sided_t(F.col("t"), F.col("d"))).collect()]
    assert got[: len(pairs)] == pytest.approx([R._two_sided_t(t, d) for t, d in pairs], rel=1e-9)
    assert got[len(pairs) : -2] == pytest.approx([p for *_, p in known], abs=2e-6) and got[-2:] == [None, None]


@pytest.mark.parametrize("n_levels, n", [(3, 60), (5000, 12000)])
def test_absorbed_factor(spark, n_levels, n):
    rng = np.random.default_rng(11)
    f = np.concatenate([np.arange(n_levels), rng.integers(0, n_levels, n - n_levels)])
    x, z = rng.normal(3, 1, n) + f / n_levels, rng.normal(0, 2, n)
    y = 1 + 0.5 * x - 2 * z + np.sin(f) + rng.normal(0, 1, n)
    recs = [(f"L{c:05}", float(a), float(b), float(2 * a), float(d)) for c, a, b, d in zip(f, x, z, y)]
    df = spark.createDataFrame([*recs, (None, 1.0, 1.0, 2.0, 1.0), ("L00001", None, 1.0, 1.0, 1.0)], "f string, x double, z double, twice double, y double").repartition(3)
    got = {r["term"]: r for r in factor_models(df, ["y"], ["x", "z", "twice"], "f").collect()}
    assert len(got) == n_levels + 3 and got["twice"]["estimate"] is None
    # the same by centring within levels, and for few levels by all columns
    count = np.bincount(f)
    inside = lambda v: v - (np.bincount(f, v) / count)[f]
    m = np.column_stack([inside(x), inside(z)])
    beta = np.linalg.lstsq(m, inside(y), rcond=None)[0]
    rss, free = ((inside(y) - m @ beta) ** 2).sum(), n - n_levels - 2
    assert [got["x"]["estimate"], got["z"]["estimate"]] == pytest.approx(list(beta))
    assert [got["x"]["rss"], got["x"]["df_residual"], got["x"]["r2"]] == pytest.approx([rss, free, 1 - rss / ((y - y.mean()) ** 2).sum()])
    means = [np.bincount(f, v) / count for v in (y, x, z)]
    level = means[0] - beta[0] * means[1] - beta[1] * means[2]
    assert got["(Intercept)"]["estimate"] == pytest.approx(level[0])
    for i in (1, 2, n_levels - 1):
        assert got[f"fL{i:05}"]["estimate"] == pytest.approx(level[i] - level[0])
    if n_levels == 3:
        cols = [x, z, f == 1, f == 2]
        b, se, *_ = ols(cols, y)
        names = ["(Intercept)", "x", "z", "fL00001", "fL00002"]
        assert [got[k]["estimate"] for k in names] == pytest.approx(list(b)) and [got[k]["std_error"] for k in names] == pytest.approx(list(se))
        assert [got[k]["p_value"] for k in names] == pytest.approx([R._two_sided_t(v / e, n - 5) for v, e in zip(b, se)])
        assert sorted(got[k]["term_order"] for k in names) == [0, 1, 2, 4, 5]


def test_absorbed_factor_by_group(frame):
    got = factor_models(frame, ["y", "w"], ["x"], "f", by=["g"])
    want = R.linear_models(frame, ["y", "w"], ["x", "f"], by=["g"], factors={"f": ["A", "B", "C"]})
    key = lambda r: (r["g"], r["response"], r["term"])
    a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b]
    for c in ("estimate", "std_error", "t_value", "p_value", "n", "df_residual", "rss", "sigma", "r2", "adj_r2", "aic"):
        assert [r[c] for r in a] == pytest.approx([r[c] for r in b], rel=1e-8), c
    assert factor_models(frame.limit(0), ["y"], ["x"], "f").count() == 0


def test_trend(spark):
    recs = [("up", t, 3.0 * t + (t % 2) * 0.1) for t in range(8)] + [("flat", t, float((t * 7) % 3)) for t in range(8)]
    recs += [("two", 1, 1.0), ("two", 2, 2.0), ("still", 5, 1.0), ("still", 5, 2.0), ("still", 5, 3.0)]
    got = {r["k"]: r for r in R.trend_test(spark.createDataFrame(recs, "k string, t int, y double"), ["k"], "t", "y").collect()}
    assert got["up"]["significant"] is True and got["up"]["slope"] == pytest.approx(3.0, abs=0.01)
    assert got["flat"]["significant"] is False
    assert got["two"]["p_value"] is None and got["still"]["slope"] is None


def test_correlations(spark):
    rng = random.Random(2)
    recs = [(rng.random(), rng.random() if rng.random() > 0.2 else None, rng.random() if rng.random() > 0.2 else None, 4.0) for _ in range(200)]
    df = spark.createDataFrame(recs, "a double, b double, c double, k double")

    def r(x, y, keep):
        xs, ys = zip(*[(t[x], t[y]) for t in recs if keep(t)])
        return np.corrcoef(xs, ys)[0, 1]

    full = {(q["var_x"], q["var_y"]): q["r"] for q in R.correlations(df, ["a", "b", "c", "k"]).collect()}
    pair = {(q["var_x"], q["var_y"]): q["r"] for q in R.correlations(df, ["a", "b", "c", "k"], "pairwise").collect()}
    every = {(q["var_x"], q["var_y"]): q["r"] for q in R.correlations(df, ["a", "b", "c", "k"], "everything").collect()}
    assert len(full) == 16
    assert full["a", "b"] == pytest.approx(r(0, 1, lambda t: t[1] is not None and t[2] is not None))
    assert pair["b", "c"] == pair["c", "b"] == pytest.approx(r(1, 2, lambda t: t[1] is not None and t[2] is not None))
    assert pair["a", "b"] == pytest.approx(r(0, 1, lambda t: t[1] is not None))
    assert full["a", "k"] is None and pair["k", "k"] is None and every["a", "b"] is None
    assert every["a", "a"] == pytest.approx(1.0)


def test_components(spark, data):
    rng = np.random.default_rng(5)
    m = np.column_stack([data["x"], data["x"] + rng.normal(0, 1, 300), -data["x"] + data["z"]])
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(m)] + [(999, None, 1.0, 1.0)], "i int, a double, b double, c double")
    u = (m - m.mean(0)) / m.std(0)
    values, vectors = np.linalg.eigh(u.T @ u / 300)
    lead = vectors[:, -1] * np.sign(vectors[0, -1])
    got = {r["i"]: r["axe1"] for r in R.pca_scores(df, ["a", "b", "c"], axes=2).collect()}
    assert len(got) == 300 and [got[i] for i in range(300)] == pytest.approx(list(u @ lead))
    load = {(r["axis"], r["variable"]): r for r in R.pca_loadings(df, ["a", "b", "c"]).collect()}
    assert load[1, "a"]["eigenvalue"] == pytest.approx(values[-1]) and load[1, "b"]["contrib"] == pytest.approx(100 * lead[1] ** 2)
    assert sum(load[2, v]["contrib"] for v in "abc") == pytest.approx(100)
    with pytest.raises(ValueError):
        R.pca(df.withColumn("k", F.lit(1.0)), ["a", "k"])


@pytest.mark.parametrize("noise, rate", [(0.0, -2.0), (1.5, -2.0), (1.5, -0.5), (1.0, -4.0)])
def test_asymptote_is_where_the_gradient_is_zero(spark, noise, rate):
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(0, 40, 400), 1)
    y = 25 + (3 - 25) * np.exp(-np.exp(rate) * x) + rng.normal(0, noise, 400)
    fit = R.asymptote(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), "x", "y")
    asym, start, g = fit["Asym"], fit["R0"], fit["lrc"]
    if not noise:
        assert (asym, start, g) == pytest.approx((25, 3, -2.0), abs=1e-6)
        return
    e = np.exp(-np.exp(g) * x)
    r = y - (asym + (start - asym) * e)
    m = np.column_stack([1 - e, e, -(start - asym) * x * np.exp(g) * e])
    cosines = np.abs(m.T @ r) / np.sqrt((m**2).sum(0) * (r**2).sum())
    assert cosines.max() < 1e-7 and fit["rss"] == pytest.approx((r**2).sum())
    se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * (r**2).sum() / 397)
    assert [fit["se_Asym"], fit["se_R0"], fit["se_lrc"]] == pytest.approx(list(se), rel=1e-5)


def test_asymptote_of_constant_x(spark):
    with pytest.raises(ValueError):
        R.asymptote(spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "x double, y double"), "x", "y")


def test_exact_quantiles(spark):
    rng = random.Random(9)
    recs = [("big", rng.gauss(0, 1)) for _ in range(3000)] + [("ties", float(rng.randrange(3))) for _ in range(500)]
    recs += [("half", v) for i in range(1500) for v in (7.25, 7.25 + i * 1e-12)]
    recs += [("close", math.nextafter(1.0, 2.0) if i % 3 else 1.0 - i * 2**-53) for i in range(900)]
    recs += [("negative", -1e6 - i / 997) for i in range(2000)] + [("wide", rng.choice([-1, 1]) * 10.0 ** rng.randrange(-320, 308)) for _ in range(900)]
    recs += [("tiny", i * 5e-324) for i in range(-40, 300)] + [("powers", 2.0**i) for i in range(-200, 200)]
    recs += [("zeros", -0.0), ("zeros", 0.0), ("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None), (None, 7.0)]
    df = spark.createDataFrame(recs, "k string, x double").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.777, 0.9, 1.0]
    got = {r["k"]: r for r in E.exact_quantiles(df, ["k"], "x", probs).collect()}
    for k in {k for k, _ in recs} - {"none"}:
        xs = sorted(v for g, v in recs if g == k and v is not None)
        want = []
        for p in probs:
            at = (len(xs) - 1) * p
            a, b = xs[math.floor(at)], xs[min(math.floor(at) + 1, len(xs) - 1)]
            want.append(a if a == b else a + (b - a) * (at - math.floor(at)))
        assert got[k]["q"] == want, k
        assert (got[k]["n"], got[k]["mini"], got[k]["maxi"]) == (len(xs), xs[0], xs[-1])
    assert "none" not in got


def test_quantiles_with_infinite_values_and_without_rows(spark):
    xs = [float("-inf"), -1.0, 0.0, 3.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    q = E.exact_quantiles(df, [], "x", [0.0, 0.2, 0.6, 0.8]).first()["q"]
    assert q == [float("-inf"), -1.0, 3.0, float("inf")]
    assert E.exact_quantiles(df.limit(0), [], "x", [0.5]).count() == 0


def test_the_number_never_falls(spark):
    rng = random.Random(2)
    xs = sorted({rng.choice([-1, 1]) * math.ldexp(rng.random() + 0.5, rng.randrange(-1070, 1020)) for _ in range(5000)})
    xs = sorted({*xs, *[math.nextafter(2.0**i, way) for i in range(-60, 60) for way in (0, 4.0**60)], *[2.0**i for i in range(-60, 60)]})
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", Q.coarse_number(F.col("x")).alias("n")).collect()
    numbers = [n for _, n in sorted(map(tuple, got))]
    assert numbers == sorted(numbers)


def test_summary_histogram_bars(spark):
    df = spark.createDataFrame([(0.0, "u"), (1.0, "u"), (2.0, "v"), (10.0, None)], "a double, t string")
    assert rows(E.summary_stats(df, ["a"])) == [("a", 1.0, 2.0, 10.0)]
    assert rows(E.five_numbers(df, [], "a").select("mini", "q1", "med", "q3", "maxi")) == [(0.0, 0.75, 1.5, 4.0, 10.0)]
    hist = E.histogram(df, ["a"], bins=5)
    assert rows(hist.select("bin", "bin_start", "n")) == [(1, 0.0, 2), (2, 2.0, 1), (5, 8.0, 1)]
    assert sum(r[0] for r in E.histogram(df, ["a"], 4, log_axis=True).select("n").collect()) == 3
    flat = spark.createDataFrame([(3.0,), (3.0,)], "a double")
    assert rows(E.histogram(flat, ["a"]).select("bin", "n")) == [(1, 2)]
    assert rows(E.bar_counts(df, ["t"]).where("value is not null").select("value", "n")) == [("u", 2), ("v", 1)]


def test_point_means_and_transform(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 4.0, 2.0), (2, 0.0, 5.0), (3, 0.0, None)], "p int, a double, b double")
    assert rows(E.point_means(df, "p", ["a", "b"], ["a"])) == [(1, 4.0, 1.0), (2, None, 5.0), (3, None, None)]
    assert rows(E.point_means(df, "p", ["a", "b"], ["a", "b"])) == [(1, 4.0, 2.0), (2, None, 5.0)]
    out = E.transform(df, log1p10=["a"], missing_zero=["a"], missing_below={"b": 1.0})
    assert rows(out.where("p = 2").select("a", "b")) == [(None, 5.0)]
    assert out.where("p = 1 and a is null").select("b").first()[0] is None
