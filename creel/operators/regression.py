"""Correlation, principal components and linear models from aggregated sums.

The rows are read once, by a grouped aggregation of counts, means and
covariances (all merge on the map side). What is left is a p x p problem per
model. Those one-row problems are solved next to the grouped rows, so many
models, subsets or groups are solved in parallel and no data row passes through
the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from creel.functions import scalars as S
from creel.functions.probability import two_sided_t
from creel.sources.tables import materialise

# workers need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INTERCEPT = "(Intercept)"


# -- one pass over the rows ----------------------------------------------------------


def gram(df: DataFrame, variables: Sequence[str], by: Sequence[str] = (), *, complete: bool = True) -> DataFrame:
    """Count, means and population covariances of the variables, one row per group.

    ``m`` holds the means and ``c`` the upper triangle row by row. With
    ``complete`` rows holding a missing value are left out.
    """
    cols = [F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(variables)]
    rows = df.select(*by, *cols)
    if complete:
        rows = rows.dropna(subset=[f"__v{i}" for i in range(len(variables))])
    p = range(len(variables))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(f"__v{i}") for i in p]).alias("m"),
        F.array(*[F.covar_pop(f"__v{i}", f"__v{j}") for i in p for j in p if j >= i]).alias("c"),
    )


def correlations(df: DataFrame, variables: Sequence[str], use: str = "complete") -> DataFrame:
    """Pearson correlations in long form ``(var_x, var_y, r)``, both triangles and the diagonal.

    ``use``: ``complete`` rows only, ``pairwise`` complete, or ``everything``, where
    a variable with a missing value has missing correlations. A constant variable
    has missing correlations.
    """
    if use not in ("complete", "pairwise", "everything"):
        raise ValueError(f"unknown rule {use!r}")
    named = {v: f"__v{i}" for i, v in enumerate(variables)}
    rows = df.select(*[F.col(v).cast("double").alias(a) for v, a in named.items()])
    if use == "complete":
        rows = rows.dropna()
    pairs = [(x, y) for i, x in enumerate(variables) for y in list(variables)[i:]]
    aggs = []
    for x, y in pairs:
        a, b = F.col(named[x]), F.col(named[y])
        both = a.isNotNull() & b.isNotNull()
        va = F.var_pop(F.when(both, a) if use == "pairwise" else a)
        vb = F.var_pop(F.when(both, b) if use == "pairwise" else b)
        # a variance below rounding noise of the mean square is a constant column
        noise = F.lit(1e-28)
        ok = (va > noise * F.avg(a * a)) & (vb > noise * F.avg(b * b))
        r = F.when(ok, F.try_divide(F.covar_pop(a, b), F.sqrt(va) * F.sqrt(vb)))
        if use == "everything":
            r = F.when((F.count(a) == F.count(F.lit(1))) & (F.count(b) == F.count(F.lit(1))), r)
        aggs.append(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
        aggs[-1] = F.when(r.isNotNull(), aggs[-1])
    one = rows.agg(F.array(*aggs).alias("__r"))
    cells = []
    for i, (x, y) in enumerate(pairs):
        for a, b in {(x, y), (y, x)}:
            cells.append(F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"), F.col("__r")[i].alias("r")))
    return one.select(F.inline(F.array(*cells)))


# -- small dense problems (one per grouped row) ---------------------------------------


def _triangle(values: Sequence[float], p: int) -> np.ndarray:
    c = np.zeros((p, p))
    c[np.triu_indices(p)] = values
    return c + np.triu(c, 1).T


def _two_sided_t(t: float, df: float) -> float:
    """Two-sided p-value of Student's t: the regularised incomplete beta function
    I_x(df/2, 1/2) at x = df / (df + t²), by its continued fraction."""
    from math import exp, lgamma, log

    if not np.isfinite(t) or df <= 0:
        return float("nan") if not np.isinf(t) or df <= 0 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
        h = d
        for m in range(1, 10_000):
            for num in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1.0 + num * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = 1.0 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1.0) < 1e-15:
                break
        return h

    a, b = df / 2.0, 0.5
    x, y = df / (df + t * t), t * t / (df + t * t)
    if y == 0.0:
        return 1.0
    if x == 0.0:
        return 0.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(y))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * fraction(a, b, x) / a
    return 1.0 - front * fraction(b, a, y) / b


def _independent(scaled: np.ndarray, order: Sequence[int], tol: float = 1e-7) -> list[int]:
    """Columns kept when later ones that depend on earlier ones are dropped."""
    kept: list[int] = []
    for j in order:
        if scaled[j, j] <= 0:
            continue
        rest = scaled[j, j]
        if kept:
            block = scaled[np.ix_(kept, kept)]
            rest = rest - scaled[j, kept] @ np.linalg.solve(block, scaled[kept, j])
        if rest > tol:
            kept.append(j)
    return kept


def _solve(n: float, mean: np.ndarray, cov: np.ndarray, cols: Sequence[int], intercept: bool) -> dict:
    """Least squares of variable 0 on variables ``cols`` from means and covariances."""
    if intercept:
        sxx, sxy, syy = n * cov, n * cov[:, 0], n * cov[0, 0]
    else:
        full = n * (cov + np.outer(mean, mean))
        sxx, sxy, syy = full, full[:, 0], full[0, 0]
    scale = np.sqrt(np.where(np.diag(sxx) > 1e-24 * n * (mean**2 + np.diag(cov)), np.diag(sxx), 0.0))
    safe = np.where(scale > 0, scale, 1.0)
    scaled = np.where(np.outer(scale, scale) > 0, sxx / np.outer(safe, safe), 0.0)
    kept = _independent(scaled, cols)
    beta, inv = np.zeros(0), np.zeros((0, 0))
    if kept:
        inv_s = np.linalg.inv(scaled[np.ix_(kept, kept)])
        inv = inv_s / np.outer(safe[kept], safe[kept])
        beta = inv @ sxy[kept]
    rss = max(float(syy - beta @ sxy[kept]), 0.0) if kept else float(syy)
    return {"kept": kept, "beta": beta, "inv": inv, "rss": rss, "syy": float(syy), "rank": len(kept) + int(intercept)}


def _step(
    n: float, mean: np.ndarray, cov: np.ndarray, blocks: list[list[int]], intercept: bool
) -> list[list[int]]:
    """Backward selection by ``n ln(RSS/n) + 2 rank``; a block of columns leaves as one."""

    def aic(bs: list[list[int]]) -> float:
        fit = _solve(n, mean, cov, [c for b in bs for c in b], intercept)
        return n * float(np.log(fit["rss"] / n)) + 2 * fit["rank"] if fit["rss"] > 0 else -np.inf

    current = aic(blocks)
    while blocks:
        trials = [(aic(blocks[:i] + blocks[i + 1 :]), i) for i in range(len(blocks))]
        best, i = min(trials)
        if not best < current:
            break
        blocks, current = blocks[:i] + blocks[i + 1 :], best
    return blocks


_TERM_FIELDS = "term string, term_order int, estimate double, std_error double, t_value double, p_value double"
_MODEL_FIELDS = "n bigint, df_residual bigint, rss double, sigma double, r2 double, adj_r2 double, aic double"


def _model_rows(n, mean, cov, terms: list[str], blocks: list[list[int]], intercept: bool, step: bool) -> list[tuple]:
    n = float(n)
    if step:
        blocks = _step(n, mean, cov, blocks, intercept)
    cols = [c for b in blocks for c in b]
    fit = _solve(n, mean, cov, cols, intercept)
    df = n - fit["rank"]
    sigma2 = fit["rss"] / df if df > 0 else float("nan")
    r2 = 1.0 - fit["rss"] / fit["syy"] if fit["syy"] > 0 else float("nan")
    adj = 1.0 - (1.0 - r2) * (n - int(intercept)) / df if df > 0 else float("nan")
    aic = (
        n * (np.log(2 * np.pi) + np.log(fit["rss"] / n) + 1.0) + 2 * (fit["rank"] + 1)
        if fit["rss"] > 0
        else float("nan")
    )
    model = (int(n), int(df), fit["rss"], float(np.sqrt(sigma2)), r2, adj, float(aic))
    est, var = {}, {}
    for i, c in enumerate(fit["kept"]):
        est[c], var[c] = float(fit["beta"][i]), sigma2 * float(fit["inv"][i, i])
    rows = []
    if intercept:
        m = mean[fit["kept"]]
        b0 = float(mean[0] - m @ fit["beta"])
        v0 = sigma2 * (1.0 / n + float(m @ fit["inv"] @ m))
        rows.append((INTERCEPT, 0, b0, v0))
    rows += [(terms[c], c, est.get(c), var.get(c)) for c in cols]
    out = []
    for name, order, b, v in rows:
        se = float(np.sqrt(v)) if v is not None else None
        t = b / se if se else (None if b is None else (0.0 if b == 0 else float("inf") * np.sign(b)))
        t = None if t is None or not np.isfinite(t) else t
        p = None if t is None or df <= 0 else _two_sided_t(t, df)
        out.append((name, order, b, se, t, p, *model))
    return out


def _clean(x):
    return None if isinstance(x, float) and not np.isfinite(x) else x


def solve_models(
    sums: DataFrame,
    terms: Sequence[str],
    by: Sequence[str] = (),
    *,
    intercept: bool = True,
    step: bool = False,
    blocks: Sequence[Sequence[int]] | None = None,
) -> DataFrame:
    """Coefficient rows of one model per row of :func:`gram` (response first, then terms)."""
    by, p = list(by), len(terms) + 1
    names = ["", *terms]
    groups = [list(b) for b in blocks] if blocks is not None else [[i] for i in range(1, p)]
    keys = [sums.schema[b] for b in by]
    schema = T.StructType([*keys, *T._parse_datatype_string(f"{_TERM_FIELDS}, {_MODEL_FIELDS}").fields])
    columns = schema.fieldNames()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rec in batch.itertuples(index=False):
                key = tuple(getattr(rec, f"k{i}") for i in range(len(by)))
                mean, cov = np.asarray(rec.m, dtype=float), _triangle(rec.c, p)
                for row in _model_rows(rec.n, mean, cov, names, groups, intercept, step):
                    out.append(key + tuple(_clean(x) for x in row))
            yield pd.DataFrame(out, columns=columns).astype(object).where(lambda d: d.notna(), None)

    ready = sums.where(F.col("n") > 0).select(*[F.col(b).alias(f"k{i}") for i, b in enumerate(by)], "n", "m", "c")
    return ready.mapInPandas(solve, schema)


# -- models ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Design:
    """Columns of a model: one per numeric predictor, one per non-base level of a factor."""

    df: DataFrame
    terms: list[str]
    blocks: list[list[int]]


def design(df: DataFrame, predictors: Sequence[str], factors: Mapping[str, Sequence[object]] | None = None) -> Design:
    """Add indicator columns for factors; their first level is the base.

    ``factors`` maps a predictor to its ordered levels.
    """
    factors = factors or {}
    terms: list[str] = []
    blocks: list[list[int]] = []
    for name in predictors:
        if name in factors:
            levels = list(factors[name])[1:]
            flags = {f"{name}{level}": F.when(F.col(name).isNotNull(), (F.col(name) == level).cast("double")) for level in levels}
            df = df.withColumns(flags)
            new = list(flags)
        else:
            new = [name]
        blocks.append(list(range(len(terms) + 1, len(terms) + 1 + len(new))))
        terms += new
    return Design(df, terms, blocks)


def linear_models(
    df: DataFrame,
    responses: Sequence[str],
    predictors: Sequence[str],
    *,
    by: Sequence[str] = (),
    factors: Mapping[str, Sequence[object]] | None = None,
    intercept: bool = True,
    step: bool = False,
) -> DataFrame:
    """Least squares for each response (and group) from one aggregation.

    Rows with a missing response or predictor are left out per response. The
    result has one row per coefficient, with the model statistics repeated;
    a predictor that depends on earlier ones has a missing estimate.
    """
    d = design(df, predictors, factors)
    pieces = F.explode(
        F.array(*[F.struct(F.lit(r).alias("response"), F.col(r).cast("double").alias("__y")) for r in responses])
    ).alias("__p")
    long = d.df.select(*by, *[F.col(f"`{t}`").cast("double").alias(f"__x{i}") for i, t in enumerate(d.terms)], pieces)
    long = long.select(*by, "__p.response", "__p.__y", *[f"__x{i}" for i in range(len(d.terms))])
    sums = gram(long, ["__y", *[f"__x{i}" for i in range(len(d.terms))]], [*by, "response"])
    return solve_models(sums, d.terms, [*by, "response"], intercept=intercept, step=step, blocks=d.blocks)


def quadratic(
    df: DataFrame, response: str, x: str, *, intercept: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    """``y ~ x + x²``, or without intercept; r² is then not centred."""
    rows = df.withColumn(f"{x}^2", S.square(F.col(x).cast("double")))
    return linear_models(rows, [response], [x, f"{x}^2"], by=by, intercept=intercept)


def cell_text(estimate: Column, p: Column, digits: int = 3) -> Column:
    """Rounded number followed by its significance mark."""
    return F.concat(S.number_text(estimate, digits), S.stars(p))


def model_table(
    df: DataFrame,
    responses: Sequence[str],
    predictors: Sequence[str],
    *,
    by: Sequence[str] = (),
    factors: Mapping[str, Sequence[object]] | None = None,
    step: bool = False,
    digits: int = 3,
) -> DataFrame:
    """Long table ``(by, response, term_order, term, cell)``: coefficients, then adjusted r²."""
    fits = linear_models(df, responses, predictors, by=by, factors=factors, step=step)

    def row(order: Column, term: Column, cell: Column) -> Column:
        return F.struct(order.alias("term_order"), term.alias("term"), cell.alias("cell"))

    coefficient = row(F.col("term_order"), F.col("term"), cell_text(F.col("estimate"), F.col("p_value"), digits))
    r2 = row(F.lit(10_000), F.lit("adj.r.squared"), S.number_text(F.col("adj_r2"), digits))
    rows = F.array_compact(F.array(coefficient, F.when(F.col("term") == INTERCEPT, r2)))
    return fits.select(*by, "response", F.inline(rows))


def tag_subsets(df: DataFrame, subsets: Mapping[str, Column], out: str = "subset") -> DataFrame:
    """Repeat each row for every named subset whose condition it meets."""
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in subsets.items()]))
    return df.withColumn(out, F.explode(tags))


# -- a fitted model on its rows ------------------------------------------------------------


@dataclass(frozen=True)
class FittedModel:
    """Coefficients of one model and the inverse cross-product matrix (p x p)."""

    terms: list[str]
    coefficients: dict[str, float]
    intercept: float | None
    inverse: list[list[float]]
    n: int
    means: list[float]

    def fitted(self) -> Column:
        out = F.lit(0.0 if self.intercept is None else self.intercept)
        for t, b in self.coefficients.items():
            out = out + F.lit(b) * F.col(f"`{t}`").cast("double")
        return out

    def leverage(self) -> Column:
        """``x'(X'X)⁻¹x`` of the row, as a column expression."""
        x = [F.col(f"`{t}`").cast("double") for t in self.coefficients]
        if self.intercept is not None:
            x = [c - F.lit(m) for c, m in zip(x, self.means)]
        out = F.lit(0.0 if self.intercept is None else 1.0 / self.n)
        for i, a in enumerate(x):
            for j, b in enumerate(x[i:], i):
                out = out + F.lit(self.inverse[i][j] * (1.0 if i == j else 2.0)) * a * b
        return out


def fit(df: DataFrame, response: str, predictors: Sequence[str], *, intercept: bool = True) -> FittedModel:
    """Fit one model now (one job; only the aggregated sums reach the driver)."""
    row = gram(df, [response, *predictors]).first()
    p = len(predictors) + 1
    if row is None or row["n"] == 0:
        raise ValueError("no complete row to fit")
    mean, cov = np.asarray(row["m"], dtype=float), _triangle(row["c"], p)
    s = _solve(float(row["n"]), mean, cov, range(1, p), intercept)
    names = [predictors[c - 1] for c in s["kept"]]
    return FittedModel(
        terms=list(predictors),
        coefficients={t: float(b) for t, b in zip(names, s["beta"])},
        intercept=float(mean[0] - mean[s["kept"]] @ s["beta"]) if intercept else None,
        inverse=s["inv"].tolist(),
        n=int(row["n"]),
        means=[float(mean[c]) for c in s["kept"]],
    )


def residuals(df: DataFrame, response: str, predictors: Sequence[str], *, intercept: bool = True) -> DataFrame:
    """Rows with fitted value, residual and leverage; incomplete rows are left out."""
    model = fit(df, response, predictors, intercept=intercept)
    rows = df.dropna(subset=[response, *predictors]).withColumn("fitted", model.fitted())
    return rows.withColumns(
        {"residual": F.col(response).cast("double") - F.col("fitted"), "leverage": model.leverage()}
    )


def trend_test(df: DataFrame, keys: Sequence[str], x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """Slope of each group's series, its p-value and whether it is below ``alpha``.

    One aggregation and column expressions, however many groups there are. A series of
    fewer than three points, or constant in ``x``, has a missing p-value, and so has one
    that lies on a line.
    """
    a, b = F.col("__a"), F.col("__b")
    rows = df.select(*keys, F.col(x).cast("double").alias("__a"), F.col(y).cast("double").alias("__b")).dropna(subset=["__a", "__b"])
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("__m"), F.var_pop(a).alias("__va"), F.var_pop(b).alias("__vb"), F.covar_pop(a, b).alias("__c")
    )
    spread = F.col("__va") > 1e-24 * (F.col("__m") * F.col("__m") + F.col("__va"))
    sums = sums.withColumn("slope", F.when(spread, F.try_divide("__c", "__va")))
    free = F.when(F.col("n") > 2, F.col("n") - 2)
    error = F.greatest(F.col("__vb") - F.col("slope") * F.col("__c"), F.lit(0.0)) / (free * F.col("__va"))
    t = F.when(F.col("slope").isNotNull() & (error > 0), F.col("slope") / F.sqrt(error))
    out = sums.withColumn("p_value", two_sided_t(t, free))
    return out.select(*keys, "n", "slope", "p_value", (F.col("p_value") < alpha).alias("significant"))


# -- principal components --------------------------------------------------------------------


@dataclass(frozen=True)
class Components:
    """Unit-variance principal components: eigenvalues and variable coordinates."""

    variables: list[str]
    means: list[float]
    sds: list[float]
    eigenvalues: list[float]
    vectors: list[list[float]]
    """``vectors[k][i]``: weight of variable i on axis k."""

    def score(self, axis: int = 0) -> Column:
        out = F.lit(0.0)
        for v, m, s, w in zip(self.variables, self.means, self.sds, self.vectors[axis]):
            out = out + (F.col(v).cast("double") - F.lit(m)) * F.lit(w / s)
        return out


def _components(n: float, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(corr)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order].T
    for k in range(len(values)):  # sign: first weight that is not zero is positive
        lead = vectors[k][np.argmax(np.abs(vectors[k]) > 1e-9)]
        vectors[k] *= -1.0 if lead < 0 else 1.0
    return sd, values, vectors


def pca(df: DataFrame, variables: Sequence[str]) -> Components:
    """Principal components of the standardised variables, complete rows only (one job)."""
    row = gram(df, variables).first()
    mean, cov = np.asarray(row["m"], dtype=float), _triangle(row["c"], len(variables))
    if not np.all(np.diag(cov) > 0):
        raise ValueError("a constant variable has no unit-variance component")
    sd, values, vectors = _components(row["n"], mean, cov)
    return Components(list(variables), mean.tolist(), sd.tolist(), values.tolist(), vectors.tolist())


def pca_scores(df: DataFrame, variables: Sequence[str], axes: int = 1, prefix: str = "axe") -> DataFrame:
    """Complete rows with their scores, population standard deviation as the unit."""
    c = pca(df, variables)
    return df.dropna(subset=list(variables)).withColumns({f"{prefix}{k + 1}": c.score(k) for k in range(axes)})


def pca_loadings(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Long ``(axis, variable, eigenvalue, coord, contrib)``: coordinate of each variable
    and its contribution in percent."""
    names, p = list(variables), len(variables)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rec in batch.itertuples(index=False):
                _, values, vectors = _components(rec.n, np.asarray(rec.m, dtype=float), _triangle(rec.c, p))
                for k in range(p):
                    for i in range(p):
                        w = float(vectors[k, i])
                        out.append((k + 1, names[i], float(values[k]), w * float(np.sqrt(max(values[k], 0.0))), 100.0 * w * w))
            yield pd.DataFrame(out, columns=["axis", "variable", "eigenvalue", "coord", "contrib"])

    return gram(df, names).mapInPandas(load, "axis int, variable string, eigenvalue double, coord double, contrib double")


# -- saturating curve ---------------------------------------------------------------------------


def _curve_sums(by_x: DataFrame, rates: Sequence[float]) -> dict[float, dict[str, float]]:
    """For each logarithm of the rate the weighted sums that its fit needs, in one job.

    ``e`` is the exponential, ``q`` its derivative by the logarithm of the rate with the
    sign changed, ``v`` the response less its mean.
    """
    u, k = F.col("__u"), F.exp("__g")
    cells = by_x.withColumn("__g", F.explode(F.array(*[F.lit(float(g)) for g in rates])))
    cells = cells.withColumns({"e": F.exp(-k * u), "q": k * u * F.exp(-k * u), "v": F.col("__v")})
    w = F.col("__n")
    named = {"e": ["e"], "q": ["q"], "v": ["v"], "ee": ["e", "e"], "eq": ["e", "q"], "qq": ["q", "q"], "ev": ["e", "v"], "qv": ["q", "v"]}
    sums = [F.sum(w * np.prod([F.col(c) for c in cs])).alias(n) for n, cs in named.items()]
    rows = cells.groupBy("__g").agg(F.sum(w).alias("n"), F.sum(w * (F.col("v") * F.col("v") + F.col("__s"))).alias("vv"), *sums)
    return {r["__g"]: r.asDict() for r in rows.collect()}


def _curve_step(s: dict[str, float]) -> dict[str, float] | None:
    """The best curve of one rate, and the Gauss-Newton step of the rate that the sums give.

    Given the rate the other parameters are linear, so they are solved for, and the
    derivative by the rate is projected off their columns.
    """
    n = s["n"]
    cee, cqq, ceq = s["ee"] - s["e"] ** 2 / n, s["qq"] - s["q"] ** 2 / n, s["eq"] - s["e"] * s["q"] / n
    cev, cqv, cvv = s["ev"] - s["e"] * s["v"] / n, s["qv"] - s["q"] * s["v"] / n, s["vv"] - s["v"] ** 2 / n
    if not cee > 1e-14 * n:
        return None
    slope = cev / cee
    rss = max(cvv - slope * cev, 0.0)
    # residuals r = v - slope e lie off 1 and e; the model's derivative is -slope q
    rq, free = cqv - slope * ceq, cqq - ceq * ceq / cee
    if not free > 1e-14 * n:
        return None
    at = {"rss": rss, "slope": slope, "level": s["v"] / n - slope * s["e"] / n, "gradient": 2 * slope * rq}
    # the cosine between the residuals and the projected derivative: 0 where the gradient is
    at["cosine"] = abs(rq) / np.sqrt(free * rss) if rss > 0 else 0.0
    at["step"] = -rq / (slope * free) if slope else 0.0
    # cross products of the derivatives by asymptote, start and rate
    d = slope
    at["normal"] = [
        [n - 2 * s["e"] + s["ee"], s["e"] - s["ee"], -d * (s["q"] - s["eq"])],
        [s["e"] - s["ee"], s["ee"], -d * s["eq"]],
        [-d * (s["q"] - s["eq"]), -d * s["eq"], d * d * s["qq"]],
    ]
    return at


def asymptote(df: DataFrame, x: str, y: str, *, tolerance: float = 1e-9, most_steps: int = 12) -> Row:
    """Least squares of ``y = Asym + (R0 - Asym) exp(-exp(lrc) x)``, with standard errors.

    Gauss-Newton on normal equations that are sums over the rows. Given ``lrc`` the curve
    is linear, so only ``lrc`` is iterated. One job over a coarse grid gives the start;
    each further job evaluates the full step, parts of it and twice it, and the best is
    taken, until the gradient is zero (the cosine between residuals and derivative is
    below ``tolerance``) or no step is better. The rows are reduced to one per distinct
    x, written once; only a few sums reach the driver. ``gradient`` is the derivative of
    the sum of squares by ``lrc`` at the result.
    """
    rows = df.select(F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).dropna()
    by_x = materialise(rows.groupBy("__x").agg(F.count(F.lit(1)).alias("__n"), F.avg("__y").alias("__m"), F.var_pop("__y").alias("__s")))
    w = F.col("__n")
    n, scale, mean = by_x.agg(F.sum(w), F.sum(w * F.abs("__x")) / F.sum(w), F.sum(w * F.col("__m")) / F.sum(w)).first()
    if not scale:
        raise ValueError("x has no spread to fit")
    by_x = by_x.select("__n", "__s", (F.col("__x") / scale).alias("__u"), (F.col("__m") - mean).alias("__v"))
    grid = _curve_sums(by_x, list(np.linspace(-8.0, 3.0, 23)))
    fits = {g: f for g, s in grid.items() if (f := _curve_step(s)) is not None}
    if not fits:
        raise ValueError("no curve fits: x is constant")
    g = min(fits, key=lambda k: fits[k]["rss"])
    best = fits[g]
    for _ in range(most_steps):
        if best["cosine"] < tolerance:
            break
        tried = _curve_sums(by_x, [g + float(np.clip(best["step"] * part, -1.0, 1.0)) for part in (2.0, 1.0, 0.5, 0.1, 0.01)])
        found = {k: f for k, s in tried.items() if (f := _curve_step(s)) is not None}
        # near the minimum sums of squares no longer differ, gradients still do
        least = min((f["rss"] for f in found.values()), default=np.inf)
        if not least <= best["rss"] * (1 + 1e-12):
            break
        k = min((k for k, f in found.items() if f["rss"] <= least * (1 + 1e-12)), key=lambda k: found[k]["cosine"])
        if found[k]["cosine"] >= best["cosine"] and least >= best["rss"] * (1 - 1e-12):
            break
        g, best = k, found[k]
    asym = mean + best["level"]
    free = n - 3
    spread = best["rss"] / free * np.linalg.pinv(np.asarray(best["normal"])) if free > 0 else np.full((3, 3), np.nan)
    se = [float(v) for v in np.sqrt(np.maximum(np.diag(spread), 0.0))]
    return Row(
        Asym=float(asym), R0=float(asym + best["slope"]), lrc=float(g - np.log(scale)), rss=float(best["rss"]),
        se_Asym=se[0], se_R0=se[1], se_lrc=se[2], gradient=float(best["gradient"]),
    )
