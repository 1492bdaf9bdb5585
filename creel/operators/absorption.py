"""Least squares with a factor of any number of levels.

The factor's columns are never made. Within each level the other columns are centred,
which takes the factor out of the equations; what remains is a problem in the numeric
predictors, from sums that merge. The level's own coefficients follow from its means, by
a join of the levels with the solved model.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from creel.functions.probability import two_sided_t
from creel.operators.order import numbered
from creel.operators.regression import INTERCEPT, gram
from creel.sources.tables import materialise

# workers need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def swept(within: np.ndarray, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Solve many problems at once: cross products (models x (1 + p) x (1 + p), response first).

    Each predictor in turn is swept into the solution of all models in which it does not
    depend on those before it. Returns the coefficients (NaN where left out), the inverse
    of the kept cross products (0 elsewhere) and the residual sums of squares.
    """
    k, size, _ = within.shape
    diag = np.einsum("kii->ki", within)
    scale = np.sqrt(np.where(diag > 0, diag, 1.0))
    a = within / (scale[:, :, None] * scale[:, None, :])
    kept = np.zeros((k, size), bool)
    for j in range(1, size):
        pivot = a[:, j, j]
        ok = (pivot > tol) & (diag[:, j] > 0)
        kept[:, j] = ok
        safe = np.where(ok, pivot, 1.0)
        row, col = a[:, j, :].copy(), a[:, :, j].copy()
        out = a - col[:, :, None] * row[:, None, :] / safe[:, None, None]
        out[:, j, :], out[:, :, j] = row / safe[:, None], -col / safe[:, None]
        out[:, j, j] = 1.0 / safe
        a = np.where(ok[:, None, None], out, a)
    both = kept[:, 1:, None] & kept[:, None, 1:]
    inverse = np.where(both, a[:, 1:, 1:] / (scale[:, 1:, None] * scale[:, None, 1:]), 0.0)
    beta = np.where(kept[:, 1:], a[:, 1:, 0] * scale[:, :1] / scale[:, 1:], np.nan)
    return beta, inverse, np.maximum(a[:, 0, 0] * scale[:, 0] ** 2, 0.0)


def _dot(weights: Column, values: Column) -> Column:
    return F.aggregate(F.zip_with(weights, values, lambda w, v: F.coalesce(w * v, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def _form(d: Column, inverse: Column) -> Column:
    """d' A d for a matrix in rows."""
    return _dot(d, F.transform(inverse, lambda row: _dot(row, d)))


def factor_models(df: DataFrame, responses: Sequence[str], predictors: Sequence[str], factor: str, *, by: Sequence[str] = ()) -> DataFrame:
    """``response ~ predictors + factor`` for each response and group, with intercept.

    The result is that of :func:`regression.linear_models`: one row per coefficient, the
    model statistics repeated. The first level in order is the base. Rows with a missing
    response, predictor or level are left out per response. A predictor that is constant
    within all levels, or depends on earlier ones there, has a missing estimate. Levels
    come after the predictors; their ``term_order`` rises with the level over all groups.
    """
    p = len(predictors)
    pieces = F.inline(F.array(*[F.struct(F.lit(r).alias("response"), F.col(r).cast("double").alias("__y")) for r in responses]))
    rows = df.where(F.col(factor).isNotNull()).select(*by, F.col(factor).alias("__level"), *[F.col(x).cast("double").alias(f"__x{i}") for i, x in enumerate(predictors)], pieces)
    rows = rows.select(F.struct(*by, "response").alias("g"), "__level", "__y", *[f"__x{i}" for i in range(p)])
    levels = materialise(gram(rows, ["__y", *[f"__x{i}" for i in range(p)]], ["g", "__level"]).where("n > 0"))

    size = (p + 1) * (p + 2) // 2
    total = levels.groupBy("g").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_levels"),
        F.array(*[F.sum(F.col("n") * F.col("c")[i]) for i in range(size)]).alias("within"),
        (F.sum(F.col("n") * F.col("m")[0]) / F.sum("n")).alias("mean"),
        F.min_by(F.struct("m", "n"), "__level").alias("base"),
        F.min("__level").alias("base_level"),
    )
    # sums of squares that rounding leaves of a constant column
    noise = levels.groupBy("g").agg(F.array(*[1e-24 * F.sum(F.col("n") * F.col("m")[i] * F.col("m")[i]) for i in range(p + 1)]).alias("noise"))
    total = total.join(noise, "g")
    upper = np.triu_indices(p + 1)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            w = np.zeros((len(batch), p + 1, p + 1))
            w[:, upper[0], upper[1]] = np.stack(batch.within) if len(batch) else 0.0
            w = w + np.triu(w, 1).transpose(0, 2, 1)
            low = np.einsum("kii->ki", w) <= (np.stack(batch.noise) if len(batch) else 0.0)
            low[:, 0] = False
            w[low[:, :, None] | low[:, None, :]] = 0.0
            beta, inverse, rss = swept(w)
            yield pd.DataFrame({"number": batch.number, "beta": list(beta), "inverse": [list(m) for m in inverse], "rss": rss})

    # groups travel by number, so that keys of any type stay out of the arrays
    models = materialise(total.withColumn("number", F.monotonically_increasing_id()))
    solved = models.select("number", "within", "noise").mapInPandas(solve, "number long, beta array<double>, inverse array<array<double>>, rss double")
    solved = solved.withColumn("beta", F.transform("beta", lambda b: F.nanvl(b, F.lit(None).cast("double"))))
    between = levels.join(models.select("g", "mean"), "g").groupBy("g").agg(F.sum(F.col("n") * F.pow(F.col("m")[0] - F.col("mean"), 2)).alias("between"))
    models = models.join(solved, "number").join(between, "g")
    kept = F.size(F.filter("beta", lambda b: b.isNotNull()))
    models = models.withColumn("df_residual", F.col("n") - F.col("n_levels") - kept)
    models = models.withColumn("syy", F.col("within")[0] + F.col("between"))
    models = models.withColumn("sigma2", F.when(F.col("df_residual") > 0, F.col("rss") / F.col("df_residual")))
    models = models.withColumn("r2", F.when(F.col("syy") > 0, 1 - F.col("rss") / F.col("syy")))
    n, rank = F.col("n"), F.col("n") - F.col("df_residual")
    statistics = [
        n.alias("n"),
        F.col("df_residual"),
        F.col("rss"),
        F.sqrt("sigma2").alias("sigma"),
        F.col("r2"),
        F.when(F.col("df_residual") > 0, 1 - (1 - F.col("r2")) * (n - 1) / F.col("df_residual")).alias("adj_r2"),
        F.when(F.col("rss") > 0, n * (F.ln(F.col("rss") / n) + float(np.log(2 * np.pi)) + 1) + 2 * (rank + 1)).alias("aic"),
    ]
    models = materialise(models.select("g", "beta", "inverse", "base", "base_level", "sigma2", F.struct(*statistics).alias("fit")))

    tail = lambda m: F.slice(m, 2, p)
    at_base = F.col("base.m")[0] - _dot(F.col("beta"), tail(F.col("base.m")))
    own = F.posexplode(F.arrays_zip("beta", "inverse")).alias("i", "b")
    numeric = models.select("g", "fit", "sigma2", own).select(
        "g", "fit", F.array(*[F.lit(x) for x in predictors])[F.col("i")].alias("term") if p else F.lit(None).cast("string").alias("term"),
        (F.col("i") + 1).alias("term_order"), F.col("b.beta").alias("estimate"),
        F.when(F.col("b.beta").isNotNull(), F.col("sigma2") * F.col("b.inverse")[F.col("i")]).alias("v"),
    )
    intercept = models.select(
        "g", "fit", F.lit(INTERCEPT).alias("term"), F.lit(0).alias("term_order"), at_base.alias("estimate"),
        (F.col("sigma2") * (1 / F.col("base.n") + _form(tail(F.col("base.m")), F.col("inverse")))).alias("v"),
    )
    ranks = numbered(levels.select("__level").distinct(), ["__level"], "rank")
    apart = F.zip_with(tail(F.col("m")), tail(F.col("base.m")), lambda a, b: a - b)
    effects = levels.withColumnRenamed("n", "n_level").join(models, "g").where(F.col("__level") != F.col("base_level")).join(ranks, "__level").select(
        "g", "fit", F.concat(F.lit(factor), F.col("__level").cast("string")).alias("term"), (p + F.col("rank")).cast("int").alias("term_order"),
        (F.col("m")[0] - _dot(F.col("beta"), tail(F.col("m"))) - at_base).alias("estimate"),
        (F.col("sigma2") * (1 / F.col("n_level") + 1 / F.col("base.n") + _form(apart, F.col("inverse")))).alias("v"),
    )
    out = intercept.unionByName(numeric).unionByName(effects)
    out = out.withColumn("std_error", F.sqrt("v")).withColumn("t_value", F.when(F.col("std_error") > 0, F.col("estimate") / F.col("std_error")))
    out = out.withColumn("p_value", two_sided_t(F.col("t_value"), F.col("fit.df_residual")))
    return out.select(*[F.col("g")[b].alias(b) for b in by], F.col("g.response").alias("response"), "term", "term_order", "estimate", "std_error", "t_value", "p_value", "fit.*")
