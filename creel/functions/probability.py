"""Student's t probabilities as column expressions.

The two-sided probability is the regularised incomplete beta function I_x(v/2, 1/2) at
x = v / (v + t²), taken from its continued fraction. The fraction is folded from its
last term to its first over a sequence whose length follows from the degrees of freedom.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log, pi

from pyspark.sql import Column, functions as F

# beyond this many degrees of freedom the distribution is matched at this many; the error is of the order of its square
_MOST = 1e6
_SHIFT = 12


def log_gamma_half_step(a: Column) -> Column:
    """ln(Γ(a + 1/2) / Γ(a)) for a > 0: its asymptotic series at a + 12, and the factors from there down.

    The two logarithms nearly cancel for large a; the series of their difference does not.
    """
    z = a + _SHIFT
    series = F.ln(z) / 2 - 1 / (8 * z) + 1 / (192 * z * z * z) - 1 / (640 * F.pow(z, F.lit(5))) + 17 / (14336 * F.pow(z, F.lit(7)))
    down = F.aggregate(F.sequence(F.lit(0), F.lit(_SHIFT - 1)), F.lit(0.0), lambda s, k: s + F.ln((a + k) / (a + k + 0.5)))
    return series + down


def _fraction(a: Column, b: Column, x: Column, terms: Column) -> Column:
    """The continued fraction of the incomplete beta function: 1 + d1/(1 + d2/(1 + ...)), from the last term on."""

    def term(k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(k % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(1.0), lambda f, k: 1 + term(k) / f)


def _let(use: Callable[..., Column], **values: Column) -> Column:
    """Work values out once for each row and hand them on, also into lambdas, where they would be worked out for every term."""
    held = F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), lambda s: use(**{n: s[n] for n in values}))
    return F.get(held, F.lit(0))


def two_sided_t(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) with ``df`` > 0 degrees of freedom; missing where either is missing or df is not positive."""

    def bounded(t: Column, df: Column) -> Column:
        large = df > _MOST
        v = F.when(large, _MOST).when(df > 0, df)
        # matched by (v - 1/2) ln(1 + t²/v), to which the logarithm of the tail is nearly equal
        matched = _MOST * F.expm1((df - 0.5) * F.log1p(t * t / df) / (_MOST - 0.5))
        square = F.when(large, matched).otherwise(t * t)
        return _let(placed, v=v, square=F.when(square.isNotNull(), F.least(square, F.lit(1e300))))

    def placed(v: Column, square: Column) -> Column:
        return _let(chosen, a=v / 2, v=v, square=square, x=v / (v + square), y=square / (v + square))

    def chosen(a: Column, v: Column, square: Column, x: Column, y: Column) -> Column:
        direct = x < (a + 1) / (a + 2.5)
        first, second = F.when(direct, a).otherwise(0.5), F.when(direct, F.lit(0.5)).otherwise(a)
        # terms needed grow with the root of the larger parameter
        terms = (60 + 8 * F.ceil(F.sqrt(a))).cast("int")
        # the powers of x and y and the gamma functions before the fraction
        front = F.exp(log_gamma_half_step(a) - log(pi) / 2 - a * F.log1p(square / v) + F.ln(y) / 2) / first
        return _let(summed, direct=direct, a=first, b=second, x=F.when(direct, x).otherwise(y), terms=terms, front=front, square=square, v=v)

    def summed(direct: Column, a: Column, b: Column, x: Column, terms: Column, front: Column, square: Column, v: Column) -> Column:
        part = front / _fraction(a, b, x, terms)
        return F.when(square == 0, F.when(v.isNotNull(), 1.0)).when(direct, part).otherwise(1 - part)

    return _let(bounded, t=t.cast("double"), df=df.cast("double"))
