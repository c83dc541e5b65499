"""Student's t and its noncentral form as column expressions.

Neither needs a gamma function: densities are integrated over fixed grids by Simpson's rule and divided by the integral
over their whole range.  With t = sqrt(df) tan(a), Student's density is proportional to cos(a) ** (df - 1), which is
smooth, falls from 0 to a quarter turn, and has nearly all its weight within a few widths 1 / sqrt(df).  Everything is
null where the degrees of freedom are null or below 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS, ROOT_STEPS, ROUNDS = 2000, 400, 40
_WIDTHS = 16.0  # of the density, beyond which it is 0 in double precision

# Coefficients of the rational approximation of the normal distribution function by Hart, highest power first.
_ABOVE = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BELOW = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def integral(f: Callable[[Column], Column], low: Column, high: Column, steps: int = STEPS) -> Column:
    """By Simpson's rule over an even number of steps."""

    def added(total: Column, i: Column) -> Column:
        weight = F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return total + weight * f(low + i * (high - low) / steps)

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), added) * (high - low) / (3 * steps)


def _cosines(df: Column) -> Callable[[Column], Column]:
    return lambda a: F.exp((df - 1) * F.log(F.greatest(F.cos(a), F.lit(1e-300))))


def _limit(df: Column, start: Column | float = 0.0) -> Column:
    return F.least(F.lit(math.pi / 2), F.lit(_WIDTHS) / F.sqrt(df) + start)


def _known(df: Column, found: Column) -> Column:
    return F.when(df >= 1, found)


def two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|)."""
    start = F.atan(F.abs(t) / F.sqrt(df))
    tail = _let(start, lambda a: integral(_cosines(df), a, _limit(df, a)))
    return _known(df, F.when(t.isNotNull(), F.least(tail / integral(_cosines(df), F.lit(0.0), _limit(df)), F.lit(1.0))))


def quantile(p: Column, df: Column) -> Column:
    """The value below which a share p of (1/2, 1) lies, by Newton's method.

    The mass between 0 and an angle is concave, so that the steps from 0 never pass the root."""
    f = _cosines(df)
    root = lambda goal: F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.lit(0.0), lambda a, _: F.least(a + (goal - integral(f, F.lit(0.0), a, ROOT_STEPS)) / f(a), F.lit(math.pi / 2)))
    return _known(df, _let((2 * p - 1) * integral(f, F.lit(0.0), _limit(df)), lambda goal: F.sqrt(df) * F.tan(root(goal))))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function, to about 15 digits."""
    ratio = lambda z: reduce(lambda total, c: total * z + c, _ABOVE[1:], F.lit(_ABOVE[0])) / reduce(lambda total, c: total * z + c, _BELOW[1:], F.lit(_BELOW[0]))
    far = lambda z: 1 / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / math.sqrt(2 * math.pi)
    tail = _let(F.abs(x), lambda z: F.when(z > 37, 0.0).otherwise(F.exp(-z * z / 2) * F.when(z < 7.07106781186547, ratio(z)).otherwise(far(z))))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def power(effect: Column, n: Column, alpha: float) -> Column:
    """Achieved power of a two-sided one-sample test of n values: the chance that the noncentral t lies beyond the edges.

    The statistic lies between them where a normal value, shifted by effect * sqrt(n), is less than edge times the chi
    scale s; that chance is averaged over the density of s."""
    df = n - 1
    spread = 12.0 / F.sqrt(2 * df)
    low, high = F.greatest(F.lit(1e-9), 1 - spread), 1 + spread
    weight = lambda s: F.exp((df - 1) * F.log(s) - df * (s * s - 1) / 2)
    shift = effect * F.sqrt(n)
    inside = lambda edge: integral(lambda s: weight(s) * (normal_cdf(edge * s - shift) - normal_cdf(-edge * s - shift)), low, high)
    missed = _let(quantile(F.lit(1 - alpha / 2), df), inside) / integral(weight, low, high)
    return _known(df, F.when(effect.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - missed))))


def effect_class(d: Column) -> Column:
    """The usual cut-offs at 0.2, 0.5 and 0.8."""
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").when(size.isNotNull(), "large")
