"""Exact one-sided binomial bounds as column expressions of fixed cost.

``P(Bin(n, p) <= x)`` is the upper tail of a beta distribution, that is, the regularised incomplete beta function. Its density is
``n`` times a binomial probability, which is written by Stirling's series and deviances, so nothing cancels for large counts. The
smaller tail is integrated by Gauss-Legendre nodes over the part of it that matters: a few standard deviations, and
a few scales of its exponential end. The number of nodes does not depend on the counts.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.arrays import let

_NODES = [(float((x + 1) / 2), float(w / 2)) for x, w in zip(*np.polynomial.legendre.leggauss(64), strict=True)]
#: what Stirling's formula leaves out of ln k!, for small k
_LEFT_OUT = [0.0] + [math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, 16)]
#: the tail is cut where the density has fallen by more than e^-45
_SPREADS, _SCALES = 10.0, 45.0
_STEPS = 10


def _stirling_rest(k: Column) -> Column:
    """ln k! less Stirling's formula, for a double that holds a whole number."""
    r = 1.0 / (k * k)
    series = (F.lit(1 / 12) - r * (F.lit(1 / 360) - r * (F.lit(1 / 1260) - r * (F.lit(1 / 1680) - r * F.lit(1 / 1188))))) / k
    return F.when(k < 16, F.get(F.array(*[F.lit(v) for v in _LEFT_OUT]), k.cast("int"))).otherwise(series)


def _excess(u: Column) -> Column:
    """(1 + u) ln(1 + u) - u, by its series near zero."""
    series = F.lit(0.0)
    for k in range(18, 1, -1):
        series = F.lit((-1.0) ** k / (k * (k - 1))) + u * series
    return F.when(F.abs(u) < 0.1, u * u * series).otherwise((1.0 + u) * F.log1p(u) - u)


def _log_density(x: Column, m: Column, t: Column, lead: Column) -> Column:
    """ln of the probability of x in m trials at t, ``lead`` being the part without t."""
    rest = m - x
    at, away = m * t, m * (1.0 - t)
    inner = lead - at * _excess((x - at) / at) - away * _excess((rest - away) / away)
    return F.when(x == 0, m * F.log1p(-t)).when(rest == 0, m * F.log(t)).otherwise(inner)


def _lead(x: Column, m: Column) -> Column:
    rest = m - x
    inner = _stirling_rest(m) - _stirling_rest(x) - _stirling_rest(rest) + 0.5 * F.log(m / (F.lit(2 * math.pi) * x * rest))
    return F.when((x == 0) | (rest == 0), F.lit(0.0)).otherwise(inner)


def _density(s: Column, t: Column) -> Column:
    """Density of the beta distribution of (x + 1, n - x)."""
    return s["n"] * F.exp(_log_density(s["x"], s["n"] - 1.0, t, s["lead"]))


def _shape(x: Column, n: Column) -> Column:
    x, n = x.cast("double"), n.cast("double")
    a, b = x + 1.0, n - x
    return F.struct(
        x.alias("x"), n.alias("n"), _lead(x, n - 1.0).alias("lead"), (a / (n + 1.0)).alias("mean"),
        (F.lit(_SPREADS) * F.sqrt(a * b / ((n + 1.0) * (n + 1.0) * (n + 2.0))) + F.lit(_SCALES) / n).alias("reach"),
    )


def _tail(s: Column, p: Column) -> Column:
    """Upper tail of the beta distribution at p: P(Bin(n, p) <= x)."""
    nodes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in _NODES])

    def integral(ends: Column) -> Column:
        span = ends["hi"] - ends["lo"]
        add = lambda acc, v: acc + v["w"] * _density(s, ends["lo"] + span * v["x"])
        area = span * F.aggregate(nodes, F.lit(0.0), add)
        return F.when(ends["upper"], area).otherwise(1.0 - area)

    upper = p >= s["mean"]
    lo = F.when(upper, p).otherwise(F.greatest(F.lit(0.0), p - s["reach"]))
    hi = F.when(upper, F.least(F.lit(1.0), p + s["reach"])).otherwise(p)
    # both tails fall from p on, so a reach from there holds all of the area that counts
    return let(F.struct(lo.alias("lo"), hi.alias("hi"), upper.alias("upper")), integral)


def binomial_cdf(x: Column, n: Column, p: float | Column) -> Column:
    """P(Bin(n, p) <= x)."""
    prob = p if isinstance(p, Column) else F.lit(float(p))
    inner = let(_shape(x, n), lambda s: _tail(s, prob))
    return F.when(x >= n, F.lit(1.0)).when(x < 0, F.lit(0.0)).when(prob <= 0, F.lit(1.0)).when(prob >= 1, F.lit(0.0)).otherwise(inner)


def bound_within(x: Column, n: Column, confidence: float, target: float) -> Column:
    """True when the Clopper-Pearson upper bound of ``x`` stops in ``n`` trials is <= target.

    ``upper <= target`` holds exactly when ``P(Bin(n, target) <= x) <= 1 - confidence``; no
    inverse of the beta function is needed. All ``n`` trials stopping gives a bound of one.
    """
    return F.when(x >= n, F.lit(1.0 <= target)).otherwise(
        binomial_cdf(x, n, target) <= F.lit(1.0 - confidence + 1e-15)
    )


def upper_bound(x: Column, n: Column, confidence: float) -> Column:
    """Clopper-Pearson upper bound by Newton's method on the logarithm of the tail.

    The logarithm falls and is concave in p, so steps from the right of the bound stay there and shrink to it, and a step from
    the left lands to the right. They start at the score bound of one more success.
    """
    alpha, z = 1.0 - confidence, NormalDist().inv_cdf(confidence)

    def solved(s: Column) -> Column:
        a, n_ = s["x"] + 1.0, s["n"]
        start = (a + z * z / 2 + z * F.sqrt(a * (n_ - a) / n_ + z * z / 4)) / (n_ + z * z)

        def step(p: Column, _i: Column) -> Column:
            def moved(tail: Column) -> Column:
                change = F.try_divide(tail * (F.log(tail) - F.lit(math.log(alpha))), _density(s, p))
                return F.greatest(p / 8, F.least((1.0 + p) / 2, p + F.coalesce(change, -p / 2)))

            return let(_tail(s, p), moved)

        return F.aggregate(F.array(*[F.lit(i) for i in range(_STEPS)]), F.least(start, (1.0 + s["mean"]) / 2), step)

    return F.when(x >= n, F.lit(1.0)).otherwise(let(_shape(x, n), solved))


def lower_bound(x: Column, n: Column, confidence: float) -> Column:
    """Lower bound by symmetry: failures and successes swap."""
    return F.when(x <= 0, F.lit(0.0)).otherwise(F.lit(1.0) - upper_bound(n - x, n, confidence))


def minimum_horizons(target: float, confidence: float) -> int:
    """Fewest clean horizons with which a zero-stop calibration can pass."""
    return math.ceil(math.log(1.0 - confidence) / math.log(1.0 - target))
