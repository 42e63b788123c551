"""Distributions and exact tests in NumPy, for use in grouped pandas functions."""

from __future__ import annotations

from itertools import takewhile
from math import erf, exp, lgamma, log, sqrt

import numpy as np


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        t = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (1 + t * d if abs(1 + t * d) > tiny else tiny)
        c = 1 + t / c if abs(1 + t / c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def f_test(f: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution."""
    if not f > 0:
        return 1.0 if f == 0 else float("nan")
    return beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        s = t = 1 / a
        n = a
        while abs(t) > 1e-16 * abs(s):
            n += 1
            t *= x / n
            s += t
        return s * front
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_inc(df / 2, x / 2)


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + erf(x / sqrt(2)))


def binomial_pmf(k: int, n: int, p: float) -> float:
    if p <= 0 or p >= 1:
        return float(k == (n if p >= 1 else 0))
    return exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p))


def binomial_cdf(k: int, n: int, p: float) -> float:
    return min(1.0, sum(binomial_pmf(i, n, p) for i in range(k + 1)))


def fisher(a: int, b: int, c: int, d: int) -> tuple[float, float, float]:
    """(left, right, two-tailed) of a 2 x 2 table; tables within 1e-12 of the observed probability count as ties."""
    r, s, k = a + b, c + d, a + c
    point = lambda x: exp(lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(s + 1) - lgamma(k - x + 1) - lgamma(s - k + x + 1) - lgamma(r + s + 1) + lgamma(k + 1) + lgamma(r + s - k + 1))
    low, high = max(0, k - s), min(r, k)
    most = min(max((r + 1) * (k + 1) // (r + s + 2), low), high)
    # Probabilities fall on both sides of the most probable table; those beyond the first that is 0 as a double add nothing.
    below = list(takewhile(lambda v: v[1] > 0, ((x, point(x)) for x in range(most, low - 1, -1))))
    every = dict([*reversed(below), *takewhile(lambda v: v[1] > 0, ((x, point(x)) for x in range(most + 1, high + 1)))])
    own = every.get(a, 0.0)
    two = sum(p for p in every.values() if p <= own * (1 + 1e-12))
    return min(1.0, sum(p for x, p in every.items() if x <= a)), min(1.0, sum(p for x, p in every.items() if x >= a)), min(1.0, two)


def het_thresholds(depth: int = 500, error: float = 0.01) -> np.ndarray:
    """For each total depth the least minor depth that is called heterozygous: the ratio of the binomial tails passes 1; the threshold never falls."""
    out, t = np.zeros(depth, np.int64), 0
    for n in range(depth):
        while t < n and binomial_cdf(t, n, 0.5) / (1 - binomial_cdf(t, n, error) + binomial_pmf(t, n, error)) <= 1:
            t += 1
        out[n] = t
    return out
