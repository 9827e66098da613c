"""Tail probabilities and quantiles for results that have one row per test."""

from __future__ import annotations

import math
from statistics import NormalDist

_N = NormalDist()


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    if p <= 0.0:
        return -math.inf
    return math.inf if p >= 1.0 else _N.inv_cdf(p)


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of chi-squared with a whole number of degrees of freedom, in closed form."""
    if math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    h = x / 2.0
    if dof % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, dof // 2):
            term *= h / i
            total += term
        return min(1.0, math.exp(-h) * total)
    tail = math.erfc(math.sqrt(h))
    extra = sum(math.exp((i - 0.5) * math.log(h) - h - math.lgamma(i + 0.5)) for i in range(1, (dof + 1) // 2))
    return min(1.0, tail + extra)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    value = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + k * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + k / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def t_sf2(t: float, dof: float) -> float:
    """Both tails of Student's t."""
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t)) if math.isfinite(t) else (math.nan if math.isnan(t) else 0.0)


def t_ppf(p: float, dof: float) -> float:
    """Quantile of Student's t by bisection."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_ppf(1.0 - p, dof)
    lo, hi = 0.0, 1.0
    while 0.5 * t_sf2(hi, dof) > 1.0 - p:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if 0.5 * t_sf2(mid, dof) > 1.0 - p else (lo, mid)
    return (lo + hi) / 2.0


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    if math.isnan(f):
        return math.nan
    return 1.0 if f <= 0 else beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def mwu_exact_p(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of a tie-free rank-sum statistic.

    The counts of arrangements by their U are the coefficients of the product of (1 - x^(n2+i)) / (1 - x^i), i = 1 to n1
    (n1 the smaller); factors are applied one after another to one row, of which only the lower tail is needed.
    """
    n1, n2 = sorted((n1, n2))
    top = math.floor(min(u, n1 * n2 - u))
    row = [0] * (top + 1)
    row[0] = 1
    for i in range(1, n1 + 1):
        for k in range(top, n2 + i - 1, -1):
            row[k] -= row[k - n2 - i]
        for k in range(i, top + 1):
            row[k] += row[k - i]
    return min(1.0, 2 * sum(row) / math.comb(n1 + n2, n1))


def mwu_p(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided p of U; exact where either sample has 8 values or fewer and none tie, else normal with corrections."""
    if min(n1, n2) < 1:
        return math.nan
    if min(n1, n2) <= 8 and ties == 0:
        return mwu_exact_p(u, n1, n2)
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / math.sqrt(var)
    return min(1.0, 2.0 * norm_sf(z))


def ks_p(d: float, n1: int, n2: int, exact_to: int = 10_000) -> float:
    """Two-sided p of the two-sample Kolmogorov-Smirnov distance: exact up to ``exact_to`` values a sample, else from the limit."""
    if min(n1, n2) < 1 or math.isnan(d):
        return math.nan
    if max(n1, n2) <= exact_to:
        return ks_exact_p(d, n1, n2)
    root = math.sqrt(n1 * n2 / (n1 + n2))
    z = (root + 0.12 + 0.11 / root) * d
    if z < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * z) ** 2) for k in range(1, 101))))


def ks_exact_p(d: float, n1: int, n2: int) -> float:
    """One less the share of lattice paths from (0, 0) to (n1, n2) that keep all |i / n1 - j / n2| below ``d``.

    Paths are counted row by row, as running sums over the places that a row may pass; rows are scaled as they grow.
    """
    import numpy as np

    g = math.gcd(n1, n2)
    a, b = n1 // g, n2 // g
    most = round(d * a * n2)  # d is a multiple of 1 / (a * n2): |i * b - j * a| must stay below this
    if most <= 0:
        return 1.0
    row, low, log = np.ones(min(n2, (most - 1) // a) + 1), 0, 0.0  # of i = 0
    for i in range(1, n1 + 1):
        first, last = max(0, -(-(i * b - most + 1) // a)), min(n2, (i * b + most - 1) // a)
        if first > last:
            return 1.0
        wide = np.zeros(last - first + 1)
        have = row[max(0, first - low) : last - low + 1]
        wide[max(0, low - first) : max(0, low - first) + len(have)] = have
        row, low = np.cumsum(wide), first
        top = row[-1]
        if top == 0:
            return 1.0
        row, log = row / top, log + math.log(top)
    inside = math.exp(log + math.lgamma(n1 + 1) + math.lgamma(n2 + 1) - math.lgamma(n1 + n2 + 1)) * float(row[-1])
    return min(1.0, max(0.0, 1.0 - inside))
