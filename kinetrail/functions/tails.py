"""Tail probabilities: normal, Student t, F, chi squared, Kolmogorov; and the Shapiro-Wilk and signed-rank tests of small samples.

The plain functions take floats. The columns apply them in Arrow batches to tables of tests, which are small.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    """Quantile by bisection of the tail, to full precision."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - normal_sf(mid) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b if abs(an * d + b) > 1e-300 else 1e-300)
        c = b + an / c if abs(b + an / c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h / a


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def kolmogorov_sf(x: float) -> float:
    """Asymptotic tail of the two-sample distance times sqrt(n m / (n + m))."""
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def signed_rank_exact(n: int, w: float) -> float:
    """Two-sided p of the smaller rank sum ``w`` of ``n`` differences without ties."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for k in range(1, n + 1):
        ways[k:] += ways[:-k].copy()
    return min(1.0, 2 * ways[: int(math.floor(w)) + 1].sum() / 2**n)


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's approximation for 3 to 5000 values; NaN beyond, or where all values are equal."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if not 3 <= n <= 5000 or x[0] == x[-1]:
        return math.nan, math.nan
    m = np.array([normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    s, u = float(m @ m), 1 / math.sqrt(n)
    a = np.zeros(n)
    # fixed values: the coefficients of the published approximation
    last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / math.sqrt(s)], u)
    if n == 3:
        a[-1] = math.sqrt(0.5)
        a[0] = -a[-1]
    elif n <= 5:
        a[1:-1] = m[1:-1] / math.sqrt((s - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    else:
        second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(s)], u)
        a[2:-2] = m[2:-2] / math.sqrt((s - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
        a[-1], a[0], a[-2], a[1] = last, -last, second, -second
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if n <= 11:
        g = -2.273 + 0.459 * n
        mu, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        z = (-math.log(g - math.log(max(1 - w, 1e-300))) - mu) / sd
    else:
        y = math.log(n)
        mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], y), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], y))
        z = (math.log(max(1 - w, 1e-300)) - mu) / sd
    return w, normal_sf(z)


def _column(fn, *cols: Column) -> Column:
    """``fn`` of columns; null where one of them is null."""

    @F.pandas_udf("double")
    def run(x: pd.DataFrame) -> pd.Series:
        v = x.to_numpy(dtype=float)
        return pd.Series([None if np.isnan(r).any() else fn(*r) for r in v], dtype="float64")

    return run(F.struct(*[c.cast("double") for c in cols]))


def p_normal(z: Column) -> Column:
    return _column(lambda z: 2 * normal_sf(abs(z)), z)


def p_student(t: Column, df: Column) -> Column:
    return _column(t_two_sided, t, df)


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _column(f_sf, f, d1, d2)


def p_chi2(x: Column, df: Column) -> Column:
    return _column(chi2_sf, x, df)


def p_kolmogorov(d: Column, na: Column, nb: Column) -> Column:
    return _column(lambda d, a, b: kolmogorov_sf(d * math.sqrt(a * b / (a + b))), d, na, nb)


def p_signed_rank(n: Column, w_plus: Column, w_minus: Column, ties: Column) -> Column:
    """Exact up to 25 differences without ties, else the normal approximation with the tie correction; 1 without differences."""

    def p(n: float, a: float, b: float, ties: float) -> float:
        if n == 0:
            return 1.0
        if n <= 25 and ties == 0:
            return signed_rank_exact(int(n), min(a, b))
        sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        return 2 * normal_sf(abs(min(a, b) - n * (n + 1) / 4) / sd) if sd else 1.0

    return _column(p, n, w_plus, w_minus, ties)
