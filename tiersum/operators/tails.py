"""Tail probabilities: the normal one as a column expression, the others as vectorized helpers over one number a row."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Coefficients of a Chebyshev fit of the complementary error function (relative error below 1.2e-7), constant term first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function."""
    size = F.abs(x)
    t = 1 / (1 + size / 2)
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = poly * t + c
    tail = t * F.exp(poly - size * size)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def normal_cdf(z: Column) -> Column:
    return erfc(-z / math.sqrt(2)) / 2


def normal_tail(z: Column) -> Column:
    """Two-sided tail probability of a standard normal; null for null."""
    return erfc(F.abs(z) / math.sqrt(2))


def _log_gamma(v: np.ndarray) -> np.ndarray:
    """By distinct values, of which degrees of freedom have few."""
    own, at = np.unique(v, return_inverse=True)
    return np.array([math.lgamma(x) for x in own])[at].reshape(np.shape(v))


def _away(v: np.ndarray) -> np.ndarray:
    """Divisors that are 0 moved off it."""
    return np.where(v == 0, 1e-300, v)


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta function by its continued fraction, for all rows at once; 0 up to 0 and 1 from 1 on."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    inside = (x > 0) & (x < 1)
    turned = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turned, b, a), np.where(turned, a, b), np.where(inside, np.where(turned, 1 - x, x), 0.5)
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    c, d = np.ones_like(z), 1 / _away(1 - (p + q) * z / (p + 1))
    total, going = d.copy(), np.ones(z.shape, bool)
    for m in range(1, 500):
        for k in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / _away(1 + k * d)
            c = _away(1 + k / c)
            total = np.where(going, total * c * d, total)
        going &= np.abs(c * d - 1) >= 1e-14
        if not going.any():
            break
    value = np.where(turned, 1 - front * total, front * total)
    return np.where(inside, value, (x >= 1).astype(float))


def student_share(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail probability of Student's t, nan without a degree of freedom."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    ok = ~np.isnan(t) & (df >= 1)
    n, x = np.where(ok, df, 1.0), np.where(ok & np.isfinite(t), t, 0.0)
    return np.where(ok, np.where(np.isinf(t), 0.0, beta_share(n / 2, 0.5, n / (n + x * x))), np.nan)


@F.pandas_udf(T.DoubleType())
def student_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail probability of Student's t; null without a degree of freedom."""
    got = student_share(t.to_numpy(float), df.to_numpy(float))
    return pd.Series(got).astype("Float64").mask(np.isnan(got))


def student_quantiles(p: float, df: np.ndarray) -> np.ndarray:
    """t with two-sided tail probability p, by bisection for all degrees of freedom at once."""
    df = np.asarray(df, float)
    lo, hi = np.zeros(len(df)), np.full(len(df), 1e6)
    for _ in range(200):
        mid = (lo + hi) / 2
        above = student_share(mid, df) > p
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return hi


def student_quantile(p: float, df: int) -> float:
    return float(student_quantiles(p, np.array([df]))[0])


@F.pandas_udf(T.DoubleType())
def student_width(df: pd.Series) -> pd.Series:
    """Half width of a 95 % interval in standard errors; null without a degree of freedom."""
    own = np.array(sorted({int(n) for n in df.dropna() if n >= 1}), float)
    return df.map(dict(zip(own, student_quantiles(0.05, own)))).astype(float)


def gamma_share(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized upper incomplete gamma function for all rows at once, by its series up to a + 1 and by its continued fraction beyond; 1 up to 0."""
    a, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, x))
    out = np.ones(x.shape)
    low, high = (x > 0) & (x < a + 1), (x > 0) & (x >= a + 1)
    scale = np.zeros(x.shape)
    some = low | high
    scale[some] = np.exp(a[some] * np.log(x[some]) - x[some] - _log_gamma(a[some]))
    if low.any():
        k, z = a[low].copy(), x[low]
        term = 1 / k
        total = term.copy()
        while (term > total * 1e-16).any():
            k = k + 1
            term = term * z / k
            total = total + term
        out[low] = 1 - total * scale[low]
    if high.any():
        p, b = a[high], x[high] + 1 - a[high]
        c, d = np.full(len(b), 1e300), 1 / b
        h, going = d.copy(), np.ones(len(b), bool)
        for i in range(1, 2000):
            b = b + 2
            k = i * (p - i)
            d = 1 / _away(k * d + b)
            c = _away(b + k / c)
            h = np.where(going, h * d * c, h)
            going &= np.abs(d * c - 1) >= 1e-14
            if not going.any():
                break
        out[high] = h * scale[high]
    return out


@F.pandas_udf(T.DoubleType())
def chi_square_tail(q: pd.Series, df: pd.Series) -> pd.Series:
    x = q.to_numpy(float)
    got = gamma_share(df.to_numpy(float) / 2, np.where(np.isnan(x), 0.0, x) / 2)
    return pd.Series(got).astype("Float64").mask(np.isnan(x))


@lru_cache(maxsize=64)
def _signed_ranks(n: int) -> np.ndarray:
    """Number of sign patterns by sum of positive ranks 1..n, as shares."""
    ways = np.ones(1)
    for r in range(1, n + 1):
        longer = np.zeros(len(ways) + r)
        longer[: len(ways)] += ways / 2
        longer[r:] += ways / 2
        ways = longer
    return ways


def wilcoxon_share(rank_sum: np.ndarray, n: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Two-sided p for all rows at once, nan where there is none."""
    rank_sum, n, ties = (np.asarray(v, float) for v in np.broadcast_arrays(rank_sum, n, ties))
    ok = ~np.isnan(rank_sum) & (n >= 1)
    total = n * (n + 1) / 2
    low = np.minimum(rank_sum, total - rank_sum)
    out = np.full(rank_sum.shape, np.nan)
    exact = ok & (ties == 0) & (n <= 50)
    for m in np.unique(n[exact]):
        here = exact & (n == m)
        reach = np.cumsum(_signed_ranks(int(m)))
        out[here] = np.minimum(1.0, 2 * reach[low[here].astype(int)])
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    normal = ok & ~exact & (var > 0)
    z = (low[normal] - total[normal] / 2) ** 2 / (2 * var[normal])
    out[normal] = gamma_share(np.full(len(z), 0.5), z)  # the complementary error function of the root of z
    return out


@F.pandas_udf(T.DoubleType())
def wilcoxon_tail(rank_sum: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    """Two-sided p of a sum of positive ranks of n differences, none 0: exact up to 50 without ties, else by the normal law.

    ties: sum of t^3 - t over groups of equal sizes.
    """
    got = wilcoxon_share(*(v.astype(float).to_numpy(float) for v in (rank_sum, n, ties)))
    return pd.Series(got).astype("Float64").mask(np.isnan(got))
