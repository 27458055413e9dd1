"""Vectorised distribution functions Spark has no built-in for.

NumPy on whole Arrow batches: regularised incomplete beta function, its inverse,
and Student's t through it. Used on already aggregated rows (tests) or once per
scored row (beta score).
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

# Coefficients of the Stirling series of log gamma, B(2k) / (2k (2k-1)).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def gammaln(x):
    """log gamma for x > 0: shift up to x >= 12, then the Stirling series."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    z = x.copy()
    for _ in range(12):
        small = z < 12
        if not small.any():
            break
        shift = np.where(small, shift + np.log(np.where(small, z, 1.0)), shift)
        z = np.where(small, z + 1, z)
    series = np.zeros_like(z)
    for k, c in enumerate(STIRLING):
        series += c / z ** (2 * k + 1)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def _fraction(a, b, x):
    """Continued fraction of the incomplete beta function, all elements at once;
    elements that have converged leave the working set."""
    tiny = 1e-300
    out = np.empty_like(x)
    live = np.arange(x.size)
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    m, most = 0, 20_000 + 100 * np.sqrt(max(a.max(initial=0), b.max(initial=0)))  # some root of the larger parameter is needed
    while live.size:
        m += 1
        if m > most:
            raise ArithmeticError(f"the incomplete beta function did not converge in {m} terms")
        for odd in (False, True):
            if odd:
                num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            else:
                num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        done = np.abs(step - 1.0) < 4e-16 * (1 + m**0.5)
        if done.any():
            out[live[done]] = h[done]
            keep = ~done
            live, a, b, x, c, d, h = (v[keep] for v in (live, a, b, x, c, d, h))
    return out


def betainc(a, b, x):
    """Regularised incomplete beta function I_x(a, b); NaN outside its domain."""
    a, b, x = (v.astype(float).ravel() for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)] = 0.0
    out[ok & (x == 1)] = 1.0
    inner = np.flatnonzero(ok & (x > 0) & (x < 1))
    if inner.size == 0:
        return out
    a, b, x = a[inner], b[inner], x[inner]
    front = np.exp(gammaln(a + b) - gammaln(a) - gammaln(b) + a * np.log(x) + b * np.log1p(-x))
    flip = x >= (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    part = front * _fraction(p, q, z) / p
    out[inner] = np.where(flip, 1.0 - part, part)
    return out


# Rational approximation of the normal quantile, error below 4.5e-4.
NORMAL_TOP = (2.515517, 0.802853, 0.010328)
NORMAL_BOTTOM = (1.0, 1.432788, 0.189269, 0.001308)


def _first_guess(p, a, b):
    """Start of the search for a Beta quantile: normal approximation of the
    log odds for a, b > 1, else the mean."""
    tail = np.clip(np.minimum(p, 1 - p), 1e-300, 0.5)
    u = np.sqrt(-2 * np.log(tail))
    z = u - np.polyval(NORMAL_TOP[::-1], u) / np.polyval(NORMAL_BOTTOM[::-1], u)
    z = np.where(p < 0.5, z, -z)
    with np.errstate(all="ignore"):
        r = (z * z - 3) / 6
        s, t = 1 / (2 * a - 1), 1 / (2 * b - 1)
        h = 2 / (s + t)
        w = z * np.sqrt(h + r) / h - (t - s) * (r + 5 / 6 - 2 / (3 * h))
        guess = a / (a + b * np.exp(2 * w))
    usable = (a > 1) & (b > 1) & np.isfinite(guess) & (guess > 0) & (guess < 1)
    return np.clip(np.where(usable, guess, a / (a + b)), 1e-12, 1 - 1e-12)


def beta_ppf(p, a, b):
    """Quantile of Beta(a, b): Newton steps inside a shrinking bracket."""
    p, a, b = (v.astype(float).ravel() for v in np.broadcast_arrays(p, a, b))
    out = np.full(p.shape, np.nan)
    ok = (a > 0) & (b > 0) & (p >= 0) & (p <= 1)
    out[ok & (p == 0)] = 0.0
    out[ok & (p == 1)] = 1.0
    live = np.flatnonzero(ok & (p > 0) & (p < 1))
    if live.size == 0:
        return out
    p, a, b = p[live], a[live], b[live]
    log_beta = gammaln(a) + gammaln(b) - gammaln(a + b)
    lo, hi = np.zeros_like(p), np.ones_like(p)
    x = _first_guess(p, a, b)
    for _ in range(1200):  # enough to halve the bracket down to the smallest number
        err = betainc(a, b, x) - p
        hi = np.where(err > 0, x, hi)
        lo = np.where(err <= 0, x, lo)
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            density = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - log_beta)
            step = x - err / density
        inside = np.isfinite(step) & (step > lo) & (step < hi)
        new = np.where(inside, step, 0.5 * (lo + hi))
        # Newton doubles the digits: a step this small leaves none to gain.
        done = (inside & (np.abs(new - x) <= 1e-8 * new)) | (hi - lo <= 1e-15 * hi)
        done |= (new <= 0) | (new >= 1)
        done |= err == 0
        x = np.where(err == 0, x, new)
        if done.any():
            out[live[done]] = x[done]
            keep = ~done
            live, p, a, b, lo, hi, x, log_beta = (
                v[keep] for v in (live, p, a, b, lo, hi, x, log_beta))
            if live.size == 0:
                return out
    raise ArithmeticError("a quantile of the Beta distribution was not found")


#: Beyond so many degrees of freedom Student's t goes by its expansion around the normal distribution.
MANY = 1e5


def t_sf(t, df):
    """P(T > t) for Student's t."""
    t, df = (v.astype(float).ravel() for v in np.broadcast_arrays(t, df))
    many = df > MANY
    few = np.where(many, MANY, df)
    tail = 0.5 * betainc(few / 2, np.full_like(few, 0.5), few / (few + t * t))
    if many.any():
        x, n = np.abs(t[many]), df[many]
        with np.errstate(over="ignore", invalid="ignore"):
            near = x - (x**3 + x) / (4 * n) + (13 * x**5 + 8 * x**3 + 3 * x) / (96 * n * n)
            far = (8 * n + 1) / (8 * n + 3) * np.sqrt(n * np.log1p(x * x / n))
            z = np.where(x < 30, near, far)
        tail[many] = [0.5 * math.erfc(v / math.sqrt(2)) for v in z]
    return np.where(t >= 0, tail, 1 - tail)


def t_ppf(q, df):
    """Quantile of Student's t."""
    q, df = (v.astype(float).ravel() for v in np.broadcast_arrays(q, df))
    tail = np.where(q > 0.5, 1 - q, q)
    x = beta_ppf(2 * tail, df / 2, np.full_like(df, 0.5))
    with np.errstate(divide="ignore", invalid="ignore"):
        size = np.sqrt(df * (1 - x) / x)
        # For many degrees of freedom x is next to 1 and its digits are lost; the expansion in 1 / df is exact to 1e-15 there.
        z = np.abs(np.array([NormalDist().inv_cdf(v) if 0 < v < 1 else np.nan for v in tail]))
        near = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df)
    size = np.where((df > MANY) & np.isfinite(near), near, size)
    return np.where(q > 0.5, size, -size)


def z_quantile(q: float) -> float:
    """Quantile of the standard normal distribution."""
    return NormalDist().inv_cdf(q)


def _nullable(values: np.ndarray) -> pd.Series:
    return pd.Series(values).astype("float64").where(~np.isnan(values), None)


def beta_quantile(p, a, b):
    """Column: quantile of Beta(a, b) at ``p``, NULL where it does not exist."""

    @F.pandas_udf("double")
    def run(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return _nullable(beta_ppf(p.to_numpy(float), a.to_numpy(float), b.to_numpy(float)))

    return run(F.col(p) if isinstance(p, str) else p, a, b)


def t_two_sided(t, df):
    """Column: two-sided p-value ``2 * P(T > |t|)``."""

    @F.pandas_udf("double")
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return _nullable(2 * t_sf(np.abs(t.to_numpy(float)), df.to_numpy(float)))

    return run(t, df)


def t_critical(q: float, df):
    """Column: quantile of Student's t at the fixed level ``q``."""

    @F.pandas_udf("double")
    def run(df: pd.Series) -> pd.Series:
        values = df.to_numpy(float)
        distinct, back = np.unique(values, return_inverse=True)
        return _nullable(t_ppf(np.full(distinct.shape, q), distinct)[back])

    return run(df)
