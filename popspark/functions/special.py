"""Distribution functions that Spark SQL lacks, as vectorised columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gamma_tail(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function, by its series or Lentz's continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * scale


def beta_part(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by a continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_tails(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``gamma_tail`` of whole arrays: rounds of the series or the fraction run for all values that still change."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    out[np.isnan(a) | np.isnan(x)] = np.nan
    with np.errstate(all="ignore"):
        scale = np.exp(a * np.log(x) - x - _log_gamma(a))
        low, high = np.flatnonzero((x > 0) & (x < a + 1)), np.flatnonzero((x > 0) & (x >= a + 1))
        if len(low):
            n, y = a[low].copy(), x[low]
            term = total = 1 / n
            for _ in range(100_000):
                n = n + 1
                term = term * y / n
                total = total + term
                if (term <= total * 1e-17).all():
                    break
            out[low] = np.maximum(0, 1 - total * scale[low])
        if len(high):
            k, y = a[high], x[high]
            b = y + 1 - k
            c, d = np.full(len(k), 1e300), 1 / b
            h = d
            for i in range(1, 100_000):
                an = -i * (i - k)
                b = b + 2
                d, c = _away(an * d + b), _away(b + an / c)
                d = 1 / d
                h = h * d * c
                if (np.abs(d * c - 1) < 1e-16).all():
                    break
            out[high] = h * scale[high]
    return out


def beta_parts(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``beta_part`` of whole arrays."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
        c, d = np.ones(x.shape), 1 / _away(1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 100_000):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / _away(1 + num * d), _away(1 + num / c)
                h = h * d * c
            if not (np.abs(d * c - 1) >= 1e-16).any():
                break
        part = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * h))
    return np.where(turned, 1 - part, part)


def _away(v: np.ndarray) -> np.ndarray:
    return np.where(np.abs(v) > 1e-300, v, 1e-300)


_log_gamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _floats(f):
    return lambda v: np.asarray(f(np.asarray(v, float)), float)


_log_gamma, _erfc = _floats(lambda v, f=_log_gamma: f(np.where(v > 0, v, 1.0))), _floats(_erfc)


def normal_tails(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def solved(falling, p: np.ndarray, low: float, high: float) -> np.ndarray:
    """Where the falling function of arrays takes the value ``p``: the range doubles upwards, then halves until it can't."""
    p = np.asarray(p, float)
    a, b = np.full(p.shape, low), np.full(p.shape, high)
    with np.errstate(all="ignore"):
        for _ in range(1100):
            more = falling(b) > p
            if not more.any() or high <= 1 and low == 0:
                break
            b = np.where(more, b * 2, b)
        for _ in range(1100):
            mid = (a + b) / 2
            up = falling(mid) > p
            a, b, same = np.where(up, mid, a), np.where(up, b, mid), (mid == a) | (mid == b)
            if same.all():
                break
    return np.where((p >= 0) & (p <= 1), (a + b) / 2, np.nan)


def _arrays(f, *columns: pd.Series) -> pd.Series:
    """``f`` of the columns as arrays; null where one is null or the result isn't a number."""
    out = pd.Series(f(*(c.to_numpy(float, na_value=np.nan) for c in columns)), dtype="float64")
    return out.where(out.notna() & ~pd.concat([c.isna() for c in columns], axis=1).any(axis=1), None)


@F.pandas_udf(T.DoubleType())
def chi2_p(chi2: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of chi-square; null where an argument is."""
    return _arrays(lambda x, k: np.where(k > 0, gamma_tails(np.where(k > 0, k, 1) / 2, x / 2), np.nan), chi2, df)


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper tail of Fisher's F."""
    return _arrays(lambda x, m, n: np.where(x > 0, beta_parts(n / 2, m / 2, n / (n + m * np.maximum(x, 0))), 1.0), f, df1, df2)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return _arrays(lambda x, n: beta_parts(n / 2, 0.5, n / (n + x * x)), t, df)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Upper tail of the normal distribution."""
    return _arrays(normal_tails, z)


@F.pandas_udf(T.DoubleType())
def qnorm(p: pd.Series) -> pd.Series:
    """Quantile of the normal distribution: the value below which a share ``p`` lies."""
    return _arrays(lambda v: np.where(v < 0.5, -1.0, 1.0) * solved(normal_tails, np.minimum(v, 1 - v), 0.0, 1.5), p)


@F.pandas_udf(T.DoubleType())
def qt(p: pd.Series, df: pd.Series) -> pd.Series:
    """Quantile of Student's t."""
    return _arrays(lambda v, n: np.where(v < 0.5, -1.0, 1.0) * solved(lambda x: beta_parts(n / 2, 0.5, n / (n + x * x)) / 2, np.minimum(v, 1 - v), 0.0, 1.5), p, df)


@F.pandas_udf(T.DoubleType())
def qchisq(p: pd.Series, df: pd.Series) -> pd.Series:
    """Quantile of chi-square."""
    return _arrays(lambda v, k: solved(lambda x: gamma_tails(k / 2, x / 2), 1 - v, 0.0, 1.5), p, df)


@F.pandas_udf(T.DoubleType())
def qf(p: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Quantile of Fisher's F."""
    return _arrays(lambda v, m, n: solved(lambda x: beta_parts(n / 2, m / 2, n / (n + m * x)), 1 - v, 0.0, 1.5), p, df1, df2)


@F.pandas_udf(T.DoubleType())
def qbeta(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Quantile of the beta distribution."""
    return _arrays(lambda v, k, m: solved(lambda x: 1 - beta_parts(k, m, x), 1 - v, 0.0, 1.0), p, a, b)
