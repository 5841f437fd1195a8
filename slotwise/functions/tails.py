"""Tail probabilities in numpy (no scipy): normal, t, F, chi-square.

They run on result rows only (one per test), as vectorized pandas UDFs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300


def normal_cdf(z):
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2.0))


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def beta_reg(a, b, x):
    """Regularized incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    flip = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    safe = np.clip(xx, _TINY, 1.0 - 1e-16)
    front = np.exp(_lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb)
                   + aa * np.log(safe) + bb * np.log1p(-safe)) / aa
    val = np.where(xx <= 0.0, 0.0, front * _beta_fraction(aa, bb, safe))
    return np.where(flip, 1.0 - val, val)


def _gamma_upper(a, x):
    """Regularized upper incomplete gamma Q(a, x), scalar."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * front)
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-16:
            break
    return front * h


gamma_upper = np.vectorize(_gamma_upper, otypes=[float])


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_reg(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_reg(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_upper(x, df):
    return gamma_upper(np.asarray(df, float) / 2.0, np.asarray(x, float) / 2.0)


# MacKinnon (1994) response surface for the unit-root statistic with a constant.
ADF_TAU_STAR, ADF_TAU_MIN, ADF_TAU_MAX = -1.61, -18.83, 2.74
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
# KPSS (1992) level critical values and their probabilities.
KPSS_CRITICAL = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)


def adf_p(tau):
    tau = np.asarray(tau, float)
    poly = np.where(tau <= ADF_TAU_STAR,
                    np.polyval(ADF_SMALL_P[::-1], tau), np.polyval(ADF_LARGE_P[::-1], tau))
    return np.where(tau > ADF_TAU_MAX, 1.0, np.where(tau < ADF_TAU_MIN, 0.0, normal_cdf(poly)))


def kpss_p(eta):
    return np.interp(np.asarray(eta, float), KPSS_CRITICAL, KPSS_P)


def _masked(fn, *args):
    frame = pd.concat(args, axis=1).astype(float)
    ok = np.isfinite(frame).all(axis=1).to_numpy()
    out = np.full(len(frame), np.nan)
    if ok.any():
        out[ok] = fn(*(frame.iloc[ok, j].to_numpy() for j in range(frame.shape[1])))
    return pd.Series(out, dtype="float64").where(ok, None)


@pandas_udf(DoubleType())
def pearson_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation r over n pairs."""
    def fn(rv, nv):
        df = np.maximum(nv - 2.0, 0.0)
        rv = np.clip(rv, -1.0, 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(np.abs(rv) < 1.0, rv * np.sqrt(df / (1.0 - rv * rv)), np.inf)
        return np.where(df < 1, 1.0, np.where(np.isinf(t), 0.0, t_two_sided(np.where(np.isinf(t), 0, t), np.maximum(df, 1))))
    return _masked(fn, r, n)


@pandas_udf(DoubleType())
def f_upper_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _masked(f_upper, f, d1, d2)


@pandas_udf(DoubleType())
def chi2_upper_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(chi2_upper, x, df)


@pandas_udf(DoubleType())
def adf_p_udf(tau: pd.Series) -> pd.Series:
    return _masked(adf_p, tau)


@pandas_udf(DoubleType())
def kpss_p_udf(eta: pd.Series) -> pd.Series:
    return _masked(kpss_p, eta)


