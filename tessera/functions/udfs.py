"""The few Arrow-batched Python helpers: per-row logic that
has no built-in expression — inverse normal CDF and Student-t tail probability.  Each is a small
function applied by Spark to Arrow batches; Spark partitions the work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _norm_ppf(p: np.ndarray) -> np.ndarray:
    """Inverse standard normal CDF (rational approximation, |err| < 1.2e-9)."""
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]
    p = np.clip(np.asarray(p, dtype=float), 1e-12, 1 - 1e-12)
    x = np.empty_like(p)
    lo, hi = p < 0.02425, p > 1 - 0.02425
    mid = ~(lo | hi)
    q = np.sqrt(-2 * np.log(p[lo]))
    x[lo] = (((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / \
        ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    q = np.sqrt(-2 * np.log(1 - p[hi]))
    x[hi] = -(((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / \
        ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    q = p[mid] - 0.5
    r = q * q
    x[mid] = (((((a[0] * r + a[1]) * r + a[2]) * r + a[3]) * r + a[4]) * r + a[5]) * q / \
        (((((b[0] * r + b[1]) * r + b[2]) * r + b[3]) * r + b[4]) * r + 1)
    return x


@F.pandas_udf(DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    return pd.Series(_norm_ppf(p.to_numpy()))


def _betacf(a, b, x, iters=200):
    """Continued fraction of the regularized incomplete beta (Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        de = d * c
        h *= de
        if np.all(np.abs(de - 1.0) < 1e-15):
            break
    return h


def _lgamma(x):
    from math import lgamma
    return np.vectorize(lgamma)(x)


def t_two_sided_p(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t: I_{ν/(ν+t²)}(ν/2, 1/2)."""
    t, v = np.abs(np.asarray(t, float)), np.asarray(dof, float)
    x = np.clip(v / (v + t * t), 1e-300, 1.0)
    a, b = v / 2.0, np.full_like(v, 0.5)
    lbeta = _lgamma(a + b) - _lgamma(a) - _lgamma(b)
    with np.errstate(divide="ignore", invalid="ignore"):
        return _t_tail(x, a, b, lbeta)


def _t_tail(x, a, b, lbeta):
    front = np.exp(lbeta + a * np.log(x) + b * np.log1p(-x))
    use_direct = x < (a + 1.0) / (a + b + 2.0)
    direct = front * _betacf(a, b, x) / a
    sym = 1.0 - np.exp(lbeta + b * np.log1p(-x) + a * np.log(x)) * _betacf(b, a, 1.0 - x) / b
    return np.clip(np.where(use_direct, direct, sym), 0.0, 1.0)


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided_p(t.to_numpy(), dof.to_numpy()))
