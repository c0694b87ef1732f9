"""Student-t probabilities as Arrow-batched column functions.

Spark has no log-gamma or incomplete beta, so this is the one numeric helper in
Python.  With ``t = sqrt(df) * tan(u)`` the density becomes ``cos(u)**(df - 1)``,
which Gauss-Legendre nodes integrate to near machine precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NODES, _NODE_WEIGHTS = np.polynomial.legendre.leggauss(96)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, x), float, len(x))


def standard_cdf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    angle = np.arctan(np.abs(t) / np.sqrt(df))
    # Beyond 12 standard widths of the integrand nothing measurable is left.
    top = np.minimum(angle, np.where(df > 60, 12.0 / np.sqrt(df), np.pi / 2))
    u = 0.5 * top[:, None] * (_NODES + 1.0)
    with np.errstate(divide="ignore"):
        inside = np.exp((df[:, None] - 1.0) * np.log(np.cos(u)))
    area = 0.5 * top * (inside @ _NODE_WEIGHTS)
    log_scale = _log_gamma((df + 1.0) / 2.0) - _log_gamma(df / 2.0) - 0.5 * math.log(math.pi)
    half = np.minimum(0.5, np.exp(log_scale) * area)
    return np.where(t >= 0, 0.5 + half, 0.5 - half)


def standard_quantile(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Inverse of ``standard_cdf`` by bisection on the angle, once per distinct pair."""
    pairs, where = np.unique(np.column_stack([p, df]), axis=0, return_inverse=True)
    p1, df1 = pairs[:, 0], pairs[:, 1]
    low, high = np.full(len(p1), -np.pi / 2), np.full(len(p1), np.pi / 2)
    for _ in range(60):
        mid = 0.5 * (low + high)
        below = standard_cdf(np.sqrt(df1) * np.tan(mid), df1) < p1
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    t = np.sqrt(df1) * np.tan(0.5 * (low + high))
    t = np.where(p1 <= 0, -np.inf, np.where(p1 >= 1, np.inf, t))
    return t[where.ravel()]


def _batch(fn, a: pd.Series, df: pd.Series) -> pd.Series:
    out = np.full(len(a), np.nan)
    ok = (a.notna() & df.notna()).to_numpy()
    if ok.any():
        out[ok] = fn(a.to_numpy(float)[ok], df.to_numpy(float)[ok])
    return pd.Series(out).where(ok, None)


def t_cdf(x: Column, df: Column, loc: Column, scale: Column) -> Column:
    """P(X <= x) of a location-scale Student-t."""

    @F.pandas_udf("double")
    def run(t: pd.Series, nu: pd.Series) -> pd.Series:
        return _batch(standard_cdf, t, nu)

    return run((x - loc) / scale, df)


def t_quantile(p: Column, df: Column, loc: Column, scale: Column) -> Column:
    """Value at cumulative probability ``p`` of a location-scale Student-t."""

    @F.pandas_udf("double")
    def run(prob: pd.Series, nu: pd.Series) -> pd.Series:
        return _batch(standard_quantile, prob, nu)

    return loc + scale * run(p, df)
