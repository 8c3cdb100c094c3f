"""Distribution values for summary rows, as Arrow-batched UDFs.

Only per-series summary rows reach these functions; everything row-level stays
in built-in expressions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


# Terms of the continued fraction; a value that needs more is not a number, never a cut-off one.
MAX_TERMS = 20_000


def _log_gamma(v: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(x) for x in v])


def beta_cdf(a, b, x) -> np.ndarray:
    """Regularised incomplete beta of arrays, by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.full(a.shape, np.nan)
    valid = (a > 0) & (b > 0) & (x == x)
    out[valid & (x <= 0)] = 0.0
    out[valid & (x >= 1)] = 1.0
    inside = valid & (x > 0) & (x < 1)
    if not inside.any():
        return out
    a, b, x = a[inside], b[inside], x[inside]
    flip = x > (a + 1.0) / (a + b + 2.0)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    shape = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
    front = np.exp(shape + a * np.log(x) + b * np.log1p(-x)) / a
    # Evaluated forwards (modified Lentz); all values go on until the slowest has settled.
    tiny = 1e-300
    guard = lambda v: np.where(v == 0, tiny, v)
    c, d = np.ones_like(a), 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    h, settled = d.copy(), np.zeros(len(a), dtype=bool)
    for m in range(1, MAX_TERMS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for num in (even, odd):
            d = 1.0 / guard(1.0 + num * d)
            c = guard(1.0 + num / c)
            h = h * c * d
        settled |= np.abs(c * d - 1.0) < 1e-15
        if settled.all():
            break
    part = np.where(settled, front * h, np.nan)
    out[inside] = np.where(flip, 1.0 - part, part)
    return out


def beta_quantile(a, b, q) -> np.ndarray:
    """Points below which a Beta variable lies with chance ``q``, by bisection."""
    a, b, q = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, q)))
    low, high = np.zeros(a.shape), np.ones(a.shape)
    for _ in range(60):
        mid = (low + high) / 2
        below = beta_cdf(a, b, mid) < q
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def _t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(beta_cdf(dof / 2.0, 0.5, dof / (dof + t * t)), dtype="float64")


@F.pandas_udf(T.DoubleType())
def _normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(abs(v) / math.sqrt(2)) for v in z], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _beta_quantile(a: pd.Series, b: pd.Series, q: pd.Series) -> pd.Series:
    return pd.Series(beta_quantile(a, b, q), dtype="float64")


@F.pandas_udf(T.DoubleType())
def _f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(beta_cdf(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)), dtype="float64")


def t_two_sided(t: str | Column, dof: Column) -> Column:
    """Two-sided p-value of a t statistic."""
    return _t_two_sided(F.col(t) if isinstance(t, str) else t, dof.cast("double"))


def normal_two_sided(z: Column) -> Column:
    return _normal_two_sided(z)


def beta_interval(wins: Column, losses: Column, low: float = 0.025, high: float = 0.975):
    """Posterior interval of a rate under a Beta(1, 1) prior."""
    a, b = (wins + 1).cast("double"), (losses + 1).cast("double")
    return _beta_quantile(a, b, F.lit(low)), _beta_quantile(a, b, F.lit(high))


def f_upper(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of the F distribution."""
    return _f_upper(f, d1.cast("double"), d2.cast("double"))
