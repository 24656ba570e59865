"""Tails of distributions that Spark has no function for, vectorised over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Lanczos approximation for x > 0."""
    z = np.asarray(x, float) - 1
    total = np.full_like(z, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total += c / (z + i)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(total)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    d = 1 / guard(1 - (a + b) * x / (a + 1))
    c, h = np.ones_like(x), d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / guard(1 + step * d)
            c = guard(1 + step / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def regularised_beta(a, b, x) -> np.ndarray:
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    direct = inside < (a + 1) / (a + b + 2)
    value = np.where(direct, front * _beta_fraction(a, b, np.where(direct, inside, 0.5)) / a, 1 - front * _beta_fraction(b, a, np.where(direct, 0.5, 1 - inside)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def t_two_sided(t, df) -> np.ndarray:
    """Two-sided tail of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return regularised_beta(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z) -> np.ndarray:
    return np.array([math.erfc(abs(v) / math.sqrt(2)) if v == v else math.nan for v in np.asarray(z, float)])


@F.pandas_udf(DoubleType())
def _t_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        out[ok] = t_two_sided(t[ok].to_numpy(float), df[ok].to_numpy(float))
    return out


@F.pandas_udf(DoubleType())
def _z_udf(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z.to_numpy(float)), index=z.index)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p; null where t or df is."""
    return F.nanvl(_t_udf(t, df), F.lit(None).cast("double"))


def z_p_value(z: Column) -> Column:
    return F.nanvl(_z_udf(z), F.lit(None).cast("double"))
