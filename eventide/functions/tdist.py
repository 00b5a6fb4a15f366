"""Two-sided p-values of Student's t, vectorised over already aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 200):
        for even in (True, False):
            num = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)) if even else -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
    lg = np.vectorize(math.lgamma)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(y) + q * np.log1p(-y)) / p
    out = np.where(y <= 0, 0.0, front * f)
    return np.where(flip, 1 - out, out)


def t_p_values(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    ok = np.isfinite(t) & (df > 0)
    x = np.where(ok, df, 1.0) / np.where(ok, df + np.where(ok, t, 0.0) ** 2, 1.0)
    return np.where(ok, incomplete_beta(np.where(ok, df, 2) / 2.0, 0.5, x), np.nan)


def _p(t: pd.Series, df: pd.Series) -> pd.Series:
    p = pd.Series(t_p_values(t.to_numpy(dtype=float, na_value=np.nan), df.to_numpy(dtype=float, na_value=np.nan)))
    return p.where(p.notna(), None)


def t_p(t: str | Column, df: str | Column) -> Column:
    """Two-sided p of a t statistic with df degrees of freedom; null for null or undefined ones."""
    return F.pandas_udf(_p, "double")(t, df)
