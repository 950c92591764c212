"""Tail probabilities and small numerical kernels that Spark lacks, in NumPy; the probabilities also as Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def pearson_tail(r: float, n: float) -> float:
    """Two-sided p-value of a correlation of n pairs."""
    if n < 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return betainc((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else f_tail(x, a, b) for x, a, b in zip(f, d1, d2, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def pearson_pvalue(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else pearson_tail(x, m) for x, m in zip(r, n, strict=True)], dtype=float)




def first_component(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Scores of the first principal component of a centred matrix, and its share of variance."""
    x = x - x.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    total = float((s**2).sum())
    return (u[:, 0] * s[0], float(s[0] ** 2) / total if total else 0.0) if len(s) else (np.zeros(len(x)), 0.0)


def zscore(x: np.ndarray, ddof: int = 0) -> np.ndarray:
    s = x.std(0, ddof=ddof)
    return (x - x.mean(0)) / np.where(s > 0, s, 1.0)


def pearson(x: np.ndarray, y: np.ndarray) -> float:
    """Correlation of two vectors, 0 where either is constant."""
    a, b = x - x.mean(), y - y.mean()
    d = math.sqrt(float((a @ a) * (b @ b)))
    return float(a @ b) / d if d > 1e-12 else 0.0


def irls(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-8) -> np.ndarray:
    """Binomial regression without an intercept, by reweighted least squares."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-12)[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p))
        w = w + step
        if np.abs(step).max(initial=0) < 1e-10:
            break
    return w
