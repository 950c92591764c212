"""Binomial regression by Newton steps, each one aggregate over the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexmat.plans.iterate import written


def binomial(rows: DataFrame, terms: list[str], y: str = "y", steps: int = 50, ridge: float = 1e-8, intercept: bool = False, tol: float = 1e-10) -> DataFrame:
    """(term, coefficient, error) of a logistic regression of y (0 or 1) on the columns of terms.

    Gradient and second derivatives are sums over rows, a column each, taken in one pass a step with map-side partial
    sums; the driver solves a system of as many equations as terms. ridge keeps it solvable where classes are separated or terms
    depend on one another. Rows with a null in y or a term are left out; without rows all coefficients are 0.
    """
    used = rows.select(F.col(y).cast("double").alias("_y"), *[F.col(t).cast("double").alias(f"_x{i}") for i, t in enumerate(terms)]).na.drop()
    used = written(used, "glm-rows")
    names = (["(intercept)"] if intercept else []) + terms
    x: list[Column] = ([F.lit(1.0)] if intercept else []) + [F.col(f"_x{i}") for i in range(len(terms))]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    w, inverse = np.zeros(len(x)), np.zeros((len(x), len(x)))
    for _ in range(steps):
        eta = sum((float(c) * v for c, v in zip(w, x, strict=True)), F.lit(0.0))
        at = used.withColumn("_p", 1 / (1 + F.exp(-F.least(F.greatest(eta, F.lit(-30.0)), F.lit(30.0)))))
        v = F.col("_p") * (1 - F.col("_p")) + 1e-12
        sums = at.agg(*[F.sum(a * (F.col("_y") - F.col("_p"))).alias(f"g{i}") for i, a in enumerate(x)], *[F.sum(x[i] * x[j] * v).alias(f"h{i}_{j}") for i, j in pairs]).head()
        if sums["g0"] is None:
            break
        h = np.zeros_like(inverse)
        for i, j in pairs:
            h[i, j] = h[j, i] = sums[f"h{i}_{j}"]
        inverse = np.linalg.inv(h + ridge * np.eye(len(x)))
        step = inverse @ np.array([sums[f"g{i}"] for i in range(len(x))])
        w = w + step
        if np.abs(step).max(initial=0) < tol:
            break
    out = [(t, float(c), float(e)) for t, c, e in zip(names, w, np.sqrt(np.maximum(np.diag(inverse), 0)), strict=True)]
    return rows.sparkSession.createDataFrame(out, "term string, coefficient double, error double")
