"""Leading principal components of a long frame by a randomised range finder and tall-skinny QR.

Products with the matrix are joins and sums over its cells, a column for each of a few directions; a tall matrix of these is
made orthonormal from the R factors of its parts, which are merged in rounds. Neither a matrix of features by features nor a row or a column
of the matrix comes together in a task; the driver sees matrices of directions by directions alone. With as many
directions as the matrix has rank the result is exact; else `rounds` of power iteration bring the leading ones close.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexmat.plans.iterate import written

#: R factors that one task merges; rank up to which as many directions are taken, so that the result is exact.
MERGED, EXACT = 64, 128


def _signs(n: int, seed: int) -> Column:
    """n pseudorandom signs of a feature."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.xxhash64("fpos", i, F.lit(seed)) % 2 == 0, 1.0).otherwise(-1.0))


def _product(long: DataFrame, vectors: DataFrame, on: str, by: str, n: int) -> DataFrame:
    """Sums of value * v over the cells of each `by`: (by, v)."""
    sums = [F.sum(F.col("value") * F.col("v")[i]).alias(f"_{i}") for i in range(n)]
    return long.join(vectors, on).groupBy(by).agg(*sums).select(by, F.array(*[f"_{i}" for i in range(n)]).alias("v"))


def _r_factor(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _triangle(tall: DataFrame, n: int) -> np.ndarray:
    """The R factor of a tall matrix (v: rows of n numbers)."""
    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, n))
        for x in batches:
            r = _r_factor(np.concatenate([r, np.stack(x["v"].to_numpy())]))
        if len(r):
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "r": [r.ravel()]})

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, n))
        for x in p["r"]:
            r = _r_factor(np.concatenate([r, np.asarray(x).reshape(-1, n)]))
        return pd.DataFrame({"part": [int(p["part"].iloc[0]) // MERGED], "r": [r.ravel()]})

    schema = "part long, r array<double>"
    found = written(tall.select("v").mapInPandas(parts, schema), "r-factors")
    while found.count() > 1:
        found = written(found.groupBy(F.expr(f"part div {MERGED}")).applyInPandas(merge, schema), "r-factors")
    row = found.head()
    return np.asarray(row["r"]).reshape(-1, n) if row else np.zeros((0, n))


def _times(tall: DataFrame, key: str, m: np.ndarray, name: str) -> DataFrame:
    """Rows of a tall matrix times a small one."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({key: x[key], "v": list(np.stack(x["v"].to_numpy()) @ m)})

    kind = dict(tall.dtypes)[key]
    return written(tall.select(key, "v").mapInPandas(run, f"{key} {kind}, v array<double>"), name)


def _orthonormal(tall: DataFrame, key: str, n: int, name: str) -> tuple[DataFrame, int]:
    """An orthonormal basis of the columns of a tall matrix, and its rank."""
    _, s, vt = np.linalg.svd(_triangle(tall, n), full_matrices=False)
    rank = int((s > s.max(initial=0) * 1e-10).sum()) if len(s) and s.max(initial=0) > 0 else 0
    return _times(tall, key, vt[:rank].T / s[:rank], name), rank


class Components:
    """`values` (squared singular values), `total` (the sum of squares), `loads` (fpos, v) and `scores` (sample_id, v), a number for each component."""

    def __init__(self, long: DataFrame, most: int, oversample: int = 10, rounds: int = 4, seed: int = 1):
        cells = long.where("value is not null and value <> 0").select("sample_id", "fpos", "value")
        size = cells.agg(F.count_distinct("sample_id"), F.count_distinct("fpos"), F.sum(F.col("value") ** 2)).head()
        n, d, self.total = int(size[0]), int(size[1]), float(size[2] or 0.0)
        whole = min(n, d) <= EXACT
        wide = (min(n, d) if whole else min(most, n, d)) + oversample if min(n, d) else 0  # signs of as many directions as rank may depend on one another
        if not wide:
            self.values, self.loads, self.scores = np.zeros(0), None, None
            return
        start = written(cells.select("fpos").distinct().select("fpos", _signs(wide, seed).alias("v")), "signs")
        tall = written(_product(cells, start, "fpos", "sample_id", wide), "range")
        basis, rank = _orthonormal(tall, "sample_id", wide, "basis")
        for _ in range(rounds if wide < min(n, d) else 1):  # the basis of a matrix of that rank is found by one look back
            across, rank = _orthonormal(written(_product(cells, basis, "sample_id", "fpos", rank), "across"), "fpos", rank, "across-basis")
            basis, rank = _orthonormal(written(_product(cells, across, "fpos", "sample_id", rank), "range"), "sample_id", rank, "basis")
        basis, rank = _orthonormal(basis, "sample_id", rank, "basis")  # once more, for what the first division lost
        flat = written(_product(cells, basis, "sample_id", "fpos", rank), "flat")
        r = _triangle(flat, rank)
        _, s, vt = np.linalg.svd(r, full_matrices=False)
        kept = min(most, int((s > 0).sum()))
        s, vt = s[:kept], vt[:kept]
        self.values = s**2
        self.loads = _times(flat, "fpos", vt.T / s, "loads")
        self.scores = _times(basis, "sample_id", vt.T * s, "scores")
