"""A few rows in place of very many samples, for whatever depends on samples by products of centred columns alone.

Principal components, correlations and canonical weights of a matrix are those of any other matrix whose centred columns have the
same products. Spark adds these products up, a matrix of features by features for each part of the samples; the rows that
stand for the samples are made from them: the first samples as they are (so that a decomposition also gets the
signs that it would get from the whole matrix) and as many more as give the sums of all. Features are at most BLOCK.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexmat.plans.iterate import written

#: Features at most; samples for each of them at least (fewer are as small as what would stand for them); sums that one task merges.
BLOCK, LEAST, MERGED = 1024, 4, 64

#: Samples, means, and sums of products of centred columns.
Sums = tuple[int, np.ndarray, np.ndarray]


def merged(a: Sums | None, b: Sums | None) -> Sums | None:
    """The sums of two sets of samples together."""
    if a is None or b is None:
        return b if a is None else a
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * (b[0] / n))


def _own(x: np.ndarray) -> Sums:
    mean = x.mean(0)
    return len(x), mean, (x - mean).T @ (x - mean)


def stand_in(sums: Sums, top: np.ndarray) -> np.ndarray:
    """Centred rows with these sums of products, the first ones being the given samples."""
    n, mean, m2 = sums
    p, x, m2 = len(mean), top - mean, m2.copy()
    still = np.sqrt(np.diag(m2) / n) <= 1e-13 * np.abs(mean)  # columns of one value, but for rounding
    m2[still] = m2[:, still] = 0.0
    x[:, still] = 0.0
    t, rest, more = x.sum(0), m2 - x.T @ x, p + 1
    while True:  # the more rows, the less of their products is due to their mean
        value, vector = np.linalg.eigh(rest - np.outer(t, t) / more)
        if value.min() >= -1e-10 * max(value.max(), 0.0) or more >= n - len(x):
            break
        more *= 2
    across = np.linalg.qr(np.column_stack([np.ones(more), np.eye(more)[:, :p]]))[0][:, 1:]
    return np.concatenate([x, across @ (np.sqrt(np.maximum(value, 0))[:, None] * vector.T) - t / more])


@dataclass
class Condensed:
    """`rows` (sample_id, y, x: values in order of `features`), the samples' number, and the features' columns."""

    rows: DataFrame
    n: int
    features: pd.DataFrame

    def sums(self, by: str | None = None) -> dict[int, Sums]:
        """Sums of the features and y (the last), for each value of an integer column of rows."""
        schema, names = "part long, g int, n long, mean binary, m2 binary", [by] if by else []

        def row(part: int, g: int, s: Sums) -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "g": [g], "n": [s[0]], "mean": [s[1].tobytes()], "m2": [s[2].tobytes()]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: dict[int, Sums | None] = {}
            for b in batches:
                x, own = with_y(b), b[by].to_numpy() if by else np.zeros(len(b), int)
                for g in np.unique(own).tolist():
                    found[g] = merged(found.get(g), _own(x[own == g]))
            for g, s in found.items():
                yield row(TaskContext.get().partitionId(), g, s)

        def merge(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
            total = None
            for s in map(_read, p.itertuples()):
                total = merged(total, s)
            return row(int(key[1]), int(key[0]), total)

        got = written(self.rows.select("x", "y", *names).mapInPandas(add, schema), "sums")
        while (got.groupBy("g").count().agg(F.max("count")).head()[0] or 0) > 1:
            got = written(got.groupBy("g", F.expr(f"part div {MERGED}")).applyInPandas(merge, schema), "sums")
        return {r["g"]: _read(r) for r in got.orderBy("g").toLocalIterator()}

    def first(self, rows: DataFrame | None = None) -> np.ndarray:
        """The first samples by id, as many as features and y together."""
        few = (self.rows if rows is None else rows).select("sample_id", "x", "y").orderBy("sample_id").limit(len(self.features) + 1).collect()
        return np.array([[*r["x"], r["y"]] for r in few])

    def long(self, matrix: np.ndarray, **more) -> pd.DataFrame:
        """Rows of stand_in as cells with y."""
        m, p = matrix.shape[0], len(self.features)
        cells = pd.concat([self.features] * m, ignore_index=True)
        return cells.assign(sample_id=np.repeat([f"{i:07d}" for i in range(m)], p), value=matrix[:, :p].ravel(), y=np.repeat(matrix[:, p], p), **more)


def _read(r) -> Sums:
    mean = np.frombuffer(r.mean)
    return int(r.n), mean, np.frombuffer(r.m2).reshape(len(mean), len(mean))


def with_y(b: pd.DataFrame) -> np.ndarray:
    """Rows as a matrix of features and y."""
    return np.column_stack([np.stack(b["x"].to_numpy()), b["y"].to_numpy(float)])


def condensed(long: DataFrame, target: DataFrame, empty: bool = False, fill: bool = False) -> Condensed | None:
    """The samples with a y as rows; None where rows can't stand for them: more than BLOCK features, samples that lack cells or
    have some twice, or fewer samples than LEAST for each feature. Null cells are 0; features and samples without any value are left out, unless `empty`.
    `fill`: cells that a sample lacks are 0 too, and of cells that it has twice one counts."""
    columns = [c for c in long.columns if c not in ("sample_id", "value", "y")]
    features = long.groupBy(*columns).agg(F.count("value").alias("_n")).limit(BLOCK + 1).toPandas()
    if not 0 < len(features) <= BLOCK or features["fpos"].duplicated().any():
        return None
    if not empty and (features["_n"] == 0).any():
        features = features[features["_n"] > 0]
        long = long.where(F.col("fpos").isin([int(f) for f in features["fpos"]]))
    features = features.drop(columns="_n").sort_values("fpos", ignore_index=True)
    whole = F.transform("_c", lambda c: c["fpos"].cast("int")) == F.array(*[F.lit(int(f)) for f in features["fpos"]])
    y = target.where("y is not null").groupBy("sample_id").agg(F.first("y").cast("double").alias("y"))
    rows = long.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("fpos", "value"))).alias("_c"))
    if not empty:
        rows = rows.where(F.exists("_c", lambda c: c["value"].isNotNull()))
    x = F.transform("_c", lambda c: F.coalesce(c["value"], F.lit(0.0)))
    if fill:
        given = F.filter("_c", lambda c: c["value"].isNotNull())
        places = F.transform(given, lambda c: c["fpos"].cast("int"))
        once = F.map_from_entries(F.filter(F.transform(given, lambda c, i: F.when(F.array_position(places, c["fpos"].cast("int")) == i + 1, F.struct(c["fpos"].cast("int"), c["value"]))), lambda c: c.isNotNull()))
        x = F.when(whole, x).otherwise(F.transform(F.array(*[F.lit(int(f)) for f in features["fpos"]]), lambda f: F.coalesce(once[f], F.lit(0.0))))
        whole = F.lit(True)
    rows = rows.join(y, "sample_id").select("sample_id", "y", x.alias("x"), whole.alias("whole"))
    rows = written(rows, "rows")
    size = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("whole")).alias("cut")).head()
    if size["cut"] or size["n"] < LEAST * (len(features) + 1):
        return None
    return Condensed(rows.drop("whole"), int(size["n"]), features)


def few(long: DataFrame, target: DataFrame, empty: bool = False, fill: bool = False) -> tuple[DataFrame, DataFrame, int | None]:
    """Matrix and phenotype, few rows standing for the samples, and how many these were; as they are (and None) where rows can't."""
    c = condensed(long, target, empty, fill)
    if c is None:
        return long, target, None
    cells = c.long(stand_in(c.sums()[0], c.first()))
    spark = long.sparkSession
    kinds = dict(long.dtypes)
    names = [k for k in long.columns if k != "y"]
    small = spark.createDataFrame(cells[names], ", ".join(f"{k} {kinds[k]}" for k in names))
    return small, spark.createDataFrame(cells.drop_duplicates("sample_id")[["sample_id", "y"]], "sample_id string, y double"), c.n


def logistic(c: Condensed, mean: np.ndarray, sd: np.ndarray, designs: np.ndarray, steps: int = 50, ridge: float = 1e-8) -> list[np.ndarray | None]:
    """`special.irls` of y by the scores of all samples, for many designs (features by scores) at once: a pass for each step.

    Designs are runs by features by scores; a column of zeros is no score. None for a design without a solution.
    """
    runs, p, k = designs.shape
    flat, w, open_ = designs.transpose(1, 0, 2).reshape(p, runs * k), np.zeros((runs, k)), np.ones(runs, bool)
    failed = np.zeros(runs, bool)
    for _ in range(steps):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        for i, (g, h) in zip(at, _newton(c.rows, mean, sd, flat.reshape(p, runs, k)[:, at], w[at]), strict=True):
            try:
                step = np.linalg.solve(h + ridge * np.eye(k), g)
            except np.linalg.LinAlgError:
                failed[i], open_[i] = True, False
                continue
            w[i] += step
            open_[i] = not np.abs(step).max(initial=0) < 1e-10
    return [None if f else v for f, v in zip(failed, w, strict=True)]


def _newton(rows: DataFrame, mean: np.ndarray, sd: np.ndarray, designs: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Gradient and curvature of every run, added up over the samples."""
    p, runs, k = designs.shape
    flat, part = designs.reshape(p, runs * k), max(1, (1 << 21) // (runs * k))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, h = np.zeros((runs, k)), np.zeros((runs, k, k))
        for b in batches:
            for i in range(0, len(b), part):
                x, y = np.stack(b["x"].to_numpy()[i : i + part]), b["y"].to_numpy(float)[i : i + part, None]
                s = (((x - mean) / sd) @ flat).reshape(len(x), runs, k)
                q = 1 / (1 + np.exp(-np.clip(np.einsum("brc,rc->br", s, w), -30, 30)))
                g += np.einsum("brc,br->rc", s, y - q)
                h += np.matmul((s * (q * (1 - q) + 1e-12)[:, :, None]).transpose(1, 2, 0), s.transpose(1, 0, 2))
        yield pd.DataFrame({"g": [g.tobytes()], "h": [h.tobytes()]})

    g, h = np.zeros(runs * k), np.zeros(runs * k * k)
    for r in rows.select("x", "y").mapInPandas(add, "g binary, h binary").toLocalIterator():
        g, h = g + np.frombuffer(r["g"]), h + np.frombuffer(r["h"])
    return zip(g.reshape(runs, k), h.reshape(runs, k, k), strict=True)


def fold_pairs(c: Condensed, folds: DataFrame, k: int) -> pd.DataFrame | None:
    """Cells (of, side) of the rows that stand for the samples outside (train) and inside (test) of each fold; None where either has too few."""
    own = Condensed(written(c.rows.join(folds, "sample_id"), "rows-of-folds"), c.n, c.features)
    sums, out = own.sums("fold"), []
    for f in range(k):
        train = None
        for g, s in sums.items():
            train = merged(train, s if g != f else None)
        if f not in sums or train is None or train[0] < LEAST * (len(c.features) + 1) or sums[f][0] < 2:
            return None
        top = own.first(own.rows.where(F.col("fold") != f))
        out += [c.long(stand_in(train, top), of=f, side=0), c.long(stand_in(sums[f], np.zeros((0, len(c.features) + 1))), of=f, side=1)]
    return pd.concat(out, ignore_index=True)
