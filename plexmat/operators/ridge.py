"""Ridge classifiers of many subsets of the features at once, judged by stratified folds, in three passes over the samples.

A classifier depends on its training samples by weighted sums of products alone. They are added up once for each fold, whatever the
number of subsets: those of a subset are a part of them. No task holds more of the samples than a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexmat.operators.condense import BLOCK, MERGED
from plexmat.plans.iterate import placed, written

#: Numbers of a task's arrays; classes at most.
CELLS, CLASSES = 1 << 21, 256


def _classes(rows: DataFrame) -> DataFrame | None:
    """(y, label) of all classes, those without a y last; None for more than CLASSES."""
    found = sorted((r["y"] for r in rows.select("y").distinct().limit(CLASSES + 1).collect()), key=lambda v: (v is None, v or 0.0))
    return None if len(found) > CLASSES else rows.sparkSession.createDataFrame(list(zip(found, range(len(found)), strict=True)), "y double, label int")


def macro_f1(data: DataFrame, names: list[str], runs: list[tuple[int, list[str]]], folds: int = 5, ridge: float = 1.0) -> DataFrame | None:
    """(config, f1) for runs of some of the features, as `learn.proxy_score` gives for their standardised columns; data and names come
    from `iterate.packed`. None for more than BLOCK features or CLASSES classes."""
    y = F.nanvl(F.col("y").cast("double"), F.lit(None).cast("double"))
    if not 0 < len(names) <= BLOCK:
        return None
    # ranges of the samples in their order are the buckets that their places in a class are counted by
    spread = written(data.withColumn("y", y).repartitionByRange("sample_id").withColumn("_range", F.spark_partition_id()), "ridge-samples")
    classes = _classes(spread)
    if classes is None:
        return None
    where = spread.withColumnRenamed("y", "_y").join(F.broadcast(classes), F.col("_y").eqNullSafe(F.col("y")))
    rows = placed(where.select("sample_id", "label", "_range", "at", "v"), ["label"], F.col("_range"), ["sample_id"])
    rows = written(rows.select("label", (F.col("_place") % folds).cast("int").alias("fold"), "at", "v"), "ridge-rows")
    counts = np.zeros((folds, classes.count()))
    for r in rows.groupBy("fold", "label").count().collect():
        counts[r["fold"], r["label"]] = r["count"]
    n, p, k = counts.sum(), len(names), counts.shape[1]
    if not n:
        return None
    mean, sd = _moments(rows, p)
    train = np.array([np.delete(counts, f, 0).sum(0) for f in range(folds)])
    weight = n / np.maximum(train, 1)
    sums = _products(rows, mean, sd, weight, k)
    out = None
    step = max(1, 2 * CELLS // (folds * (p + 1) * k))
    for i in range(0, len(runs), step):
        models = _models(sums, runs[i : i + step], names, weight, ridge)
        got = _judged(rows, mean, sd, [r for r, _ in runs[i : i + step]], models, counts.sum(0))
        out = got if out is None else out.unionByName(got)
    return out


def _matrix(b: pd.DataFrame, p: int) -> Iterator[tuple[slice, np.ndarray]]:
    """A batch of rows as matrices of at most CELLS numbers, missing cells 0."""
    size = max(1, CELLS // (p + 1))
    for i in range(0, len(b), size):
        own = b.iloc[i : i + size]
        x = np.zeros((len(own), p))
        for j, (at, v) in enumerate(zip(own["at"], own["v"], strict=True)):
            x[j, at] = v
        yield slice(i, i + len(own)), x


def _scaled(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Standardised columns and a column of ones; columns of one value are 0."""
    return np.column_stack([np.where(sd > 0, (x - mean) / np.where(sd > 0, sd, 1), 0.0), np.ones(len(x))])


def _merged(a: tuple, b: tuple) -> tuple:
    d, n = b[1] - a[1], a[0] + b[0]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + d * d * (a[0] * b[0] / n)


def _moments(rows: DataFrame, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of every feature; the deviation of a column of one value is 0."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for _, x in _matrix(b, p):
                own = len(x), x.mean(0), ((x - x.mean(0)) ** 2).sum(0)
                total = own if total is None else _merged(total, own)
        if total:
            yield pd.DataFrame({"n": [total[0]], "mean": [total[1].tobytes()], "m2": [total[2].tobytes()]})

    total = None
    for r in rows.select("at", "v").mapInPandas(add, "n long, mean binary, m2 binary").toLocalIterator():
        own = r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["m2"])
        total = own if total is None else _merged(total, own)
    sd = np.sqrt(total[2] / total[0])
    return total[1], np.where(sd <= 1e-13 * np.abs(total[1]), 0.0, sd)


def _products(rows: DataFrame, mean: np.ndarray, sd: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fold: the weighted products of the samples outside, and their columns' weighted sums in each class."""
    folds, p = len(weight), len(mean)
    schema = "part long, fold int, gram binary, sums binary"

    def row(part: int, f: int, gram: np.ndarray, sums: np.ndarray) -> dict:
        return {"part": part, "fold": f, "gram": gram.tobytes(), "sums": sums.tobytes()}

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, sums = np.zeros((folds, p + 1, p + 1)), np.zeros((folds, p + 1, k))
        for b in batches:
            for at, x in _matrix(b, p):
                z, fold, label = _scaled(x, mean, sd), b["fold"].to_numpy()[at], b["label"].to_numpy()[at]
                for f in range(folds):
                    own = fold != f
                    w = weight[f, label[own]]
                    half = z[own] * np.sqrt(w)[:, None]
                    gram[f] += half.T @ half
                    sums[f] += z[own].T @ ((label[own][:, None] == np.arange(k)) * w[:, None])
        part = TaskContext.get().partitionId()
        for f in range(folds):
            yield pd.DataFrame([row(part, f, gram[f], sums[f])])

    def merge(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        gram, sums = sum(map(np.frombuffer, d["gram"])), sum(map(np.frombuffer, d["sums"]))
        return pd.DataFrame([row(int(key[1]), int(key[0]), gram, sums)])

    got = written(rows.mapInPandas(add, schema), "ridge-products")
    while (got.groupBy("fold").count().agg(F.max("count")).head()[0] or 0) > 1:
        got = written(got.groupBy("fold", F.expr(f"part div {MERGED}")).applyInPandas(merge, schema), "ridge-products")
    found = {r["fold"]: r for r in got.toLocalIterator()}
    return np.stack([np.frombuffer(found[f]["gram"]).reshape(p + 1, p + 1) for f in range(folds)]), np.stack([np.frombuffer(found[f]["sums"]).reshape(p + 1, k) for f in range(folds)])


def _models(sums: tuple[np.ndarray, np.ndarray], runs: list[tuple[int, list[str]]], names: list[str], weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights (run, fold, feature, class); features that a run lacks have none, and one without a solution has NaN."""
    place = {c: i for i, c in enumerate(names)}
    gram, by = sums
    k = by.shape[2]
    out = np.zeros((len(runs), len(weight), len(names) + 1, k))
    for i, (_, own) in enumerate(runs):
        at = np.array(sorted(place[c] for c in own if c in place) + [len(names)])
        for f in range(len(weight)):
            t = 2 * by[f] - by[f].sum(1, keepdims=True)
            try:
                out[i, f, at] = np.linalg.solve(gram[f][np.ix_(at, at)] + ridge * np.eye(len(at)), t[at])
            except np.linalg.LinAlgError:
                out[i] = np.nan
    return out


def _judged(rows: DataFrame, mean: np.ndarray, sd: np.ndarray, configs: list[int], models: np.ndarray, size: np.ndarray) -> DataFrame:
    """(config, f1) of the samples of every fold by the model of the others."""
    runs, folds, _, k = models.shape
    flat = models.transpose(1, 2, 0, 3).reshape(folds, len(mean) + 1, runs * k)
    few, number = max(1, CELLS // (runs * k)), np.array(configs)
    failed = np.isnan(models).any((1, 2, 3))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hit, said = np.zeros((runs, k), int), np.zeros((runs, k), int)
        for b in batches:
            for at, x in _matrix(b, len(mean)):
                z, fold, label = _scaled(x, mean, sd), b["fold"].to_numpy()[at], b["label"].to_numpy()[at]
                for f in np.unique(fold):
                    mine = np.flatnonzero(fold == f)
                    for j in range(0, len(mine), few):
                        own = mine[j : j + few]
                        guess = (z[own] @ flat[f]).reshape(len(own), runs, k).argmax(2)
                        for r in range(runs):
                            said[r] += np.bincount(guess[:, r], minlength=k)
                            hit[r] += np.bincount(guess[guess[:, r] == label[own], r], minlength=k)
        r, c = np.indices((runs, k))
        yield pd.DataFrame({"config": number[r.ravel()], "label": c.ravel(), "hit": hit.ravel(), "said": said.ravel(), "failed": failed[r.ravel()]})

    got = rows.mapInPandas(add, "config int, label int, hit long, said long, failed boolean").groupBy("config", "label", "failed").agg(F.sum("hit").alias("hit"), F.sum("said").alias("said"))
    truth = F.element_at(F.array(*[F.lit(int(v)) for v in size]), F.col("label") + 1)
    each = got.withColumn("_f1", 2 * F.col("hit") / F.greatest(F.lit(1), F.col("said") + truth))
    return each.groupBy("config").agg(F.when(~F.any_value("failed"), F.avg("_f1")).alias("f1"))
