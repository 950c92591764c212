"""Rows that stand for many samples against the samples themselves."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexmat.operators import cca, community, condense, phenotype

MODALITY = np.repeat([0, 1], 4)


def data(n: int = 160) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 8)) + 3
    x[:, 4:] += 0.7 * x[:, :4]
    return x.round(3), (x[:, 0] + rng.normal(size=n) > 3).astype(float)


def tables(spark, x: np.ndarray, y: np.ndarray):
    rows = [(f"s{i:03d}", int(j), f"f{j}", f"m{MODALITY[j]}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "sample_id string, fpos int, feature string, modality string, value double").repartition(5), spark.createDataFrame([(f"s{i:03d}", float(v)) for i, v in enumerate(y)], "sample_id string, y double")


def found(df) -> dict:
    keys = [c for c, t in df.dtypes if t != "double"]
    return {tuple(r[k] for k in keys): [r[c] for c in df.columns if c not in keys] for r in df.collect()}


def as_they_are(monkeypatch) -> None:
    monkeypatch.setattr(condense, "condensed", lambda *given: None)


def equal(one: dict, two: dict) -> None:
    assert one.keys() == two.keys() and one
    for k, v in one.items():
        assert v == pytest.approx(two[k], abs=1e-7), k


def test_products_first_rows_and_signs():
    x, y = data()
    x[:, 5] = 2.0
    z = np.column_stack([x, y])
    s = condense.stand_in(condense.merged(condense._own(z[:50]), condense._own(z[50:])), z[:9])
    c = z - z.mean(0)
    assert len(s) < 40 and np.allclose(s.T @ s, c.T @ c) and np.allclose(s.sum(0), 0) and np.allclose(s[:9], c[:9])
    for own in ([0, 1, 2, 3], [1, 3, 4, 6, 7]):
        first, same = (np.linalg.svd(cca.scaled(m[:, own]), full_matrices=False)[2][0] for m in (z, s))
        assert np.allclose(first, same)


def test_many_equal_samples_at_the_top():
    z = np.vstack([np.full((60, 3), 9.0) + np.eye(60, 3), np.random.default_rng(0).normal(size=(90, 3))])
    s = condense.stand_in(condense._own(z), z[:20])
    c = z - z.mean(0)
    assert np.allclose(s.T @ s, c.T @ c) and np.allclose(s.sum(0), 0)


def test_samples_that_cannot_be_condensed(spark):
    long, target = tables(spark, *data())
    assert condense.condensed(long, target).n == 160
    assert condense.condensed(long.where("sample_id <> 's000' or fpos > 0"), target) is None
    assert condense.condensed(long.unionByName(long.where("sample_id = 's001' and fpos = 2")), target) is None
    assert condense.condensed(long.where("sample_id < 's030'"), target) is None


@pytest.fixture(scope="module")
def calls(spark):
    x, y = data()
    long, target = tables(spark, x, y)
    score = spark.createDataFrame([(f"s{i:03d}", float(v)) for i, v in enumerate(x[:, 2] + y)], "sample_id string, y double")
    sets = spark.createDataFrame([(j // 3, f"f{j}") for j in range(8)], "set_id long, feature string")
    edges = spark.createDataFrame([(f"f{i}", f"f{j}", 1.0 + (i + j) % 3) for i in range(8) for j in range(i + 1, 8) if (i + j) % 3], "src string, dst string, weight double")
    return {
        "weights": lambda: cca.robust_weights(long, score, [0.6, 0.6], subsamples=4),
        "weights_binary": lambda: cca.robust_weights(long, target, [0.8, 0.8], subsamples=4, binary=True),
        "discriminant": lambda: cca.discriminant_weights(long.drop("modality"), target, subsamples=4),
        "tuning": lambda: cca.tune(long, score, [[0.5, 0.5], [0.8, 0.8]], k=3).drop("penalties"),
        "sets": lambda: phenotype.set_correlations(long, score, sets),
        "sets_centred": lambda: phenotype.set_correlations(long, score, sets, standardize=False),
        "louvain": lambda: community.correlated_louvain(edges, long, score, [0.2, 0.8]),
        "pagerank": lambda: community.correlated_pagerank(edges, long, score, ["f0", "f1"]),
        "hybrid": lambda: community.hybrid(edges, long, score),
    }


@pytest.mark.parametrize("name", ["weights", "weights_binary", "discriminant", "tuning", "sets", "sets_centred", "louvain", "pagerank", "hybrid"])
def test_same_results_and_no_task_has_the_samples(spark, monkeypatch, calls, name):
    with monkeypatch.context() as m:
        as_they_are(m)
        want = found(calls[name]())
    seen = []
    real = condense.Condensed.long
    monkeypatch.setattr(condense.Condensed, "long", lambda self, matrix, **more: seen.append(len(matrix)) or real(self, matrix, **more))
    equal(found(calls[name]()), want)
    assert seen and max(seen) < 40  # of 160 samples


def test_samples_that_lack_cells_are_condensed_where_these_are_zeros(spark, monkeypatch):
    x, y = data()
    long, _ = tables(spark, x, y)
    long = long.where("sample_id not in ('s000', 's007') or fpos not in (1, 6)").withColumn("value", F.when(F.expr("sample_id <> 's003' or fpos <> 2"), F.col("value")))
    long = long.unionByName(long.where("sample_id = 's001' and fpos = 2"))
    score = spark.createDataFrame([(f"s{i:03d}", float(v)) for i, v in enumerate(x[:, 2] + y)], "sample_id string, y double")
    sets = spark.createDataFrame([(j // 3, f"f{j}") for j in range(8)], "set_id long, feature string")
    edges = spark.createDataFrame([(f"f{i}", f"f{j}", 1.0 + (i + j) % 3) for i in range(8) for j in range(i + 1, 8) if (i + j) % 3], "src string, dst string, weight double")
    calls = [lambda: phenotype.set_correlations(long, score, sets), lambda: community.correlated_louvain(edges, long, score, [0.2, 0.8]), lambda: community.correlated_pagerank(edges, long, score, ["f0", "f1"]), lambda: community.hybrid(edges, long, score)]
    with monkeypatch.context() as m:
        as_they_are(m)
        want = [found(c()) for c in calls]
    seen = []
    real = condense.Condensed.long
    monkeypatch.setattr(condense.Condensed, "long", lambda self, matrix, **more: seen.append(len(matrix)) or real(self, matrix, **more))
    for c, w in zip(calls, want, strict=True):
        equal(found(c()), w)
    assert len(seen) == 4 and max(seen) < 40
    # a sample without any cell of a set has no row in it, so that zeros can't stand for its cells
    cut = long.where("sample_id <> 's009' or fpos > 2")
    sizes = {r["set_id"]: r["p"] for r in phenotype.set_correlations(cut, score, sets).collect()}
    with monkeypatch.context() as m:
        as_they_are(m)
        assert sizes == pytest.approx({r["set_id"]: r["p"] for r in phenotype.set_correlations(cut, score, sets).collect()}, abs=1e-7)


def test_threshold_at_a_magnitude():
    for second in (0.5, 0.9995, 1 - 1e-7):
        v = np.array([1.0, second, -0.3 * second, 0.1])
        for scale in (1.0, 1 / 3, 7e5):
            d = cca.threshold_for(v * scale, 1.0)
            assert (cca.soft(v * scale, d) != 0).sum() == 1
