"""The classifiers of many subsets by sums against one classifier at a time, and none of them by all samples in one task."""

from __future__ import annotations

import numpy as np
import pytest

from plexmat.functions import special
from plexmat.operators import learn, ridge, search
from plexmat.plans.iterate import packed


def given(spark, n=203, p=7, classes=3, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + 3
    y = rng.integers(0, classes, n).astype(float)
    x[:, 0] += y
    x[:, 4] = 2.5
    x[rng.random((n, p)) < 0.05] = np.nan
    y[7] = np.nan
    ids = [str(i) for i in range(n)]
    order = sorted(range(n), key=lambda i: ids[i])
    long = spark.createDataFrame([(ids[i], j, f"f{j}", None if np.isnan(v) else float(v)) for i in range(n) for j, v in enumerate(x[i])], "sample_id string, fpos int, feature string, value double")
    target = spark.createDataFrame([(s, None if np.isnan(v) else float(v)) for s, v in zip(ids, y, strict=True)], "sample_id string, y double")
    return long, target, np.nan_to_num(x)[order], y[order]


def test_scores_are_those_of_single_classifiers(spark, monkeypatch):
    long, target, x, y = given(spark)
    monkeypatch.setattr(ridge, "CELLS", 512)
    monkeypatch.setattr(ridge, "MERGED", 4)
    runs = [(3, ["f0", "f1", "f4"]), (5, ["f2"]), (9, [f"f{j}" for j in range(7)])]
    data, names = packed(long.repartition(5), target)
    got = {r["config"]: r["f1"] for r in ridge.macro_f1(data, names, runs).collect()}
    assert set(got) == {3, 5, 9}
    for config, own in runs:
        assert got[config] == pytest.approx(learn.proxy_score(special.zscore(x[:, [int(f[1:]) for f in own]]), y))


def test_a_search_gives_no_task_all_samples(spark, monkeypatch):
    long, target, *_ = given(spark)

    def refuse(*_, **__):
        raise AssertionError("all samples in one task")

    monkeypatch.setattr(search, "per_run", refuse)
    assert learn.network_search(long, target, [{"method": "correlation", "k": 2}]).head()["f1"] is not None


def test_smoothed_features_are_scored_alike(spark):
    long, target, *_ = given(spark, n=60)
    got = learn.network_search(long, target, [{"method": "correlation", "k": 2}], mode="laplacian").head()
    from plexmat.operators import analyze, similarity
    from plexmat.operators.community import matrix_of

    edges = similarity.BUILDERS["correlation"](long, self_loops=False, k=2)
    x, samples = matrix_of(analyze.smoothed(long, edges).toPandas(), [f"f{j}" for j in range(7)])
    y = target.toPandas().set_index("sample_id")["y"].reindex(samples).to_numpy(float)
    assert got["f1"] == pytest.approx(learn.proxy_score(special.zscore(x), y))
