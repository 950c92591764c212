"""Principal components, binomial regression and sweep cuts against dense kernels."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from plexmat.functions import special
from plexmat.operators import community, components, glm, select


def long_of(spark, x: np.ndarray):
    rows = [(f"s{i:03d}", j, f"f{j:03d}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "sample_id string, fpos int, feature string, value double")


@pytest.mark.parametrize(("n", "d", "rank"), [(60, 12, 12), (9, 40, 9), (50, 20, 3)])
def test_components_are_those_of_the_svd(spark, n, d, rank):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, rank)) @ rng.normal(size=(rank, d)) 
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    found = components.Components(long_of(spark, x), 5, oversample=40)
    m = min(5, rank)
    assert found.values[:m] == pytest.approx(s[:m] ** 2, rel=1e-8) and found.total == pytest.approx((x**2).sum())
    loads = np.stack([r["v"] for r in found.loads.orderBy("fpos").collect()])[:, :m]
    scores = np.stack([r["v"] for r in found.scores.orderBy("sample_id").collect()])[:, :m]
    assert np.abs(np.abs(loads) - np.abs(vt[:m].T)).max() < 1e-6
    assert np.abs(scores @ loads.T - (u[:, :m] * s[:m]) @ vt[:m]).max() < 1e-6 * s[0]


def test_few_directions_come_close(spark, monkeypatch):
    monkeypatch.setattr(components, "EXACT", 5)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 60)) * (0.8 ** np.arange(60))
    s = np.linalg.svd(x, compute_uv=False)
    assert components.Components(long_of(spark, x), 4, oversample=6).values == pytest.approx(s[:4] ** 2, rel=1e-4)
    assert components.Components(long_of(spark, np.zeros((3, 2))), 2).loads is None


def test_pca_selection_is_that_of_the_gram(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 15)) @ rng.normal(size=(15, 15))
    z = special.zscore(x)
    val, vec = np.linalg.eigh(z.T @ z)
    score = (np.abs(vec[:, ::-1][:, :6]) * (val[::-1][:6] / val.sum())).max(1)
    got = select.pca_top(long_of(spark, x), 5, components=6).collect()
    assert [r["fpos"] for r in got] == np.argsort(-score, kind="stable")[:5].tolist()
    assert [r["score"] for r in got] == pytest.approx(np.sort(score)[::-1][:5].tolist())


def test_binomial_regression_is_that_of_the_kernel(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.3])))).astype(float)
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    got = [r["coefficient"] for r in glm.binomial(df, ["a", "b", "c"]).collect()]
    assert got == pytest.approx(special.irls(x, y).tolist(), rel=1e-7)
    with_one = {r["term"]: r["coefficient"] for r in glm.binomial(df, ["a"], intercept=True).collect()}
    assert [with_one["(intercept)"], with_one["a"]] == pytest.approx(special.irls(np.stack([np.ones(300), x[:, 0]], 1), y).tolist(), rel=1e-7)
    apart = spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "a double, y double")
    assert all(np.isfinite(r["coefficient"]) for r in glm.binomial(apart, ["a"], intercept=True, steps=30).collect())
    assert [r["coefficient"] for r in glm.binomial(apart.where("a < 0"), ["a"]).collect()] == [0.0]


def test_sweep_cuts_against_sets(spark):
    rng = random.Random(4)
    nodes = [f"n{i:02d}" for i in range(20)]
    edges = [(a, b, round(rng.random(), 3)) for a, b in itertools.combinations(nodes, 2) if rng.random() < 0.3] + [("n03", "n03", 0.7)]
    score = {n: rng.choice([0.0, 0.25, 0.5, 1.0]) for n in nodes}
    got = community.sweep_cuts(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(list(score.items()), "node string, score double"), cells=4).orderBy("place").collect()
    k = dict.fromkeys(nodes, 0.0)
    for a, b, w in edges:
        k[a] += w
        if a != b:
            k[b] += w
    order = sorted((n for n in nodes if score[n] > 0 and k[n] > 0), key=lambda n: (score[n] / k[n], n), reverse=True)
    assert [r["node"] for r in got] == order and [r["place"] for r in got] == list(range(1, len(order) + 1))
    for r in got:
        inside = set(order[: r["place"]])
        cut, vol = sum(w for a, b, w in edges if (a in inside) != (b in inside)), sum(k[n] for n in inside)
        assert (r["cut"], r["volume"]) == pytest.approx((cut, vol), abs=1e-9)
        other = sum(k.values()) - vol
        assert r["conductance"] == (pytest.approx(cut / min(vol, other)) if min(vol, other) > 1e-9 else None)
