"""Outcome models over blocks of the samples: scores of fits that a task makes of the whole table, and nothing that takes it whole."""

from __future__ import annotations

import numpy as np
import pytest

from plexmat.operators import learn, together


def given(spark, n: int = 150, single: bool = False):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, n)
    m = rng.normal(size=(n, 6)) * 3 + 10 + (y[:, None] == np.arange(6) % 3)
    m[:, 5] = 0.1
    m = m.astype(np.float32).astype(float) if single else m
    ids = [f"s{i:03d}" for i in range(n)]
    cells = [(ids[i], j, f"n{j}", None if (i + j) % 17 == 0 and j < 5 else float(m[i, j])) for i in range(n) for j in range(6)]
    long = spark.createDataFrame(cells, "sample_id string, fpos int, feature string, value double")
    target = spark.createDataFrame([(s, None if i == 7 else float(v)) for i, (s, v) in enumerate(zip(ids, y, strict=True))], "sample_id string, y double")
    clinical = spark.createDataFrame([(s, None if i % 9 == 0 else float(m[i, 0] + i % 4), 1.0 + i % 2, None) for i, s in enumerate(ids) if i % 11], "sample_id string, a double, b double, c double")
    edges = spark.createDataFrame([(f"n{i}", f"n{j}", 0.5 + 0.1 * i) for i in range(6) for j in range(i)], "src string, dst string, weight double")
    return edges, long, target, clinical


def refused(*args, **options):
    raise AssertionError("a task takes the whole table")


def scores(df) -> dict:
    return {(r["rep"], r["fold"], r["sample_id"], r["y"], r["class"]): r["score"] for r in df.collect()}


@pytest.mark.parametrize("options", [{"k": 3, "kind": "GCN"}, {"share": 0.3, "repeats": 2, "kind": "GAT", "reduction": "mlp"}, {"k": 2, "kind": "SAGE", "single": True, "reduction": "linear", "bare": True}])
def test_scores_are_those_of_fits_of_the_whole_table(spark, monkeypatch, options):
    edges, long, target, clinical = given(spark, single=options.pop("single", False))
    more = () if options.pop("bare", False) else (clinical, ["a", "b", "c"])
    whole = scores(learn.predict(edges, long, target, *more, epochs=8, **options))
    monkeypatch.setattr(learn, "WHOLE", 0, raising=False)
    monkeypatch.setattr(learn, "per_run", refused)
    monkeypatch.setattr(together, "PART", 16)
    parts = scores(learn.predict(edges, long, target, *more, epochs=8, **options))
    assert whole.keys() == parts.keys()
    assert max(abs(whole[k] - parts[k]) for k in whole) < 2e-5  # Adam makes steps of what rounding leaves of gradients that are 0


def test_tuning_fits_no_whole_table(spark, monkeypatch):
    edges, long, target, _ = given(spark)
    settings = [{"epochs": 1, "rate": 1e-6}, {"epochs": 12}]
    whole = learn.tune_outcome(edges, long, target, k=2, inner=2, settings=settings)
    monkeypatch.setattr(learn, "WHOLE", 0, raising=False)
    monkeypatch.setattr(learn, "per_run", refused)
    monkeypatch.setattr(together, "MERGED", 2)
    parts = learn.tune_outcome(edges, long, target, k=2, inner=2, settings=settings)
    for name in ("chosen", "runs"):
        for a, b in zip(whole[name].orderBy("fold").collect(), parts[name].orderBy("fold").collect(), strict=True):
            assert all(u == (pytest.approx(v, abs=1e-6) if isinstance(v, float) else v) for u, v in zip(a, b, strict=True))


def test_a_pass_keeps_sums_alone():
    rng = np.random.default_rng(1)
    x, label = rng.normal(size=(4096, 12)), rng.integers(0, 3, 4096)
    g = {"a": rng.normal(size=(12, 32)), "c": np.zeros(32), "w2": rng.normal(size=(32, 16)), "ref": np.zeros(16), "n": 4096}
    assert together.step(x, label, g).shape == (2 * 16,)
    g |= {"inv": np.ones(16), "mean": np.zeros(16), "scale": np.ones(16), "shift": np.zeros(16), "w3": rng.normal(size=(16, 3)), "b3": np.zeros(3)}
    assert together.step(x, label, g).shape == (16 * 3 + 3 + 2 * 16,)
    g |= {"back": np.zeros(16), "along": np.zeros(16)}
    assert together.step(x, label, g).shape == (32 * 16 + 12 * 32 + 32,)
