"""Outcome models: gradients part by part, and the memory that a fit takes."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from plexmat.functions import autodiff as ad
from plexmat.operators import learn


def given(n: int, classes: int = 3):
    rng = np.random.default_rng(4)
    a = np.maximum(*(lambda m: (m, m.T))((rng.random((12, 12)) < 0.3) * 1.0))
    return rng.normal(size=(12, 5)), learn._with_loops(a), rng.normal(size=(n, 12)), rng.integers(0, classes, n)


@pytest.mark.parametrize("reduction", ["ae", "linear", "mlp"])
def test_gradients_of_parts_are_those_of_the_whole(monkeypatch, reduction):
    monkeypatch.setattr(learn, "PART", 16)
    x, g, rows, label = given(101)
    one, two = (learn.Outcome("GCN", 5, 12, 3, reduction=reduction) for _ in range(2))
    ad.cross_entropy(one.scores(x, g, rows, np.random.default_rng(2)), label).backward()
    two.slope(two.weights(x, g, np.random.default_rng(2)), rows, label)
    for p, q in zip(one.params, two.params, strict=True):
        assert np.allclose(p.grad, q.grad, rtol=1e-9, atol=1e-12)
    for (*_, s), (*_, t) in zip(one.norm, two.norm, strict=True):
        assert np.allclose(s["m"], t["m"]) and np.allclose(s["s"], t["s"])


def test_a_fit_keeps_few_numbers_a_sample():
    n = 40_000
    x, g, rows, label = given(n)
    net = learn.Outcome("GCN", 5, 12, 3)
    tracemalloc.start()
    net.fit(x, g, rows, label, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * 8 * 150  # two layers of 32 and 16, their gradients, and a part's arrays
