"""The forest inside tasks: cuts against brute force, and the memory that a fit takes."""

from __future__ import annotations

import tracemalloc

import numpy as np

from plexmat.functions import forest


def test_the_best_cut_is_that_of_brute_force():
    rng = np.random.default_rng(3)
    for width in (4, 0):
        v = np.round(rng.normal(size=80), 1)
        t = rng.integers(0, 4, 80).astype(np.int16) if width else rng.normal(size=(80, 1))
        full = (t[:, None] == np.arange(4)) * 1.0 if width else t
        error = lambda a: ((a - a.mean(0)) ** 2).sum()
        cuts = np.unique(v)
        gains = [(error(full) - error(full[v <= c]) - error(full[v > c]), (c + d) / 2) for c, d in zip(cuts, cuts[1:], strict=False) if min((v <= c).sum(), (v > c).sum()) >= 2]
        gain, cut = forest._best(v, t, width, 2)
        assert np.isclose(gain, max(gains)[0]) and np.isclose(cut, max(gains)[1])


def test_scaled_columns_are_those_of_a_scaled_matrix():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    y, s = (x[:, 1] > 0) + (x[:, 2] > 1) * 1.0, np.array([1.5, -2.0, 0.3, 0.0, 1.0, -1.0])
    assert forest.score(x, y, True, 1, scale=s) == forest.score(x.astype(float) * s, y, True, 1) > 0.7
    assert forest.score(x, y, False, 1, scale=s) == forest.score(x.astype(float) * s, y, False, 1)


def test_a_fit_copies_no_matrix():
    n, p = 20_000, 60
    rng = np.random.default_rng(5)
    x, y = np.asfortranarray(rng.normal(size=(n, p)).astype(np.float32)), rng.integers(0, 10, n).astype(float)
    tracemalloc.start()
    forest.predict(x, y.astype(np.int16), np.arange(n), np.arange(100), trees=1, depth=2, width=10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * 8 * 24  # less than the matrix in single precision
