"""Complete linkage in rounds against one merge at a time."""

from __future__ import annotations

import random

import numpy as np
import pytest

from plexmat.operators import cca, linkage


def both_ways(pairs: dict) -> list[tuple]:
    return [(a, b, s) for (i, j), s in pairs.items() for a, b in ((i, j), (j, i))]


@pytest.mark.parametrize(("n", "full", "steps", "cut"), [(40, 1.0, 1000, 0.6), (50, 0.3, 1000, 1 - 1e-10), (45, 0.7, 4, 1 - 1e-10), (30, 1.0, 3, 0.7)])
def test_same_clusters_as_one_merge_at_a_time(spark, n, full, steps, cut):
    rng = random.Random(n)
    pairs = {(i, j): rng.randint(1, steps) / steps for i in range(n) for j in range(i + 1, n) if rng.random() < full}
    s = np.zeros((n, n))
    for (i, j), v in pairs.items():
        s[i, j] = s[j, i] = v
    want = [sorted(m) for m in cca.modules_of(s, cut)]
    got: dict = {}
    sim = spark.createDataFrame(both_ways(pairs), "a int, b int, s double")
    for r in cca.modules(sim, cut).collect():
        got.setdefault(r["module"], []).append(r["fpos"])
    assert [sorted(got[m]) for m in sorted(got)] == sorted(want)


def test_many_merges_a_round_and_no_edges(spark):
    pairs = {(2 * i, 2 * i + 1): 0.9 for i in range(50)}
    members, rounds = linkage.clusters(spark.createDataFrame(both_ways(pairs), "a int, b int, s double"))
    assert rounds == 1 and members.count() == 100
    assert linkage.modules(spark.createDataFrame([], "a int, b int, s double")).count() == 0
