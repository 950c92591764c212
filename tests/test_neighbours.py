"""Pruned nearest neighbours against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from plexmat.operators import neighbours


def brute(ids: list[str], x: np.ndarray, k: int) -> set:
    length = np.sqrt((x * x).sum(1))
    u = x / np.where(length > 0, length, 1)[:, None]
    s = np.round(u @ u.T, 9)
    s[length == 0] = s[:, length == 0] = -2.0
    out = set()
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))
        out |= {(a, ids[j]) for j in order[:k]}
    return out


def clusters(n: int, dim: int, groups: int, spread: float, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return centres[np.where(rng.random(n) < 0.4, 0, rng.integers(0, groups, n))] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize(("spread", "groups"), [(0.05, 12), (3.0, 3)])
def test_equal_to_all_pairs_and_fewer_pairs_on_clusters(spark, spread, groups):
    x = clusters(700, 6, groups, spread, 1)
    x[10] = x[11] = x[12]
    x[[20, 400]] = 0.0
    ids = [f"s{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "id string, x array<double>").repartition(3)
    search = neighbours.Neighbours(df, 4, block=40, pivots=24)
    assert {(r["a"], r["b"]) for r in search.result().collect()} == brute(ids, x, 4)
    assert search.compared <= 700**2 and (spread > 1 or search.compared < 0.5 * 700**2)


def test_few_rows(spark):
    for rows in ([], [("a", [1.0, 0.0])], [("a", [0.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 2.0])]):
        df = spark.createDataFrame(rows, "id string, x array<double>")
        want = brute([r[0] for r in rows], np.array([r[1] for r in rows]).reshape(-1, 2), 2) if rows else set()
        assert {(r["a"], r["b"]) for r in neighbours.nearest(df, 2).collect()} == want


def test_a_block_is_sent_to_few_tasks_and_copies_are_ranked_by_id(spark, monkeypatch):
    x = clusters(400, 6, 3, 3.0, 2)
    x[200:] = x[np.random.default_rng(3).integers(0, 25, 200)]
    ids = [f"s{(i * 7) % 400:04d}" for i in range(len(x))]
    df = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "id string, x array<double>").repartition(3)
    tables, real = {}, neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda df, name: tables.setdefault(name, real(df, name)))
    monkeypatch.setattr(neighbours, "GROUPS", 3)
    search = neighbours.Neighbours(df, 4, block=8, pivots=6)
    assert {(r["a"], r["b"]) for r in search.result().collect()} == brute(ids, x, 4)
    blocks, pairs, sent = (tables[n].count() for n in ("packed-blocks", "pairs", "blocks-of-groups"))
    assert blocks > 50 and pairs > 0.5 * blocks**2 and sent <= blocks * 4
