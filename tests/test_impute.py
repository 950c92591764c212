"""Gaps filled from the nearest samples, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from plexmat.operators import clean


def brute(ids: list[str], x: np.ndarray, k: int) -> dict:
    there, out = ~np.isnan(x), {}
    for i, a in enumerate(ids):
        near = []
        for j, b in enumerate(ids):
            both = there[i] & there[j]
            if j != i and both.any():
                near.append((round(float(np.sqrt(x.shape[1] / both.sum() * ((x[i] - x[j])[both] ** 2).sum())), 9), b, j))
        near.sort()
        for f in range(x.shape[1]):
            given = [x[j, f] for _, _, j in near if there[j, f]][:k]
            out[a, f] = x[i, f] if there[i, f] else np.mean(given) if given else np.nanmean(x[:, f])
    return out


def test_gaps_by_groups_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = (1000 + rng.normal(size=(160, 6)) * 30).round(2)
    x[100:] = x[rng.integers(0, 8, 60)]  # copies, which have the distance 0
    x[rng.random(x.shape) < 0.15] = np.nan
    x[3:, 5] = np.nan  # fewer donors than k
    x[7, :] = np.nan
    ids = [f"s{(i * 7) % 160:03d}" for i in range(160)]
    rows = [(s, f, f"f{f}", None if np.isnan(v) else float(v)) for s, own in zip(ids, x, strict=True) for f, v in enumerate(own)]
    long = spark.createDataFrame(rows, "sample_id string, fpos int, feature string, value double")
    tables, real = {}, clean.written
    monkeypatch.setattr(clean, "written", lambda df, name: tables.setdefault(name, real(df, name)))
    monkeypatch.setattr(clean, "GROUPS", 3)
    monkeypatch.setattr(clean, "CELLS", 500)
    got = {(r["sample_id"], r["fpos"]): r["value"] for r in clean.impute_knn(long, 4, block=12).collect()}
    assert got == pytest.approx(brute(ids, x, 4)) and tables["impute-blocks"].count() > 10
