"""What is read or sent once only: edges of a first round, cells of a smoothed matrix."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from plexmat.operators import analyze, louvain


def test_a_first_round_takes_its_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [("a", "b", 3.0), ("b", "c", 1.0), ("c", "d", 2.0), ("a", "a", 1.0)]

    def told(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    edges = spark.createDataFrame(rows, "src string, dst string, weight double").mapInPandas(told, "src string, dst string, weight double")
    assert louvain.first_round(edges).count() == 4
    assert seen.value == 2 * len(rows)  # both directions, one reading each


def test_smoothing_moves_cells_by_sample_alone(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(6, 4)).round(3)
    x[2, 1] = np.nan
    rows = [(f"s{i}", j, f"f{j}", None if np.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    long = spark.createDataFrame([*rows, *rows[:1]], "sample_id string, fpos int, feature string, value double")  # a cell twice stays twice
    a = np.array([[0, 1, 0.5, 0], [1, 0, 0, 0], [0.5, 0, 0, 0], [0, 0, 0, 0.0]])
    edges = spark.createDataFrame([(f"f{i}", f"f{j}", float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "src string, dst string, weight double")
    got = analyze.smoothed(long, edges)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sample_id" in plan and not re.search(r"hashpartitioning\(sample_id#\w+, (dst|feature)", plan)
    monkeypatch.setattr(analyze, "SMOOTHED", 0)
    other = analyze.smoothed(long, edges)
    told = lambda df: sorted((r["sample_id"], r["fpos"], r["feature"], r["value"] is None, round(r["value"] or 0.0, 9)) for r in df.collect())
    assert told(got) == told(other) and got.where(F.col("value").isNull()).count() == 1
