"""Exact selection against sorting."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plexmat.operators import ranks


def rows() -> list[tuple]:
    rng = random.Random(8)
    out = [("plain", rng.gauss(0, 1)) for _ in range(700)]
    out += [("skew", math.exp(rng.gauss(0, 40))) for _ in range(500)]
    out += [("ties", float(rng.randint(0, 3))) for _ in range(600)]
    out += [("wide", rng.choice([-1.7e308, 1.7e308, 0.0, 5e-324, float("inf"), float("-inf"), 1.0])) for _ in range(300)]
    out += [("one", 3.5), ("same", 2.0), ("same", 2.0), (None, 1.0), (None, 4.0), (None, 2.0)]
    return [*out, ("plain", None), ("plain", float("nan")), ("empty", None)]


def values_of() -> dict:
    out = defaultdict(list)
    for k, v in rows():
        if v is not None and not math.isnan(v):
            out[k].append(v)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(("bins", "few", "intervals"), [(16, 10, 1000), (64, 1, 0), (1024, 4096, 1000)])
def test_all_ranks_of_all_groups(spark, monkeypatch, bins, few, intervals):
    for name, v in (("BINS", bins), ("FEW", few), ("INTERVALS", intervals)):
        monkeypatch.setattr(ranks, name, v)
    df = spark.createDataFrame(rows(), "k string, v double").repartition(5)
    asked = lambda n: F.array(F.lit(0), n.cast("int") - 1, F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int"), F.lit(0))
    found = {r["k"]: r for r in ranks.order_statistics(df, ["k"], "v", asked).collect()}
    assert set(found) == set(values_of())
    for k, v in values_of().items():
        n = len(v)
        assert found[k]["n"] == n and found[k]["values"] == [v[r] for r in (0, n - 1, n // 3, n // 2, 0)]


def test_quantiles_are_those_of_percentile(spark):
    df = spark.createDataFrame([r for r in rows() if r[0] != "wide"], "k string, v double").where("not isnan(v)")
    p = [0.0, 0.25, 0.5, 0.9, 1.0]
    want = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, p))).alias("q")).where("q is not null").collect()}
    for r in ranks.quantiles(df, ["k"], "v", p).collect():
        assert r["quantiles"] == pytest.approx(want.pop(r["k"]), rel=1e-12)
    assert not want
    whole = ranks.quantiles(df, [], "v", p).collect()
    assert whole[0]["quantiles"] == pytest.approx(df.agg(F.percentile("v", F.array(*map(F.lit, p)))).head()[0], rel=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert ranks.medians(df, ["k"], "v", "m").count() == 0 and ranks.medians(df, [], "v", "m").count() <= 1


@pytest.mark.parametrize("name", ["select_mad", "similarity_network_global"])
def test_queries_are_right_where_groups_are_large(spark, monkeypatch, name):
    from test_queries import compare

    monkeypatch.setattr(ranks, "FEW", 100)
    monkeypatch.setattr(ranks, "BINS", 64)
    compare(spark, name)
