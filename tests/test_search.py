"""The search over all settings in one plan against one setting at a time."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexmat.functions import special
from plexmat.operators import analyze, community, learn, similarity

SETTINGS = [
    {"method": "correlation", "k": 3, "by": "spearman", "signed_map": False},
    {"method": "threshold", "k": 2, "b": 5.5, "mutual_only": True},
    {"method": "gaussian", "k": 4, "sigma": None, "mutual_only": False},
    {"method": "gaussian", "k": 1, "sigma": 0.5, "mutual_only": True},
    {"method": "similarity", "k": 2, "metric": "gaussian", "mutual_only": False},
    {"method": "similarity", "k": 3, "metric": "cosine", "mutual_only": True},
]


def test_all_settings_at_once(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(45, 9))
    x[:, 3:6] += x[:, :3]
    y = (x[:, 0] > 0).astype(float)
    long = spark.createDataFrame([(f"s{i:02d}", j, f"f{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)], "sample_id string, fpos int, feature string, value double")
    target = spark.createDataFrame([(f"s{i:02d}", float(v)) for i, v in enumerate(y)], "sample_id string, y double")
    got = {r["config"]: r for r in learn.network_search(long, target, [*SETTINGS, {"method": "nothing"}], weight=0.2).collect()}
    assert sorted(got) == list(range(len(SETTINGS)))
    nodes = similarity.features_of(long).select(F.col("feature").alias("node"), F.col("fpos").alias("npos"))
    for i in (1, 2, 5):
        edges = similarity.BUILDERS[SETTINGS[i]["method"]](long, self_loops=False, **learn._arguments(SETTINGS[i]))
        quality = analyze.topology_quality(edges, nodes).head()["quality"]
        one = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))
        c = {r["node"]: np.log1p(max(r["score"], 0.0)) for r in community.eigenvector(one, 20).collect()}
        names = sorted(c)
        f1 = learn.proxy_score(special.zscore(x[:, [int(n[1:]) for n in names]] * [c[n] for n in names]), y)
        assert got[i]["topology"] == pytest.approx(quality) and got[i]["f1"] == pytest.approx(f1)
        assert got[i]["score"] == pytest.approx(0.8 * f1 + 0.2 * quality)
