"""Baseline classifiers: folds are fitted beside each other."""

from __future__ import annotations

import threading

from pyspark.ml.classification import DecisionTreeClassifier

from plexmat.operators import learn


def test_folds_beside_each_other_and_one_by_one(spark, monkeypatch):
    rows = [(f"s{i:02d}", j, f"f{j}", float((i * (j + 3)) % 7)) for i in range(60) for j in range(3)]
    long = spark.createDataFrame(rows, "sample_id string, fpos int, feature string, value double")
    target = spark.createDataFrame([(f"s{i:02d}", float(i % 7 > 3)) for i in range(60)], "sample_id string, y double")
    with monkeypatch.context() as m:
        m.setattr(learn, "FITS", 1)
        want = sorted(learn.baseline(long, target, "dt").collect())
    together, real = threading.Barrier(3, timeout=60), DecisionTreeClassifier.fit
    monkeypatch.setattr(DecisionTreeClassifier, "fit", lambda self, data: together.wait() >= 0 and real(self, data))
    assert sorted(learn.baseline(long, target, "dt").collect()) == want and [r[0] for r in want] == [0, 1, 2]
