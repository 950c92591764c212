"""How a set of features goes with a phenotype: the first principal component of the set against y."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexmat.functions import special
from plexmat.operators import clean, condense
from plexmat.operators.components import Components
from plexmat.plans.iterate import written


def component(x: np.ndarray, y: np.ndarray, standardize: bool, n: int | None = None) -> tuple[float | None, float | None]:
    """|r| of the first component with y, and its p-value; None for fewer than 2 features or 3 samples, or no variance. n: how many samples the rows stand for."""
    if x.shape[1] < 2 or len(x) < 3:
        return None, None
    pc, _ = special.first_component(special.zscore(x) if standardize else x)
    if pc.std() < 1e-10 or y.std() < 1e-12:
        return None, None
    r = abs(special.pearson(pc, y))
    return r, special.pearson_tail(r, n or len(x))


def set_correlations(long: DataFrame, target: DataFrame, sets: DataFrame, standardize: bool = True) -> DataFrame:
    """For each set (set_id, feature): its size, |r| of its first component with y (by sample, not by place), and p.

    A set's matrix is built in one task each, from a few rows that stand for the samples where there are many (`condense`):
    sets are meant to be small groups of features. Missing cells are 0; a sample without any cell of a set, not even a null one, takes no part in it.
    """
    small, y, n = condense.few(long, target, empty=True)
    if n is None and _in_all_sets(long, sets):
        small, y, n = condense.few(long, target, empty=True, fill=True)
    long, target = small, y
    cells = long.join(target.where("y is not null"), "sample_id").join(sets.select("set_id", "feature").distinct(), "feature").select("set_id", "sample_id", "feature", F.coalesce("value", F.lit(0.0)).alias("value"), "y")

    def one(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        m = p.pivot_table(index="sample_id", columns="feature", values="value", aggfunc="first").fillna(0.0).sort_index()
        y = p.groupby("sample_id")["y"].first().sort_index().to_numpy()
        r, pv = component(m.to_numpy(), y, standardize, n)
        return pd.DataFrame({"set_id": [key[0]], "size": [m.shape[1]], "r": [r], "p": [pv]})

    return cells.groupBy("set_id").applyInPandas(one, "set_id long, size long, r double, p double")


def _in_all_sets(long: DataFrame, sets: DataFrame) -> bool:
    """Whether each sample has a cell of each set, so that those it lacks may be written as 0."""
    named = sets.select("set_id", "feature").distinct().join(long.select("feature").distinct(), "feature", "left_semi")
    per_sample = long.select("sample_id", "feature").join(F.broadcast(named), "feature", "left").groupBy("sample_id").agg(F.count_distinct("set_id").alias("n"))
    return per_sample.agg(F.min("n")).head()[0] == named.agg(F.count_distinct("set_id")).head()[0]


def omics_correlation(long: DataFrame, target: DataFrame) -> DataFrame:
    """|r| and p of the first component of all (standardised) features."""
    if target.isEmpty():
        raise ValueError("the phenotype is empty")
    cells = long.join(target.where("y is not null"), "sample_id").select("sample_id", "fpos", "feature", F.coalesce("value", F.lit(0.0)).alias("value"), "y")
    cells = written(cells, "with-y")
    found = Components(clean.normalize(cells.drop("y"), "standard"), 1)
    size = cells.agg(F.count_distinct("sample_id").alias("n"), F.count_distinct("feature").alias("d")).head()
    r = p = None
    if found.scores is not None and size["d"] >= 2 and size["n"] >= 3:
        # a sample without a score is one whose standardised values are all 0
        y = cells.groupBy("sample_id").agg(F.first("y").alias("y"))
        both = y.join(found.scores.select("sample_id", F.col("v")[0].alias("t")), "sample_id", "left").na.fill(0.0, ["t"])
        sums = both.agg(F.corr("t", "y").alias("r"), F.stddev_pop("t").alias("st"), F.stddev_pop("y").alias("sy")).head()
        if sums["st"] >= 1e-10 and sums["sy"] >= 1e-12:
            r = abs(sums["r"])
            p = special.pearson_tail(r, size["n"])
    return long.sparkSession.createDataFrame([(r, p)], "r double, p double")


def cluster_correlation(long: DataFrame, target: DataFrame, features: Iterable[str]) -> DataFrame:
    """Size, |r| and p of a group of features, centred but not scaled."""
    chosen = long.sparkSession.createDataFrame([(0, f) for f in features], "set_id long, feature string")
    return set_correlations(long, target, chosen, standardize=False).select("size", "r", "p")


def compare_sets(long: DataFrame, target: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """Two collections of sets paired by rank of size, with the correlation of either; pairs without both are left out."""
    def ranked(sets: DataFrame, r: str, n: str) -> DataFrame:
        c = set_correlations(long, target, sets, standardize=False)
        return c.select(F.row_number().over(Window.orderBy(F.desc("size"), "set_id")).alias("rank"), F.col("size").alias(n), F.col("r").alias(r))

    both = ranked(one, "r1", "size1").join(ranked(two, "r2", "size2"), "rank")
    return both.where("r1 is not null and r2 is not null").orderBy("rank")
