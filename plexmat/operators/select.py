"""Feature selection: a score for each feature, and the best of them. Ties go to the earlier feature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plexmat.functions import special
from plexmat.operators import clean, neighbours, ranks, similarity
from plexmat.operators.components import Components
from plexmat.plans.iterate import written
from plexmat.sources.frames import row_vectors

_KEY = ["fpos", "feature"]


def top(scores: DataFrame, k: int, ascending: bool = False, digits: int = 9) -> DataFrame:
    """The k best (fpos, feature, score), compared after rounding."""
    s = F.round("score", digits)
    return scores.orderBy(s.asc() if ascending else s.desc(), "fpos").limit(k)


def variance_top(long: DataFrame, k: int = 1000, ddof: int = 0) -> DataFrame:
    v = F.var_pop("value") if ddof == 0 else F.var_samp("value")
    return top(clean.clean_inf(long).groupBy(*_KEY).agg(v.alias("score")), k)


def mad_top(long: DataFrame, k: int) -> DataFrame:
    """By median absolute deviation."""
    dev = long.join(ranks.medians(long, ["feature"], "value", "_m"), "feature").select(*_KEY, F.abs(F.col("value") - F.col("_m")).alias("d"))
    return top(ranks.medians(dev, _KEY, "d", "score"), k)


def pca_top(long: DataFrame, k: int, components: int = 50) -> DataFrame:
    """By the largest loading times explained share over the leading components of z-scores (`components`)."""
    found = Components(clean.normalize(long, "standard"), components)
    names = similarity.features_of(long)
    if found.loads is None:
        return top(names.withColumn("score", F.lit(0.0)), k)
    share = F.array(*[F.lit(float(v) / found.total) for v in found.values])
    best = F.array_max(F.zip_with("v", share, lambda a, b: F.abs(a) * b))
    return top(names.join(found.loads.select("fpos", best.alias("score")), "fpos", "left").select(*_KEY, F.coalesce("score", F.lit(0.0)).alias("score")), k)


def sample_graph(z: DataFrame, k: int = 5, block: int = 1000) -> DataFrame:
    """The symmetric k-nearest-neighbour graph of samples by cosine, as (a, b) in both directions; ties go to the lower id (`neighbours`)."""
    return _graph(row_vectors(z), k, block)


def _graph(rows: DataFrame, k: int, block: int = 1000) -> DataFrame:
    near = neighbours.nearest(rows.select(F.col("sample_id").alias("id"), "x"), k, block).select("a", "b")
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def laplacian_top(long: DataFrame, k: int, neighbors: int = 5) -> DataFrame:
    """The features that vary least along the sample graph (Laplacian score, lowest first).

    Samples go as rows of all features, each edge of the graph once; sums over both are vectors of a number a feature.
    """
    names = similarity.features_of(long).select(*_KEY).orderBy("fpos")
    rows = written(row_vectors(clean.normalize(long, "standard")), "z-rows")
    w = written(_graph(rows, neighbors), "sample-graph")
    zd = written(rows.join(w.groupBy(F.col("a").alias("sample_id")).agg(F.count("*").cast("double").alias("d")), "sample_id"), "z-degrees")
    pairs = w.where("a < b").join(zd.select(F.col("sample_id").alias("a"), F.col("x").alias("xa")), "a").join(zd.select(F.col("sample_id").alias("b"), F.col("x").alias("xb")), "b")
    total, found, first = _sums(zd, ["x", "d"], lambda p: (p["d"].sum(), *_parts(p, "x", lambda x, d: (~np.isnan(x), d * x), p["d"])))
    spark, schema = long.sparkSession, [*names.schema.fields, StructField("score", DoubleType())]
    if not total:
        return spark.createDataFrame([], StructType(schema))
    mu = first / total
    den = _sums(zd, ["x", "d"], lambda p: (0.0, *_parts(p, "x", lambda x, d: (~np.isnan(x), d * (x - mu) ** 2), p["d"])))[2]
    num = 2 * _sums(pairs, ["xa", "xb"], lambda p: (0.0, *_parts(p, "xa", lambda a, b: (~np.isnan(a), (a - mu) * (b - mu)), _matrix(p["xb"]))))[2]
    score = np.where(found > 0, (den - num) / (den + 1e-8), np.nan)
    scores = [(r["fpos"], r["feature"], None if np.isnan(v) else float(v)) for r, v in zip(names.collect(), score, strict=True)]
    return top(spark.createDataFrame(scores, StructType(schema)), k, ascending=True)


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(r, float) for r in rows])


def _parts(p: pd.DataFrame, column: str, f, other) -> tuple[np.ndarray, np.ndarray]:
    x = _matrix(p[column])
    there, value = f(x, other if isinstance(other, np.ndarray) else other.to_numpy()[:, None])
    return there.sum(0).astype(float), np.nansum(value, 0)


def _sums(df: DataFrame, columns: list[str], part) -> tuple[float, np.ndarray, np.ndarray]:
    """The sum of a number and of two vectors over all batches; a task gives one row."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = None
        for p in batches:
            if len(p):
                own = part(p)
                got = own if got is None else tuple(a + b for a, b in zip(got, own, strict=True))
        if got is not None:
            yield pd.DataFrame({"n": [got[0]], "u": [got[1].tobytes()], "v": [got[2].tobytes()]})

    n, u, v = 0.0, np.zeros(1), np.zeros(1)
    for r in df.select(*columns).mapInPandas(add, "n double, u binary, v binary").toLocalIterator():
        n, u, v = n + r["n"], u + np.frombuffer(r["u"]), v + np.frombuffer(r["v"])
    return n, u, v


def pearson_with(long: DataFrame, target: DataFrame) -> DataFrame:
    """Each feature's correlation r with y over the n samples that have both; null where either is constant."""
    both = long.where("value is not null").join(target.where("y is not null"), "sample_id")
    means = both.groupBy(*_KEY).agg(F.avg("value").alias("_mx"), F.avg("y").alias("_my"))
    c = both.join(means, _KEY).select(*_KEY, (F.col("value") - F.col("_mx")).alias("a"), (F.col("y") - F.col("_my")).alias("b"))
    sums = c.groupBy(*_KEY).agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") ** 2).alias("aa"), F.sum(F.col("b") ** 2).alias("bb"))
    return sums.select(*_KEY, "n", (F.col("ab") / F.when(F.col("aa") * F.col("bb") > 1e-24, F.sqrt(F.col("aa") * F.col("bb")))).alias("r"))


def correlation_top(long: DataFrame, target: DataFrame | None = None, k: int = 1000) -> DataFrame:
    """By absolute correlation with the target, or without one by the mean absolute correlation with other features."""
    x = clean.clean_inf(long)
    if target is not None:
        return top(pearson_with(x, target).select(*_KEY, F.coalesce(F.abs("r"), F.lit(0.0)).alias("score")), k)
    pairs = similarity.pearson(x)
    return top(pairs.groupBy(F.col("src_pos").alias("fpos"), F.col("src").alias("feature")).agg(F.avg(F.abs("s")).alias("score")), k)


def forest_top(long: DataFrame, target: DataFrame, k: int = 1000, trees: int = 100, seed: int = 119) -> DataFrame:
    """By importance in a random forest: a classifier for up to 10 target values, else a regressor."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    x = clean.clean_inf(long)
    names = [r["feature"] for r in similarity.features_of(x).orderBy("fpos").collect()]
    rows = row_vectors(x).join(target, "sample_id").select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
    few = target.agg(F.count_distinct("y").alias("n")).head()["n"] <= 10
    model = (RandomForestClassifier if few else RandomForestRegressor)(numTrees=trees, seed=seed).fit(rows)
    spark = long.sparkSession
    scores = spark.createDataFrame([(i, n, float(s)) for i, (n, s) in enumerate(zip(names, model.featureImportances.toArray(), strict=True))], "fpos int, feature string, score double")
    return top(scores, k)


def anova(long: DataFrame, target: DataFrame) -> DataFrame:
    """F of each feature between and within the classes of y, with its degrees of freedom."""
    both = long.where("value is not null").join(target, "sample_id")
    by = both.groupBy(*_KEY, "y").agg(F.count("*").alias("n"), F.avg("value").alias("cm"), F.var_pop("value").alias("v"))
    all_ = by.groupBy(*_KEY).agg(F.sum("n").alias("all_n"), F.count("*").alias("n_classes"), (F.sum(F.col("n") * F.col("cm")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = by.join(all_.select(*_KEY, "gm"), _KEY).groupBy(*_KEY).agg(F.sum(F.col("n") * (F.col("cm") - F.col("gm")) ** 2).alias("between"))
    d1, d2 = (F.col("n_classes") - 1).cast("double"), (F.col("all_n") - F.col("n_classes")).cast("double")
    return all_.join(between, _KEY).select(*_KEY, (F.col("between") / d1 / F.nullif(F.col("within") / d2, F.lit(0.0))).alias("f"), d1.alias("d1"), d2.alias("d2"))


def regression_f(long: DataFrame, target: DataFrame) -> DataFrame:
    """F of a simple regression of y on each feature."""
    r2 = F.col("r") ** 2
    return pearson_with(long, target).select(*_KEY, (r2 / F.nullif(1 - r2, F.lit(0.0)) * (F.col("n") - 2)).alias("f"), F.lit(1.0).alias("d1"), (F.col("n") - 2).cast("double").alias("d2"))


def adjusted(scores: DataFrame, p: str = "p") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values, q."""
    m = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(p, "fpos"))
    ranked = scores.withColumns({"_rank": rank, "_m": m})
    upward = Window.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(upward))).drop("_rank", "_m")


def f_top(long: DataFrame, target: DataFrame, k: int, alpha: float = 0.05, task: str = "classification") -> DataFrame:
    """Significant features by F, then the best of the others until there are k."""
    if task not in ("classification", "regression"):
        raise ValueError(f"unknown task {task!r}")
    x = clean.clean_inf(long)
    f = anova(x, target) if task == "classification" else regression_f(x, target)
    tested = adjusted(f.withColumn("p", special.f_pvalue("f", "d1", "d2")))
    good: Column = F.coalesce(F.col("q") < alpha, F.lit(False))
    return tested.withColumn("significant", good).orderBy(F.desc("significant"), F.desc(F.round("f", 6)), "fpos").limit(k)


def in_both(one: DataFrame, two: DataFrame) -> DataFrame:
    """Features that two selections share, by name."""
    return one.select("feature").intersect(two.select("feature"))
