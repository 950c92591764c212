"""Profiling: a number for each feature, and summaries of these over all features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexmat.operators import similarity


def summary(per_feature: DataFrame, score: str, *extra: Column) -> DataFrame:
    """Mean, median, min, max and sample deviation of a column with one row for each feature."""
    v = F.col(score)
    return per_feature.agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_samp(v).alias("std"), *extra)


def variance_summary(long: DataFrame, threshold: float | None = None) -> DataFrame:
    """Sample variances; with a threshold also how many are below it."""
    per = long.groupBy("feature").agg(F.var_samp("value").alias("v"))
    return summary(per, "v", *([F.count_if(F.col("v") < threshold).alias("n_low")] if threshold is not None else []))


def zero_summary(long: DataFrame, threshold: float | None = None) -> DataFrame:
    """Shares of zeros among all rows, missing ones included; with a threshold also how many are above it."""
    per = long.groupBy("feature").agg((F.count_if(F.col("value") == 0) / F.count("*")).alias("v"))
    return summary(per, "v", *([F.count_if(F.col("v") > threshold).alias("n_high")] if threshold is not None else []))


def expression_summary(long: DataFrame) -> DataFrame:
    """Means of features."""
    return summary(long.groupBy("feature").agg(F.avg("value").alias("v")), "v")


def correlation_summary(long: DataFrame) -> DataFrame:
    """For each feature its largest absolute correlation with another (0 for a lone feature), summarised."""
    pairs = similarity.pearson(long)
    best = pairs.groupBy(F.col("src").alias("feature")).agg(F.max(F.abs("s")).alias("v"))
    every = long.select("feature").distinct().join(best, "feature", "left").select(F.coalesce("v", F.lit(0.0)).alias("v"))
    return summary(every, "v")


def missing(long: DataFrame, threshold: float = 20.0, top: int = 5) -> dict[str, DataFrame]:
    """Percent missing: over all cells, the worst features and samples, and how many of either are above the threshold."""
    share = (100.0 * F.count_if(F.col("value").isNull()) / F.count("*")).alias("pct")
    by_feature, by_sample = long.groupBy("feature").agg(share), long.groupBy("sample_id").agg(share)
    return {
        "global": long.agg(share),
        "features": by_feature.orderBy(F.desc("pct"), "feature").limit(top),
        "samples": by_sample.orderBy(F.desc("pct"), "sample_id").limit(top),
        "above": by_feature.agg(F.count_if(F.col("pct") > threshold).alias("n_features")).join(by_sample.agg(F.count_if(F.col("pct") > threshold).alias("n_samples"))),
    }


def report(long: DataFrame, correlation: bool = False) -> DataFrame:
    """All summaries as (metric, value), with advice: sparse data, beta values, or a log transform."""
    parts = {
        "variance": variance_summary(long, 1e-4).withColumnRenamed("n_low", "flagged"),
        "zero": zero_summary(long, 0.5).withColumnRenamed("n_high", "flagged"),
        "mean": expression_summary(long).withColumn("flagged", F.lit(0).cast("long")),
    }
    if correlation:
        parts["correlation"] = correlation_summary(long).withColumn("flagged", F.lit(0).cast("long"))
    names = ["mean", "median", "min", "max", "std", "flagged"]
    out = None
    for part, df in parts.items():
        cells = F.array(*[F.struct(F.lit(f"{part}_{n}").alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
        own = df.select(F.inline(cells))
        out = own if out is None else out.unionByName(own)
    pct = missing(long)["global"].select(F.lit("missing_pct").alias("metric"), F.col("pct").alias("value"))
    out = out.unionByName(pct)
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    advice = F.when(of("missing_pct") > 30, 1.0).when((of("mean_min") >= 0) & (of("mean_max") <= 1), 2.0).when(of("zero_flagged") > 0, 3.0).otherwise(0.0)
    return out.unionByName(out.agg(advice.alias("value")).select(F.lit("advice").alias("metric"), "value"))


def variance_histogram(long: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, low, n): features by equal ranges of variance; the data of a histogram."""
    per = long.groupBy("feature").agg(F.var_samp("value").alias("v"))
    span = F.broadcast(per.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(step, F.lit(0.0))), F.lit(bins - 1))
    return per.join(span).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.min(F.col("lo") + F.coalesce(at, F.lit(0)) * step).alias("low"), F.count("*").alias("n"))
