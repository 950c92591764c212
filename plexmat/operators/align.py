"""Alignment of matrices, phenotypes and networks by samples and features: joins that Spark plans as it sees fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inner(long: DataFrame, target: DataFrame) -> DataFrame:
    """Cells of the samples that both have, with the columns of the other table."""
    return long.join(target, "sample_id")


def left(rows: DataFrame, other: DataFrame) -> DataFrame:
    """All rows, with the columns of the other table where it has the sample."""
    return rows.join(other, "sample_id", "left")


def common(*frames: DataFrame, key: str = "sample_id") -> DataFrame:
    """The keys that every frame has, each once."""
    if not frames:
        raise ValueError("no frames to intersect")
    return reduce(lambda a, b: a.intersect(b), [f.select(key).where(F.col(key).isNotNull()) for f in frames]).distinct()


def restrict(frame: DataFrame, keys: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows whose key is among the given ones."""
    return frame.join(keys.select(key), key, "left_semi")


def missing(features: DataFrame, known: DataFrame, key: str = "feature") -> DataFrame:
    """Keys that the other frame lacks."""
    return features.select(key).distinct().join(known.select(key), key, "left_anti")


def bind(**modalities: DataFrame) -> DataFrame:
    """Matrices side by side: their cells with the name of the modality."""
    named = [f.select("sample_id", F.lit(n).alias("modality"), "feature", "value") for n, f in modalities.items()]
    return reduce(DataFrame.unionByName, named)


def network_and_matrix(edges: DataFrame, long: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The edges among features of the matrix, and the matrix of features of those edges; strict: an error where nodes lack data."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("feature")).distinct()
    have = long.select("feature").distinct()
    if strict and not nodes.join(have, "feature", "left_anti").isEmpty():
        raise ValueError("the network has nodes that the matrix lacks")
    kept = nodes.join(have, "feature", "left_semi")
    inside = restrict(restrict(edges, kept.withColumnRenamed("feature", "src"), "src"), kept.withColumnRenamed("feature", "dst"), "dst")
    return inside, restrict(long, kept, "feature")


def map_keys(rows: DataFrame, mapping: DataFrame, key: str, to: str, order: list[str]) -> DataFrame:
    """rows with the key's name in another table; of several names the first by `order`, of rows with the same name the first too, and rows without one go."""
    first = Window.partitionBy(key).orderBy(*order)
    once = mapping.where(F.col(to).isNotNull()).withColumn("_r", F.row_number().over(first)).where("_r = 1").select(key, to)
    return rows.join(once, key)


def labels_of(spark, labels) -> DataFrame:
    """(sample_id, y) of a frame with these columns, or of (sample, label) pairs or a mapping, as doubles."""
    if isinstance(labels, DataFrame):
        return labels.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("y").cast("double").alias("y"))
    pairs = labels.items() if hasattr(labels, "items") else labels
    return spark.createDataFrame([(str(s), float(y)) for s, y in pairs], "sample_id string, y double")
