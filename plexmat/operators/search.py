"""Networks of many settings at once: one table of similarities, all masks of all settings by windows, scores by groups.

Each kind of similarity that some setting needs is computed once; a setting turns it into its own weights by an expression
over the setting's columns, so the number of jobs does not depend on the number of settings. Centralities and components of all
networks run in the same rounds, told apart by `config`.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexmat.functions import special
from plexmat.operators import ridge, similarity
from plexmat.plans.iterate import packed, per_run, unpacked, written

_SETTING = "config int, kind string, shape string, k int, sigma double, b double, signed boolean, mutual boolean"
#: What a setting of each method may hold, besides the method.
_KNOWN = {
    "gaussian": {"k", "sigma", "mutual_only"},
    "similarity": {"k", "metric", "mutual_only"},
    "correlation": {"k", "by", "signed_map", "mutual_only"},
    "threshold": {"k", "b", "mutual_only"},
}


def plan_of(config: int, setting: dict[str, Any]) -> tuple:
    """A row of the settings table; what a setting may not say is an error."""
    own = dict(setting)
    method = own.pop("method", None)
    if method not in _KNOWN or set(own) - _KNOWN[method]:
        raise ValueError(f"not a setting of a network of nearest neighbours: {setting}")
    k, mutual = int(own.get("k", 15)), bool(own.get("mutual_only", False))
    sigma, b, signed = own.get("sigma"), float(own.get("b", 6.0)), bool(own.get("signed_map", True))
    if k < 1:
        raise ValueError(f"no neighbours are asked for: {setting}")
    if method == "correlation":
        if own.get("by", "pearson") not in ("pearson", "spearman"):
            raise ValueError(f"unknown correlation: {setting}")
        return config, own.get("by", "pearson"), "correlation", k, None, None, signed, mutual
    if method == "threshold":
        return config, "pearson", "power", k, None, b, None, mutual
    if method == "similarity" and own.get("metric", "cosine") == "cosine":
        return config, "cosine", "as it is", k, None, None, None, mutual
    if method == "similarity" and own["metric"] != "gaussian":
        raise ValueError(f"unknown metric: {setting}")
    return config, "distance", "gaussian" if method == "gaussian" else "kernel", k, None if sigma is None else float(sigma), None, None, mutual


def _pairs(long: DataFrame, kinds: set[str]) -> tuple[DataFrame, float]:
    """(kind, src, dst, dst_pos, v) of all kinds, and the median squared distance."""
    make = {"pearson": similarity.pearson, "spearman": similarity.spearman, "cosine": similarity.cosine, "distance": similarity.squared_distance}
    frames = [make[kind](long).select(F.lit(kind).alias("kind"), "src", "dst", "dst_pos", F.col("s").alias("v")) for kind in sorted(kinds)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    out = written(out, "search-pairs")
    median = 1.0
    if "distance" in kinds:
        distances = out.where("kind = 'distance'").select(F.col("v").alias("s"))
        median = float(similarity.median_distance(distances, similarity.features_of(long)).head()["m"] or 0.0)
    return out, median


def networks(long: DataFrame, settings: DataFrame, kinds: set[str]) -> DataFrame:
    """Edges (config, src, dst, weight) of every setting: its k nearest, mutual ones on demand, rows summing to 1."""
    pairs, median = _pairs(long, kinds)
    r, m = F.col("v"), F.lit(median)
    s = (
        F.when(F.col("shape") == "correlation", F.when(F.col("signed"), (r + 1) / 2).otherwise(F.abs(r)))
        .when(F.col("shape") == "power", F.pow(F.abs(r), F.col("b")))
        .when(F.col("shape") == "gaussian", F.exp(-r / (2 * F.coalesce("sigma", m))))
        .when(F.col("shape") == "kernel", F.exp(-r / (m + 1e-8)))
        .otherwise(r)
    )
    every = pairs.join(F.broadcast(settings), "kind").select("config", "src", "dst", "dst_pos", "k", "mutual", s.alias("s"))
    place = F.row_number().over(Window.partitionBy("config", "src").orderBy(F.desc(F.round("s", 9)), "dst_pos"))
    near = written(every.withColumn("_r", place).where(F.col("_r") <= F.col("k")).select("config", "src", "dst", "mutual", "s"), "search-near")
    back = near.where("mutual").select("config", F.col("src").alias("dst"), F.col("dst").alias("src"))
    kept = near.where("not mutual").unionByName(near.where("mutual").join(back, ["config", "src", "dst"], "left_semi"))
    total = F.sum(F.abs("s")).over(Window.partitionBy("config", "src"))
    return written(kept.select("config", "src", "dst", F.when(total > 0, F.col("s") / total).otherwise(0.0).alias("weight")), "search-edges")


def centralities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(config, node, score): the leading eigenvector of A + I of every undirected network, of length 1."""
    one = edges.groupBy("config", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))
    both = written(one.unionByName(one.where("src <> dst").select("config", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "search-both")
    rank = both.select("config", F.col("src").alias("node")).distinct().withColumn("score", F.lit(1.0))

    def unit(x: DataFrame) -> DataFrame:
        length = x.groupBy("config").agg(F.sqrt(F.sum(F.col("score") ** 2)).alias("_l"))
        return x.join(length, "config").select("config", "node", (F.col("score") / F.col("_l")).alias("score"))

    for i in range(rounds):
        got = both.join(rank.select("config", F.col("node").alias("src"), "score"), ["config", "src"]).groupBy("config", F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("score")).alias("in"))
        rank = rank.join(got, ["config", "node"], "left").select("config", "node", (F.col("score") + F.coalesce("in", F.lit(0.0))).alias("score"))
        if i % 5 == 4:
            rank = written(unit(rank), "search-rank")
    return unit(rank)


def topology(edges: DataFrame, n_nodes: int) -> DataFrame:
    """(config, quality): half the share of nodes with an edge plus half the share of the largest component, of every network."""
    e = edges.where("weight > 0")
    linked = e.groupBy("config").agg(F.count_distinct("src").alias("linked"))
    loose = e.where("src <> dst").select("config", "src", "dst")
    both = written(loose.unionByName(loose.select("config", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "search-ends")
    labels = both.select("config", F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        near = both.join(labels.select("config", F.col("node").alias("dst"), "label"), ["config", "dst"]).groupBy("config", F.col("src").alias("node")).agg(F.min("label").alias("_near"))
        step = labels.join(near, ["config", "node"]).select("config", "node", F.least("label", "_near").alias("label"), F.col("label").alias("was"))
        jump = step.join(labels.select("config", F.col("node").alias("label"), F.col("label").alias("_far")), ["config", "label"], "left")
        labels = written(jump.select("config", "node", F.least("label", F.coalesce("_far", "label")).alias("label"), "was"), "search-labels")
        if labels.where("label <> was").isEmpty():
            break
        labels = labels.select("config", "node", "label")
    largest = labels.groupBy("config", "label").agg(F.count("*").alias("n")).groupBy("config").agg(F.max("n").alias("largest"))
    n = float(max(n_nodes, 1))
    share = 0.5 * F.coalesce("linked", F.lit(0)) / n + 0.5 * F.greatest(F.coalesce("largest", F.lit(1)), F.lit(1)) / n
    return edges.select("config").distinct().join(linked, "config", "left").join(largest, "config", "left").select("config", share.alias("quality"))


def proxies(long: DataFrame, target: DataFrame, central: DataFrame, score) -> DataFrame:
    """(config, f1): how well features, weighted by log(1 + centrality), tell the phenotype; null where that fails.

    `ridge` adds up what classifiers need over the samples; where it can't (very many features or classes), a task takes a setting and all samples."""
    weighed = central.groupBy("config").agg(F.sort_array(F.collect_list(F.struct(F.col("node").alias("feature"), F.log1p(F.greatest("score", F.lit(0.0))).alias("c")))).alias("given"))
    runs = weighed.select("config", F.col("given.feature").alias("names"), F.col("given.c").alias("c"))
    data, every = packed(long, target)
    data = written(data, "search-rows")
    # a column that is standardised doesn't tell its weight, only whether it has one
    found = ridge.macro_f1(data, every, [(r["config"], [c["feature"] for c in r["given"] if c["c"] > 0]) for r in weighed.toLocalIterator()])
    if found is not None:
        return found

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        names, c = list(p["names"].iloc[0]), np.asarray(p["c"].iloc[0])
        cells, y, _ = unpacked(p, len(every))
        at = {f: i for i, f in enumerate(every)}
        x = np.column_stack([cells[:, at[f]] if f in at else np.zeros(len(y)) for f in names])
        try:
            f1 = score(special.zscore(x * c), y)
        except np.linalg.LinAlgError:
            f1 = None
        return pd.DataFrame({"config": [int(key[0])], "f1": pd.Series([f1], dtype="float64")})

    return per_run(data, runs, ["config"], run, "config int, f1 double", 2 * len(every))


def search(long: DataFrame, target: DataFrame, rows: list[tuple], weight: float, score) -> DataFrame:
    """(config, score, f1, topology) of the settings (rows of plan_of)."""
    settings = written(long.sparkSession.createDataFrame(rows, _SETTING), "search-settings")
    edges = networks(long, settings, {r[1] for r in rows})
    quality = topology(edges, similarity.features_of(long).count())
    found = quality.join(proxies(long, target, written(centralities(edges), "search-central"), score), "config").where("f1 is not null")
    whole = (1 - weight) * F.col("f1") + weight * F.least(F.greatest("quality", F.lit(0.0)), F.lit(1.0))
    return found.select("config", whole.alias("score"), "f1", F.col("quality").alias("topology"))
