"""Complete linkage on a sparse similarity: all pairs of clusters that are each other's nearest merge in the same round.

Distances are 1 - s, and 1 where a pair has no edge. Merging two clusters never brings the result nearer to a third one than the nearer of the
two was, so pairs that are nearest to each other are merged at some time in whatever order it goes on, and rounds give the same clusters as
one merge at a time. Of equal distances the pair of lower leaves counts as nearer, as in the sequential form.

A round relabels edges by joins and takes the largest distance of each pair of new clusters; a pair in which some edge is missing is at
distance 1 and is dropped, so edges only become fewer. No square of features by features is held anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexmat.plans.iterate import placed, written


def nearest_pairs(edges: DataFrame) -> DataFrame:
    """Clusters a < b that are each other's nearest: (a, b). edges: (a, b, d) in both directions."""
    order = F.struct("d", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    best = edges.groupBy("a").agg(F.min_by("b", order).alias("b"))
    back = best.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return best.join(back, ["a", "b"], "left_semi").where("a < b")


def merged(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges among the clusters after the pairs have merged, each named by its lower leaf."""
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("old"), F.col("a").alias("new")), F.struct(F.col("b").alias("old"), F.col("a").alias("new")))))
    for side in ("a", "b"):
        named = both.select(F.col("old").alias(side), F.col("new").alias(f"_{side}"))
        edges = edges.join(named, side, "left").withColumns({f"_parts_{side}": F.when(F.col(f"_{side}").isNull(), 1).otherwise(2), side: F.coalesce(f"_{side}", side)}).drop(f"_{side}")
    found = edges.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("d").alias("d"), F.max(F.col("_parts_a") * F.col("_parts_b")).alias("whole"))
    return found.where("n = whole").select("a", "b", "d")


def clusters(sim: DataFrame, cut: float = 1 - 1e-10) -> tuple[DataFrame, int]:
    """(fpos, cluster) of all features in edges below the cut, a cluster being named by its lowest feature; and the rounds it took."""
    edges = written(sim.select("a", "b", F.greatest(1 - F.col("s"), F.lit(0.0)).alias("d")).where(F.col("d") < cut), "linkage-edges")
    members = written(edges.select(F.col("a").alias("fpos")).distinct().select("fpos", F.col("fpos").alias("cluster")), "linkage-members")
    rounds = 0
    while True:
        pairs = written(nearest_pairs(edges), "linkage-pairs")
        if pairs.isEmpty():
            return members, rounds
        members = written(members.join(pairs.select(F.col("b").alias("cluster"), F.col("a").alias("_to")), "cluster", "left").select("fpos", F.coalesce("_to", "cluster").alias("cluster")), "linkage-members")
        edges = written(merged(edges, pairs), "linkage-edges")
        rounds += 1


def modules(sim: DataFrame, cut: float = 1 - 1e-10) -> DataFrame:
    """(module, fpos) of clusters of two or more features at the cut, numbered from 0 by their lowest feature."""
    members, _ = clusters(sim, cut)
    kept = members.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    number = placed(kept, [], F.floor(F.col("cluster") / 4096), [F.col("cluster")], out="module")
    return members.join(number, "cluster").select(F.col("module").cast("long").alias("module"), F.col("fpos").cast("int").alias("fpos"))
