"""Network analytics over edge lists. An edge counts where its weight is above a threshold (strictly); entries are directed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexmat.operators import ranks
from plexmat.plans.iterate import placed, saved, written


def above(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.where(F.col("weight") > threshold).select("src", "dst", "weight")


def with_modality(nodes: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Modality of each node: from a lookup (node, modality), else the name up to the first underscore."""
    if lookup is None:
        return nodes.withColumn("modality", F.substring_index("node", "_", 1))
    last = lookup.groupBy("node").agg(F.last("modality").alias("modality"))
    return nodes.drop("modality").join(F.broadcast(last), "node", "left").withColumn("modality", F.coalesce("modality", F.lit("Unknown")))


def degrees(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Out-degree of every node, 0 for those without edges."""
    out = above(edges, threshold).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.join(out, "node", "left").na.fill(0, ["degree"])


def basic(edges: DataFrame, nodes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Nodes, edges (directed entries halved), density, mean and largest degree, isolated nodes."""
    d = degrees(edges, nodes, threshold)
    n, e = F.count("*"), F.sum("degree") / 2
    return d.agg(n.alias("nodes"), e.alias("edges"), F.coalesce(e / F.nullif(n * (n - 1) / 2, F.lit(0.0)), F.lit(0.0)).alias("density"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("isolated"))


def degree_distribution(edges: DataFrame, nodes: DataFrame, threshold: float = 0.5) -> DataFrame:
    d = degrees(edges, nodes, threshold).groupBy("degree").agg(F.count("*").alias("n"))
    return d.select("degree", "n", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("pct")).orderBy("degree")


def hubs(edges: DataFrame, nodes: DataFrame, threshold: float = 0.5, top: int = 10) -> DataFrame:
    """The nodes of highest degree, ties by position."""
    d = degrees(edges, nodes, threshold).orderBy(F.desc("degree"), "npos").limit(top)
    return d.select(F.row_number().over(Window.orderBy(F.desc("degree"), "npos")).alias("rank"), "node", "modality", "degree")


def clustering(edges: DataFrame, nodes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of each node with two or more neighbours, the share of neighbour pairs that are linked; 0 for others.

    Triangles are found from their end of lowest degree, so that a hub's pairs of neighbours are never listed; what directions
    the three edges have decides what a triangle adds to each of its ends.
    """
    e = above(edges, threshold).where("src <> dst").select("src", "dst").distinct()
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    e = e.join(ends.select(F.col("node").alias("src"), F.struct("n", F.col("node").alias("v")).alias("s")), "src").join(ends.select(F.col("node").alias("dst"), F.struct("n", F.col("node").alias("v")).alias("d")), "dst")
    up = F.col("s") < F.col("d")
    pair = e.select(F.least("s", "d")["v"].alias("lo"), F.greatest("s", "d")["v"].alias("hi"), up.alias("up"))
    pair = pair.groupBy("lo", "hi").agg(F.bool_or("up").cast("int").alias("up"), F.bool_or(~F.col("up")).cast("int").alias("down"))

    def side(a: str, b: str) -> DataFrame:
        return pair.select(F.col("lo").alias(a), F.col("hi").alias(b), F.col("up").alias(a + b), F.col("down").alias(b + a))

    found = side("a", "b").join(side("a", "c"), "a").join(side("b", "c"), ["b", "c"])
    adds = [F.struct(F.col(v).alias("node"), (F.col(v + x) * F.col(v + y) * (F.col(x + y) + F.col(y + x))).alias("n")) for v, x, y in (("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b"))]
    links = found.select(F.inline(F.array(*adds))).groupBy("node").agg(F.sum("n").alias("links"))
    k = degrees(edges.where("src <> dst"), nodes, threshold)
    pairs = F.col("degree") * (F.col("degree") - 1)
    return k.join(links, "node", "left").select("node", F.coalesce(F.when(F.col("degree") >= 2, F.coalesce("links", F.lit(0)) / F.nullif(pairs, F.lit(0))), F.lit(0.0)).alias("coefficient"))


def cross_modality(edges: DataFrame, nodes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Edges, possible edges and density within each modality (entries halved) and between each ordered pair of them."""
    m = nodes.select("node", "modality")
    e = above(edges, threshold).join(m.select(F.col("node").alias("src"), F.col("modality").alias("m1")), "src").join(m.select(F.col("node").alias("dst"), F.col("modality").alias("m2")), "dst").groupBy("m1", "m2").agg(F.count("*").alias("n"))
    size = m.groupBy("modality").agg(F.count("*").alias("k"))
    grid = size.select(F.col("modality").alias("m1"), F.col("k").alias("k1")).join(size.select(F.col("modality").alias("m2"), F.col("k").alias("k2")), F.col("m1") <= F.col("m2"))
    same = F.col("m1") == F.col("m2")
    most = F.when(same, F.col("k1") * (F.col("k1") - 1) / 2).otherwise(F.col("k1") * F.col("k2")).cast("double")
    count = F.coalesce("n", F.lit(0)) * F.when(same, 0.5).otherwise(1.0)
    return grid.join(e, ["m1", "m2"], "left").select("m1", "m2", count.alias("edges"), most.alias("possible"), F.coalesce(count / F.nullif(most, F.lit(0.0)), F.lit(0.0)).alias("density"))


def upper(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries above the diagonal, by position."""
    pos = nodes.select("node", "npos")
    e = edges.join(pos.select(F.col("node").alias("src"), F.col("npos").alias("src_pos")), "src").join(pos.select(F.col("node").alias("dst"), F.col("npos").alias("dst_pos")), "dst")
    return e.where("src_pos < dst_pos")


_ABOVE = {f"above_{str(t).replace('.', '_')}": t for t in (0.001, 0.1, 0.3, 0.5, 0.7, 0.8, 0.9)}


def edge_weights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distribution of the positive weights above the diagonal."""
    e, w = upper(edges, nodes).where("weight > 0"), F.col("weight")
    at = (25, 50, 75, 90, 95, 99)
    e = written(e.select("weight"), "weights")
    found = ranks.quantiles(e, [], "weight", [p / 100 for p in at])
    cuts = [F.col("quantiles")[i].alias(f"p{p}") for i, p in enumerate(at)]
    counts = [F.count_if(w > t).alias(name) for name, t in _ABOVE.items()]
    return e.agg(F.count("*").alias("n"), F.avg(w).alias("mean"), F.stddev_pop(w).alias("std"), F.min(w).alias("min"), F.max(w).alias("max"), *counts).join(F.broadcast(found.select("quantiles")), how="left").select("n", "mean", "std", F.col("quantiles")[1].alias("median"), "min", "max", *cuts, *_ABOVE)


def strongest_edges(edges: DataFrame, nodes: DataFrame, top: int = 50) -> DataFrame:
    return upper(edges, nodes).orderBy(F.desc(F.round("weight", 9)), "src_pos", "dst_pos").limit(top).select("src", "dst", "weight")


def components(edges: DataFrame, nodes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(node, component), numbered from 0 by lowest position; lowest labels spread over edges and are followed up."""
    e = above(edges, threshold).where("src <> dst").select("src", "dst")
    pos = nodes.select("node", "npos")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = saved(both.join(pos.select(F.col("node").alias("src"), F.col("npos").alias("a")), "src").join(pos.select(F.col("node").alias("dst"), F.col("npos").alias("b")), "dst").select("a", "b"))
    labels = saved(pos.select("npos", F.col("npos").alias("label")))
    while True:
        near = both.join(labels.select(F.col("npos").alias("b"), "label"), "b").groupBy(F.col("a").alias("npos")).agg(F.min("label").alias("_near"))
        step = labels.join(near, "npos", "left").select("npos", F.least("label", F.coalesce("_near", "label")).alias("label"), F.col("label").alias("was"))
        jump = step.join(labels.select(F.col("npos").alias("label"), F.col("label").alias("_far")), "label", "left")
        labels = saved(jump.select("npos", F.least("label", F.coalesce("_far", "label")).alias("label"), "was"))
        if labels.where("label <> was").isEmpty():
            break
        labels = labels.select("npos", "label")
    number = placed(labels.select("label").distinct(), [], F.floor(F.col("label") / 4096), [F.col("label")], out="component")
    return labels.join(number, "label").join(pos, "npos").select("node", F.col("component").cast("int").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component")


def topology_quality(edges: DataFrame, nodes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Half the share of nodes with edges plus half the share of the largest component."""
    linked = degrees(edges, nodes, threshold).agg(F.avg(F.when(F.col("degree") > 0, 1.0).otherwise(0.0)).alias("linked"), F.count("*").alias("n"))
    largest = component_sizes(components(edges, nodes, threshold)).agg(F.max("size").alias("largest"))
    return linked.join(largest).select((0.5 * F.col("linked") + 0.5 * F.col("largest") / F.col("n")).alias("quality"))


def smoothed(long: DataFrame, edges: DataFrame) -> DataFrame:
    """Features smoothed along a network: x + x D^-1/2 A D^-1/2, over features."""
    deg = edges.groupBy("src").agg(F.sum("weight").alias("d")).where("d > 0")
    norm = edges.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst").select("src", "dst", (F.col("weight") / F.sqrt(F.col("d") * F.col("d2"))).alias("w"))
    norm = written(norm, "smoothing")
    if norm.select("src").distinct().count() > SMOOTHED:
        moved = long.join(norm, F.col("feature") == F.col("src")).groupBy("sample_id", F.col("dst").alias("feature")).agg(F.sum(F.col("value") * F.col("w")).alias("_add"))
        return long.join(moved, ["sample_id", "feature"], "left").select("sample_id", "fpos", "feature", (F.col("value") + F.coalesce("_add", F.lit(0.0))).alias("value"))
    # a sample's cells come together once; what they send to each other stays in their task
    rows = written(long.groupBy("sample_id").agg(F.collect_list(F.struct("fpos", "feature", "value")).alias("_c")), "smoothing-rows").repartition("sample_id")
    sent = rows.select("sample_id", F.inline("_c")).join(F.broadcast(norm), F.col("feature") == F.col("src")).groupBy("sample_id", "dst").agg(F.sum(F.col("value") * F.col("w")).alias("_add"))
    adds = sent.where("_add is not null").groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("dst", "_add"))).alias("_adds"))
    own = rows.join(adds, "sample_id", "left").select("sample_id", "_adds", F.inline("_c"))
    return own.select("sample_id", "fpos", "feature", (F.col("value") + F.coalesce(F.col("_adds")[F.col("feature")], F.lit(0.0))).alias("value"))


#: Nodes up to which a network is handed to all tasks that smooth along it.
SMOOTHED = 1024


def node_table(edges: DataFrame, nodes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Nodes left after weak edges go, numbered by descending degree in the undirected network."""
    kept = edges.where(F.abs("weight") >= threshold) if threshold > 0 else edges
    ends = kept.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = ends.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    found = written(nodes.join(deg, "node").select("npos", "node", "modality", "degree"), "node-table")
    row = placed(found, [], F.struct(-F.col("degree"), F.floor(F.col("npos") / 4096)), [F.col("npos")], out="index")
    return row.select((F.col("index") + 1).cast("int").alias("index"), "node", "modality", "degree")
