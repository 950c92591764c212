"""Pairwise similarity of features and the networks built from it.

Similarities are frames (src, dst, s) with both directions and no diagonal. Up to BLOCK features the cross products are
summed by NumPy over batches of samples, so samples may be very many; beyond that features are cut into blocks, a task
has two blocks, and no array is larger than CELLS. Networks of nearest neighbours keep the best of each pair of blocks
in its task, so not all pairs are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexmat.operators import clean
from plexmat.operators.ranks import order_statistics
from plexmat.plans.iterate import written

#: Features that one task may hold all pairs of, and numbers in an array of samples by features.
BLOCK, CELLS = 1024, 1 << 24
#: Least width of a block; products of parts of the samples that one task adds up.
NARROW, MERGED = 256, 64


def _dense(at: pd.Series, v: pd.Series, width: int) -> np.ndarray:
    """Rows of places and values as a matrix; missing cells are 0."""
    m, sizes = np.zeros((len(at), width)), [len(a) for a in at]
    if sum(sizes):
        m[np.repeat(np.arange(len(at)), sizes), np.concatenate(at.to_numpy())] = np.concatenate(v.to_numpy())
    return m


def _width(long: DataFrame) -> int:
    return (long.agg(F.max("fpos").alias("m")).head()["m"] or 0) + 1


def block_pairs(long: DataFrame, width: int, samples: int | None = None) -> DataFrame:
    """Samples cut into blocks of features, each sent to all pairs of blocks: i, j (i <= j), part, side, sample, at, v.

    samples: how many samples a part of a pair of blocks has at most; without it a pair has all of them.
    """
    blocks = -(-(_width(long)) // width)
    cut = long.where("value is not null").groupBy("sample_id", F.expr(f"fpos div {width}").cast("int").alias("b")).agg(F.collect_list((F.col("fpos") % width).cast("int")).alias("at"), F.collect_list("value").alias("v"))
    if samples is None:
        cut = cut.withColumn("part", F.lit(0))
    else:
        parts = -(-long.agg(F.count_distinct("sample_id")).head()[0] // samples)
        cut = cut.withColumn("part", F.pmod(F.xxhash64("sample_id"), F.lit(max(1, parts))).cast("int"))
    to = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"), F.col("b").alias("side")))
    return cut.select("sample_id", "part", "at", "v", F.inline(to))


def _sides(p: pd.DataFrame, i: int, j: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The two blocks of a pair as matrices over the same samples."""
    at = {s: k for k, s in enumerate(pd.unique(p["sample_id"]))}
    out = []
    for side in (i, j):
        own = p[p["side"] == side]
        m = np.zeros((len(at), width))
        m[own["sample_id"].map(at).to_numpy(int)] = _dense(own["at"], own["v"], width)
        out.append(m)
    return out[0], out[1]


def gram(long: DataFrame, features: int | None = None) -> DataFrame:
    """Sums of products (i, j, p) of all pairs of features i <= j; missing cells count as 0."""
    n = features or _width(long)
    if n > BLOCK:
        def products(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
            i, j = int(key[0]), int(key[1])
            a, b = _sides(p, i, j, BLOCK)
            r, c = np.triu_indices(BLOCK) if i == j else (x.ravel() for x in np.indices((BLOCK, BLOCK)))
            got = (a.T @ b)[r, c]
            inside = (i * BLOCK + r < n) & (j * BLOCK + c < n)
            return pd.DataFrame({"i": (i * BLOCK + r[inside]).astype(np.int32), "j": (j * BLOCK + c[inside]).astype(np.int32), "p": got[inside]})

        cut = block_pairs(long, BLOCK, CELLS // BLOCK)
        return cut.groupBy("i", "j", "part").applyInPandas(products, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p"))
    rows = long.where("value is not null").groupBy("sample_id").agg(F.collect_list("fpos").alias("at"), F.collect_list("value").alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for x in batches:
            m = _dense(x["at"], x["v"], n)
            total += m.T @ m
        i, j = np.triu_indices(n)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "p": total[i, j]})

    return rows.select("at", "v").mapInPandas(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p"))


def centred(long: DataFrame) -> DataFrame:
    """Values less their feature's mean."""
    return clean.per_feature(long, _m=F.avg("value")).withColumn("value", F.col("value") - F.col("_m")).drop("_m")


def _pick(i: int, j: int, r: np.ndarray, there: list[np.ndarray], k: int, shape, digits: int) -> pd.DataFrame:
    """The k best of each feature of either block in the other; there tells which places of the blocks are features."""
    s, width, out = shape(r), len(r), []
    for value, (x, y), (here, others) in ((s, (i, j), there), *(() if i == j else ((s.T, (j, i), there[::-1]),))):
        order = np.where(others[None, :], np.round(value, digits), -np.inf)
        if x == y:
            np.fill_diagonal(order, -np.inf)
        pick = np.argsort(-order, axis=1, kind="stable")[:, :k]
        rows, cols = np.repeat(np.arange(width), pick.shape[1]), pick.ravel()
        good = here[rows] & np.isfinite(order[rows, cols])
        rows, cols = rows[good], cols[good]
        out.append(pd.DataFrame({"src_pos": (x * width + rows).astype(np.int32), "dst_pos": (y * width + cols).astype(np.int32), "s": value[rows, cols]}))
    return pd.concat(out)


def _present(p: pd.DataFrame, side: int, width: int) -> np.ndarray:
    return np.isin(np.arange(width), np.concatenate([*p.loc[p["side"] == side, "at"].to_numpy(), np.zeros(0, int)]))


def _scaled(p: np.ndarray, aa: np.ndarray, bb: np.ndarray) -> np.ndarray:
    return p / np.maximum(np.sqrt(np.outer(aa, bb)), 1e-8)


_PICKED = "src_pos int, dst_pos int, s double"


def _picked_at_once(long: DataFrame, k: int, shape, digits: int, width: int) -> DataFrame:
    """A pair of blocks in one task with all its samples."""
    def best(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[0]), int(key[1])
        a, b = _sides(p, i, j, width)
        return _pick(i, j, _scaled(a.T @ b, (a * a).sum(0), (b * b).sum(0)), [_present(p, side, width) for side in (i, j)], k, shape, digits)

    return block_pairs(long, width).groupBy("i", "j").applyInPandas(best, _PICKED)


def _picked_by_parts(long: DataFrame, k: int, shape, digits: int, width: int) -> DataFrame:
    """A pair of blocks in many tasks, each with some of the samples; their products are added up in rounds, MERGED at a time."""
    schema = "i int, j int, part int, p binary, aa binary, bb binary"

    def products(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[0]), int(key[1])
        a, b = _sides(p, i, j, width)
        # places without a feature are told by a square sum below 0
        aa, bb = (np.where(_present(p, side, width), (m * m).sum(0), -1.0) for side, m in ((i, a), (j, b)))
        return pd.DataFrame({"i": [i], "j": [j], "part": [int(key[2])], "p": [(a.T @ b).tobytes()], "aa": [aa.tobytes()], "bb": [bb.tobytes()]})

    def squares(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return np.where((one < 0) | (two < 0), np.maximum(one, two), one + two)

    def merge(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        total, aa, bb = np.zeros(width * width), np.full(width, -1.0), np.full(width, -1.0)
        for x, y, z in zip(p["p"], p["aa"], p["bb"], strict=True):
            total += np.frombuffer(x)
            aa, bb = squares(aa, np.frombuffer(y)), squares(bb, np.frombuffer(z))
        return pd.DataFrame({"i": [int(key[0])], "j": [int(key[1])], "part": [int(key[2])], "p": [total.tobytes()], "aa": [aa.tobytes()], "bb": [bb.tobytes()]})

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for i, j, p, aa, bb in zip(x["i"], x["j"], x["p"], x["aa"], x["bb"], strict=True):
                aa, bb = np.frombuffer(aa), np.frombuffer(bb)
                r = _scaled(np.frombuffer(p).reshape(width, width), np.maximum(aa, 0), np.maximum(bb, 0))
                yield _pick(i, j, r, [aa >= 0, bb >= 0], k, shape, digits)

    found = written(block_pairs(long, width, CELLS // width).groupBy("i", "j", "part").applyInPandas(products, schema), "part-products")
    while (found.agg(F.max("part")).head()[0] or 0) > 0:
        found = written(found.groupBy("i", "j", F.expr(f"part div {MERGED}")).applyInPandas(merge, schema), "part-products")
    return found.mapInPandas(best, _PICKED)


def nearest_by_blocks(long: DataFrame, k: int, shape=lambda r: r, digits: int = 9) -> DataFrame:
    """The k most similar others of each feature by shape(r), r = p_ij / sqrt(p_ii p_jj): src, dst, src_pos, dst_pos, s.

    Every pair of blocks is compared in one task, which passes on the k best of each feature; the best of all are taken by
    a window over k rows a block. Blocks are as wide as CELLS allows for the number of samples; where that is less than NARROW
    they have that width, and the samples are cut into parts whose products are added up first.
    """
    samples = max(1, long.agg(F.count_distinct("sample_id")).head()[0])
    width = min(2 * BLOCK, CELLS // samples)
    found = _picked_at_once(long, k, shape, digits, width) if width >= NARROW else _picked_by_parts(long, k, shape, digits, NARROW)
    rank = F.row_number().over(Window.partitionBy("src_pos").orderBy(F.desc(F.round("s", digits)), "dst_pos"))
    names = features_of(long)
    top = found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
    top = top.join(names.select(F.col("fpos").alias("src_pos"), F.col("feature").alias("src")), "src_pos").join(names.select(F.col("fpos").alias("dst_pos"), F.col("feature").alias("dst")), "dst_pos")
    return top.select("src", "dst", "src_pos", "dst_pos", "s")


def _named(pairs: DataFrame, names: DataFrame, value: str) -> DataFrame:
    """(i, j, value) with i < j as (src, dst, s) in both directions, with positions."""
    a = names.select(F.col("fpos").alias("i"), F.col("feature").alias("_a"))
    b = names.select(F.col("fpos").alias("j"), F.col("feature").alias("_b"))
    both = pairs.join(a, "i").join(b, "j")
    one = F.struct(F.col("_a").alias("src"), F.col("_b").alias("dst"), F.col("i").alias("src_pos"), F.col("j").alias("dst_pos"))
    two = F.struct(F.col("_b").alias("src"), F.col("_a").alias("dst"), F.col("j").alias("src_pos"), F.col("i").alias("dst_pos"))
    return both.select(F.col(value).alias("s"), F.inline(F.array(one, two))).select("src", "dst", "src_pos", "dst_pos", "s")


def features_of(long: DataFrame) -> DataFrame:
    return long.groupBy("fpos", "feature").agg(F.lit(1).alias("_")).drop("_")


def pearson(long: DataFrame) -> DataFrame:
    """Pearson correlations of centred values, 0 where a feature is constant; missing cells count as the mean."""
    return from_gram(gram(centred(long)), features_of(long))


def from_gram(products: DataFrame, names: DataFrame) -> DataFrame:
    """p_ij / sqrt(p_ii p_jj), the divisor at least 1e-8."""
    norm = products.where("i = j").select(F.col("i").alias("k"), "p")
    pairs = products.where("i < j").join(norm.select(F.col("k").alias("i"), F.col("p").alias("_pi")), "i").join(norm.select(F.col("k").alias("j"), F.col("p").alias("_pj")), "j")
    return _named(pairs.withColumn("r", F.col("p") / F.greatest(F.sqrt(F.col("_pi") * F.col("_pj")), F.lit(1e-8))), names, "r")


def ranks(long: DataFrame) -> DataFrame:
    """Values replaced by their ordinal rank in the feature (ties by sample id)."""
    rank = F.row_number().over(Window.partitionBy("feature").orderBy("value", "sample_id")).cast("double")
    return long.withColumn("value", F.when(F.col("value").isNotNull(), rank))


def spearman(long: DataFrame) -> DataFrame:
    return pearson(ranks(long))


def cosine(long: DataFrame) -> DataFrame:
    return from_gram(gram(long), features_of(long))


def squared_distance(long: DataFrame) -> DataFrame:
    """Squared Euclidean distances of features, as s."""
    products = gram(long)
    norm = products.where("i = j").select(F.col("i").alias("k"), "p")
    pairs = products.where("i < j").join(norm.select(F.col("k").alias("i"), F.col("p").alias("_pi")), "i").join(norm.select(F.col("k").alias("j"), F.col("p").alias("_pj")), "j")
    return _named(pairs.withColumn("d", F.greatest(F.col("_pi") + F.col("_pj") - 2 * F.col("p"), F.lit(0.0))), features_of(long), "d")


def median_distance(distances: DataFrame, names: DataFrame) -> DataFrame:
    """The lower median of the full square of distances, diagonal zeros included (one row, column m)."""
    square = distances.select("s").unionByName(names.select(F.lit(0.0).alias("s")))
    found = order_statistics(square, [], "s", lambda n: F.array(F.floor((n - 1) / 2)))
    return found.select(F.col("values")[0].alias("m"))


def gaussian(long: DataFrame, sigma: float | None = None, eps: float = 0.0, factor: float = 2.0) -> DataFrame:
    """exp(-d^2 / (factor * sigma + eps)); sigma is the median squared distance unless given."""
    d = squared_distance(long)
    if sigma is not None:
        return d.withColumn("s", F.exp(-F.col("s") / (factor * sigma + eps)))
    d = written(d, "distances")
    m = median_distance(d, features_of(long))
    return d.join(F.broadcast(m)).withColumn("s", F.exp(-F.col("s") / (factor * F.col("m") + eps))).drop("m")


def signed(pairs: DataFrame, keep_sign: bool = True) -> DataFrame:
    """(r + 1) / 2, or |r|."""
    return pairs.withColumn("s", (F.col("s") + 1) / 2 if keep_sign else F.abs("s"))


def soft_threshold(pairs: DataFrame, b: float = 6.0) -> DataFrame:
    return pairs.withColumn("s", F.pow(F.abs("s"), F.lit(b)))


# ---- masks and weights ----------------------------------------------------------------------------


def nearest(pairs: DataFrame, k: int = 15, digits: int = 9) -> DataFrame:
    """The k most similar others of each node; ties, after rounding, by position."""
    order = F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.round("s", digits)), "dst_pos"))
    return pairs.withColumn("_r", order).where(F.col("_r") <= k).drop("_r")


def strongest(pairs: DataFrame, k: int = 15) -> DataFrame:
    """Entries of at least the value just below the k * N strongest of all (so a few more than that many)."""
    pairs = written(pairs, "pairs")
    size = pairs.agg(F.count_distinct("src").alias("n"), F.count("s").alias("all")).head()
    if size["all"] <= k * size["n"]:
        return pairs
    found = order_statistics(pairs, [], "s", lambda n: F.array(n - 1 - k * size["n"]))
    cut = found.select(F.col("values")[0].alias("_cut"))
    return pairs.join(F.broadcast(cut), how="left").where(F.col("_cut").isNull() | (F.col("s") >= F.col("_cut"))).drop("_cut")


def weakest_cut(pairs: DataFrame, names: DataFrame, k: int = 15, self_similarity: float = 1.0) -> DataFrame:
    """The compatible cut of the similarity network: entries of at least the (k * N)-th smallest of all N squared."""
    n, pairs = names.count(), written(pairs, "pairs")
    every = pairs.select("s").unionByName(names.select(F.lit(self_similarity).alias("s")))
    found = order_statistics(every, [], "s", lambda held: F.filter(F.array(F.lit(k * n - 1)), lambda r: r < held))
    cut = found.where(F.size("values") > 0).select(F.col("values")[0].alias("_cut"))
    return pairs.join(F.broadcast(cut)).where(F.col("s") >= F.col("_cut")).drop("_cut")


def at_least(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.where(F.col("s") >= threshold)


def mutual(pairs: DataFrame) -> DataFrame:
    """Entries whose reverse is there too."""
    return pairs.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi")


def finish(pairs: DataFrame, names: DataFrame, self_loops: bool = False, normalize: bool = True) -> DataFrame:
    """Edges (src, dst, weight), with loops of weight 1 and rows summing to 1 on demand."""
    edges = pairs.select("src", "dst", F.col("s").alias("weight"))
    if self_loops:
        edges = edges.unionByName(names.select(F.col("feature").alias("src"), F.col("feature").alias("dst"), F.lit(1.0).alias("weight")))
    if normalize:
        total = F.sum(F.abs("weight")).over(Window.partitionBy("src"))
        edges = edges.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(0.0))
    return edges


def _check(long: DataFrame) -> None:
    if not isinstance(long, DataFrame):
        raise TypeError("a DataFrame in long form is asked for")


def similarity_network(long: DataFrame, k: int = 15, metric: str = "cosine", mutual_only: bool = False, per_node: bool = True, self_loops: bool = False, normalize: bool = True, compat: bool = False) -> DataFrame:
    """Cosine or Gaussian similarity, k nearest or a global cut."""
    _check(long)
    names = features_of(long)
    if metric == "cosine" and per_node and _width(long) > BLOCK:
        pairs = nearest_by_blocks(long, k)
        return finish(mutual(pairs) if mutual_only else pairs, names, self_loops, normalize)
    pairs = cosine(long) if metric == "cosine" else gaussian(long, eps=1e-8, factor=1.0)
    pairs = nearest(pairs, k) if per_node else weakest_cut(pairs, names, k) if compat else strongest(pairs, k)
    return finish(mutual(pairs) if mutual_only else pairs, names, self_loops, normalize)


def correlation_network(long: DataFrame, k: int | None = 15, method: str = "pearson", signed_map: bool = True, normalize: bool = True, mutual_only: bool = False, per_node: bool = True, threshold: float | None = None, self_loops: bool = False) -> DataFrame:
    """Pearson or Spearman; k nearest, a threshold, a global cut, or (without k and threshold) every pair."""
    _check(long)
    if k is None and threshold is not None and per_node:
        raise ValueError("a threshold is global: set per_node to False")
    if k is not None and per_node and _width(long) > BLOCK:
        shape = (lambda r: (r + 1) / 2) if signed_map else np.abs
        pairs = nearest_by_blocks(centred(ranks(long) if method == "spearman" else long), k, shape)
        return finish(mutual(pairs) if mutual_only else pairs, features_of(long), self_loops, normalize)
    pairs = signed(spearman(long) if method == "spearman" else pearson(long), signed_map)
    if k is not None or threshold is not None:
        pairs = nearest(pairs, k) if per_node else at_least(pairs, threshold) if threshold is not None else strongest(pairs, k)
    return finish(mutual(pairs) if mutual_only else pairs, features_of(long), self_loops, normalize)


def threshold_network(long: DataFrame, b: float = 6.0, k: int = 15, mutual_only: bool = False, self_loops: bool = False, normalize: bool = True) -> DataFrame:
    """Soft-thresholded correlations, k nearest."""
    _check(long)
    pairs = nearest_by_blocks(centred(long), k, lambda r: np.abs(r) ** b) if _width(long) > BLOCK else nearest(soft_threshold(pearson(long), b), k)
    return finish(mutual(pairs) if mutual_only else pairs, features_of(long), self_loops, normalize)


def gaussian_knn_network(long: DataFrame, k: int = 15, sigma: float | None = None, mutual_only: bool = False, self_loops: bool = True, normalize: bool = True) -> DataFrame:
    """A Gaussian kernel of squared distance, k nearest."""
    _check(long)
    pairs = nearest(gaussian(long, sigma), k)
    return finish(mutual(pairs) if mutual_only else pairs, features_of(long), self_loops, normalize)


#: Builders by name.
BUILDERS = {"similarity": similarity_network, "correlation": correlation_network, "threshold": threshold_network, "gaussian": gaussian_knn_network}


def profile_correlation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pearson correlation of nodes' adjacency columns, zeros included; constant columns give 0.

    The columns are a matrix of nodes by nodes, mostly zeros, whose products are taken as those of features are.
    """
    place = nodes.select(F.col("node").alias("dst"), F.col("npos").alias("fpos"))
    cells = edges.groupBy("src", "dst").agg(F.sum("weight").alias("value")).join(place, "dst").select(F.col("src").alias("sample_id"), "fpos", "value")
    size = nodes.agg(F.count("*").alias("n"), F.max("npos").alias("m")).head()
    n = float(size["n"])
    products = gram(cells, (size["m"] or 0) + 1)
    sums = cells.groupBy("fpos").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"))
    full = nodes.select(F.col("npos").alias("fpos"), "node").join(sums, "fpos", "left").na.fill(0.0)
    a, b = (full.select(F.col("fpos").alias(p), F.col("node").alias(f"_{p}"), F.col("s").alias(f"s{p}"), F.col("q").alias(f"q{p}")) for p in "ij")
    both = products.where("i < j").join(a, "i").join(b, "j")
    var = F.sqrt((n * F.col("qi") - F.col("si") ** 2) * (n * F.col("qj") - F.col("sj") ** 2))
    r = F.coalesce((n * F.col("p") - F.col("si") * F.col("sj")) / F.when(var > 1e-12, var), F.lit(0.0))
    ways = F.array(F.struct(F.col("_i").alias("src"), F.col("_j").alias("dst")), F.struct(F.col("_j").alias("src"), F.col("_i").alias("dst")))
    return both.select(r.alias("s"), F.inline(ways)).select("src", "dst", "s")
