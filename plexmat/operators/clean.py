"""Cleaning, imputing, scaling and pruning of matrices and networks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexmat.operators import ranks
from plexmat.plans.iterate import written

_INF = float("inf")


def per_feature(long: DataFrame, **stats) -> DataFrame:
    """long with aggregates of its feature, one shuffle of the aggregates rather than of the cells."""
    return long.join(long.groupBy("feature").agg(*[c.alias(n) for n, c in stats.items()]), "feature")


def beta_to_m(long: DataFrame, eps: float = 1e-6) -> DataFrame:
    """log2(b / (1 - b)) of values clipped to [eps, 1 - eps]; text is cast, and what is no number is missing."""
    v = F.col("value").try_cast("double")
    b = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(eps)), F.lit(1 - eps)))
    return long.withColumn("value", F.log2(b / (1 - b)))


def impute_simple(long: DataFrame, method: str = "mean") -> DataFrame:
    """Missing cells filled by the feature's mean or median, or by zero."""
    if method == "zero":
        return long.na.fill(0.0, ["value"])
    if method not in ("mean", "median"):
        raise ValueError(f"unknown method {method!r}")
    if method == "mean":
        return per_feature(long, _fill=F.avg("value")).withColumn("value", F.coalesce("value", "_fill")).drop("_fill")
    gaps = long.where("value is null").select("feature").distinct()
    if gaps.isEmpty():
        return long
    fill = ranks.medians(long.join(gaps, "feature", "left_semi"), ["feature"], "value", "_fill")
    return long.join(fill, "feature", "left").select("feature", *[F.coalesce("value", "_fill").alias(c) if c == "value" else c for c in long.columns if c != "feature"])


#: Groups of blocks with gaps, numbers in a group of donors, and numbers that are compared exactly at once.
GROUPS, CELLS, EXACT = 24, 1 << 22, 1 << 20


class _Gaps:
    """The samples of a block and, for each cell that one lacks, its k nearest donors so far: distance, rank of the id, and value."""

    def __init__(self, x: np.ndarray, own: np.ndarray, k: int):
        self.x, self.own, self.there = x, own, ~np.isnan(x)
        self.row, self.col = np.nonzero(~self.there)
        self.at = np.full(x.shape, -1)
        self.at[self.row, self.col] = np.arange(len(self.row))
        n = len(self.row)
        self.dist, self.who, self.given = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.nan)

    def distances(self, r: np.ndarray, c: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of rows r and donors c, which broadcast, over the features that both have; infinite without any."""
        square, both = np.zeros(np.broadcast_shapes(r.shape, c.shape)), np.zeros(np.broadcast_shapes(r.shape, c.shape))
        for f in range(y.shape[1]):
            d = self.x[r, f] - y[c, f]
            there = ~np.isnan(d)
            square += np.where(there, d * d, 0.0)
            both += there
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.round(np.sqrt(np.where(both > 0, y.shape[1] / both * square, np.inf)), 9)

    def take(self, gap: np.ndarray, dist: np.ndarray, who: np.ndarray, given: np.ndarray) -> None:
        good = dist <= self.dist[gap, -1]
        good &= np.isfinite(dist)
        gap, dist, who, given = gap[good], dist[good], who[good], given[good]
        if not len(gap):
            return
        order = np.lexsort((who, dist, gap))
        gap, dist, who, given = gap[order], dist[order], who[order], given[order]
        gaps, start, place = np.unique(gap, return_index=True, return_inverse=True)
        nth, k = np.arange(len(gap)) - start[place], self.dist.shape[1]
        own = nth < k
        more = [np.full((len(gaps), k), v) for v in (np.inf, np.iinfo(np.int64).max, np.nan)]
        for m, v in zip(more, (dist, who, given), strict=True):
            m[place[own], nth[own]] = v[own]
        both = [np.hstack([m[gaps], n]) for m, n in zip((self.dist, self.who, self.given), more, strict=True)]
        pick = np.lexsort((both[1], both[0]), axis=1)[:, :k]
        for m, n in zip((self.dist, self.who, self.given), both, strict=True):
            m[gaps] = np.take_along_axis(n, pick, 1)

    def meet(self, y: np.ndarray, rank: np.ndarray, wide: np.ndarray) -> None:
        """Takes in a block of donors; wide: their presence, squares and values side by side, 0 where missing."""
        there, open_ = ~np.isnan(y), ~np.isfinite(self.dist[:, -1])
        limit = np.full(len(self.x), -1.0)
        np.maximum.at(limit, self.row[~open_], self.dist[~open_, -1])
        if open_.any():  # gaps with fewer donors than k so far, as all have at first
            cols = np.flatnonzero(there[:, np.unique(self.col[open_])].any(1))
            rows = np.unique(self.row[open_])
            part = max(1, EXACT // max(1, len(cols)))
            for i in range(0, len(rows) if len(cols) else 0, part):
                own = rows[i : i + part]
                d = self.distances(own[:, None], cols[None, :], y)
                d[self.own[own][:, None] == rank[cols][None, :]] = np.inf
                for f in np.unique(self.col[open_]):
                    have = np.flatnonzero(there[cols, f])
                    gap = self.at[own, f]
                    need = np.flatnonzero((gap >= 0) & open_[gap])
                    if len(need) and len(have):
                        sub = d[np.ix_(need, have)]
                        pick = np.argsort(sub, axis=1, kind="stable")[:, : self.dist.shape[1]]
                        c = cols[have[pick]]
                        self.take(np.repeat(gap[need], pick.shape[1]), np.take_along_axis(sub, pick, 1).ravel(), rank[c].ravel(), y[c, f].ravel())
        rows = np.flatnonzero(limit >= 0)
        if not len(rows):
            return
        x, m = np.nan_to_num(self.x[rows]), self.there[rows].astype(float)
        least = (limit[rows] + 2e-9) ** 2 / y.shape[1]
        # the square of a distance less what a donor among the k nearest may have
        test = np.hstack([x * x - least[:, None] * m, m, -2 * x]) @ wide.T
        slack = 1e-12 * ((x * x).sum(1) + least * y.shape[1] + (wide * wide).sum(1).max(initial=0.0))
        r, c = np.divmod(np.flatnonzero(test <= slack[:, None]), len(y))
        step = max(1, EXACT // max(1, y.shape[1]))
        for i in range(0, len(r), step):
            own, donor = rows[r[i : i + step]], c[i : i + step]
            d = self.distances(own, donor, y)
            good = (d <= limit[own]) & (self.own[own] != rank[donor])
            own, donor, d = own[good], donor[good], d[good]
            h, f = np.nonzero(~self.there[own] & there[donor])
            gap = self.at[own[h], f]
            h, f, gap = h[~open_[gap]], f[~open_[gap]], gap[~open_[gap]]
            self.take(gap, d[h], rank[donor[h]], y[donor[h], f])


def impute_knn(long: DataFrame, k: int = 5, block: int = 1000) -> DataFrame:
    """Missing cells filled by the mean of the k nearest samples that have the feature; the feature's mean if none does.

    The distance of two samples is over features that both have, scaled up to all features. All samples are compared with all, by
    blocks; a task has a group of blocks with gaps and one of donors, so that a sample is sent to few tasks. A product of
    two blocks tells which donors may be among the k nearest so far; these are compared exactly. A task passes on the k nearest
    donors of each gap, and the nearest of all are averaged. Ties, after rounding to 9 places, go to the lower donor id.
    """
    size = long.agg(F.count_distinct("feature").alias("d"), F.count_distinct("sample_id").alias("n")).head()
    blocks = max(1, -(-size["n"] // block))
    names = long.select("fpos").distinct().select("fpos", (F.row_number().over(Window.orderBy("fpos")) - 1).alias("_col"))
    cells = F.sort_array(F.collect_list(F.struct("_col", "value")))
    rows = long.join(F.broadcast(names), "fpos").groupBy("sample_id").agg(F.transform(cells, lambda c: c["value"]).alias("x"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int"))

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("sample_id")
        x = np.stack([np.array(v, float) for v in p["x"]])
        return pd.DataFrame([{"b": p["_block"].iloc[0], "ids": p["sample_id"].to_numpy(), "x": x.tobytes()}])

    packed = written(rows.groupBy("_block").applyInPandas(pack, "b int, ids array<string>, x binary"), "impute-blocks")
    lefts, rights = min(blocks, GROUPS), min(blocks, max(1, -(-size["n"] * size["d"] // CELLS)))
    left = packed.select("b", "ids", "x", F.lit(0).alias("side"), F.expr(f"b % {lefts}").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(rights - 1))).alias("j"))
    right = packed.select("b", "ids", "x", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(lefts - 1))).alias("i"), F.expr(f"(b div {lefts}) % {rights}").cast("int").alias("j"))

    def nearest(p: pd.DataFrame) -> pd.DataFrame:
        sides = [[(r.ids, np.frombuffer(r.x).reshape(len(r.ids), -1)) for r in p[p["side"] == s].sort_values("b").itertuples()] for s in (0, 1)]
        ids = np.array(sorted(i for own, _ in sides[1] for i in own), object)
        rank, out = {i: n for n, i in enumerate(ids)}, [pd.DataFrame({c: [] for c in ("sample_id", "_col", "dist", "donor", "given")})]
        donors = []
        for own, y in sides[1]:
            z = np.nan_to_num(y)
            donors.append((y, np.array([rank[i] for i in own]), np.hstack([~np.isnan(y), z * z, z])))
        for own, x in sides[0]:
            some = np.isnan(x).any(1)
            own, g = own[some], _Gaps(x[some], np.array([rank.get(i, -1) for i in own[some]], int), k)
            if len(g.row):
                for d in donors:
                    g.meet(*d)
                r, c = np.nonzero(np.isfinite(g.dist))
                out.append(pd.DataFrame({"sample_id": own[g.row[r]], "_col": g.col[r], "dist": g.dist[r, c], "donor": ids[g.who[r, c]], "given": g.given[r, c]}))
        return pd.concat(out[1:] or out)

    found = left.unionByName(right).groupBy("i", "j").applyInPandas(nearest, "sample_id string, _col int, dist double, donor string, given double")
    rank = F.row_number().over(Window.partitionBy("sample_id", "_col").orderBy("dist", "donor"))
    filled = found.withColumn("_r", rank).where(F.col("_r") <= k).groupBy("sample_id", "_col").agg(F.avg("given").alias("_knn")).join(F.broadcast(names), "_col")
    mean = long.groupBy("feature").agg(F.avg("value").alias("_mean"))
    return long.join(filled, ["sample_id", "fpos"], "left").join(mean, "feature").select("sample_id", "fpos", "feature", F.coalesce("value", "_knn", "_mean").alias("value"))


def normalize(long: DataFrame, method: str = "standard") -> DataFrame:
    """z-scores (population deviation), min-max to [0, 1], or log2(v + 1); constant features become 0."""
    if method == "log2":
        return long.withColumn("value", F.log2(F.col("value") + 1))
    if method == "standard":
        out = per_feature(long, _a=F.avg("value"), _b=F.stddev_pop("value"))
        return out.withColumn("value", (F.col("value") - F.col("_a")) / F.coalesce(F.nullif("_b", F.lit(0.0)), F.lit(1.0))).drop("_a", "_b")
    if method == "minmax":
        out = per_feature(long, _a=F.min("value"), _b=F.max("value") - F.min("value"))
        return out.withColumn("value", (F.col("value") - F.col("_a")) / F.coalesce(F.nullif("_b", F.lit(0.0)), F.lit(1.0))).drop("_a", "_b")
    raise ValueError(f"unknown method {method!r}")


def scale_sample(long: DataFrame, center: bool = True, scale: bool = True) -> DataFrame:
    """Mean taken off, and divided by the sample deviation (1 if that is 0)."""
    out = per_feature(long, _a=F.avg("value"), _b=F.stddev_samp("value"))
    v = F.col("value") - F.col("_a") if center else F.col("value")
    return out.withColumn("value", v / F.coalesce(F.nullif("_b", F.lit(0.0)), F.lit(1.0)) if scale else v).drop("_a", "_b")


def clean_inf(long: DataFrame) -> DataFrame:
    """Infinities made missing, missing filled by medians, constant features dropped."""
    finite = long.withColumn("value", F.when(F.abs("value") == _INF, None).otherwise(F.col("value")))
    filled = impute_simple(finite, "median")
    return filled.join(filled.groupBy("feature").agg(F.stddev_pop("value").alias("_s")).where("_s > 0"), "feature", "left_semi")


def clean_internal(long: DataFrame, max_missing: float = 0.5) -> DataFrame:
    """Features with too much missing or no variance dropped, then missing filled by medians."""
    stats = long.groupBy("feature").agg((F.count_if(F.col("value").isNull()) / F.count("*")).alias("_m"), F.stddev_pop("value").alias("_s"))
    return impute_simple(long.join(stats.where((F.col("_m") <= max_missing) & (F.col("_s") > 0)), "feature", "left_semi"), "median")


def sparse_filter(long: DataFrame, missing: float = 0.20) -> DataFrame:
    """Features filled in enough samples, then samples filled in enough of those features."""
    by_feature = long.groupBy("feature").agg(F.count("value").alias("_n"), F.count("*").alias("_all"))
    kept = long.join(by_feature.where(F.col("_n") >= F.floor(F.col("_all") * (1 - missing))), "feature", "left_semi")
    by_sample = kept.groupBy("sample_id").agg(F.count("value").alias("_n"), F.count("*").alias("_all"))
    return kept.join(by_sample.where(F.col("_n") >= F.floor(F.col("_all") * (1 - missing))), "sample_id", "left_semi")


def variation_filter(long: DataFrame, quantile: float = 0.5) -> DataFrame:
    """Features whose coefficient of variation (mean 0 counts as 1) is above a quantile of all."""
    cv = long.groupBy("feature").agg(F.abs(F.stddev_samp("value") / F.when(F.avg("value") == 0, 1.0).otherwise(F.avg("value"))).alias("cv"))
    cut = ranks.quantiles(cv, [], "cv", [quantile]).select(F.col("quantiles")[0].alias("cut"))
    return long.join(cv.join(F.broadcast(cut)).where("cv > cut"), "feature", "left_semi")


def regress_out(long: DataFrame, covariates: DataFrame, names: list[str]) -> DataFrame:
    """Residuals of every feature after least squares on covariates with an intercept, over samples in both.

    The normal equations are aggregates, (p + 1) squared numbers and p + 1 for each feature, solved inside Spark by elimination
    in one small task; the residual is a join back.
    """
    known = covariates.select("sample_id", F.array(F.lit(1.0), *[F.col(c).cast("double") for c in names]).alias("z")).where(F.forall("z", lambda v: v.isNotNull()))
    p = len(names) + 1
    both = long.join(known, "sample_id")
    sample = known.join(long.select("sample_id").distinct(), "sample_id", "left_semi")
    gram = sample.agg(*[F.sum(F.col("z")[i] * F.col("z")[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(p)]).head()
    inverse = np.linalg.pinv(np.array([[gram[f"g{i}_{j}"] or 0.0 for j in range(p)] for i in range(p)]))
    cross = both.groupBy("feature").agg(*[F.sum(F.col("z")[i] * F.col("value")).alias(f"c{i}") for i in range(p)])
    beta = cross.select("feature", F.array(*[sum((F.col(f"c{j}") * float(inverse[i, j]) for j in range(p)), F.lit(0.0)) for i in range(p)]).alias("b"))
    fitted = sum((F.col("z")[i] * F.col("b")[i] for i in range(p)), F.lit(0.0))
    return both.join(beta, "feature").select("sample_id", "fpos", "feature", (F.col("value") - fitted).alias("value"))


def clean_names(names: DataFrame, column: str) -> DataFrame:
    """Names with other characters than letters, digits and underscore made dots, and an X before what is no letter."""
    dotted = F.regexp_replace(column, "[^0-9A-Za-z_]", ".")
    return names.withColumn(column, F.when(dotted.rlike("^[A-Za-z]"), dotted).otherwise(F.concat(F.lit("X"), dotted)))


def average_samples(long: DataFrame, digits: int = 12) -> DataFrame:
    """Samples whose ids agree in their first characters, averaged."""
    return long.groupBy(F.substring("sample_id", 1, digits).alias("sample_id"), "fpos", "feature").agg(F.avg("value").alias("value"))


def binarize(rows: DataFrame, column: str, out: str) -> DataFrame:
    """1 for values above the median."""
    cut = rows.agg(F.median(column).alias("_cut"))
    return rows.join(F.broadcast(cut)).withColumn(out, (F.col(column) > F.col("_cut")).cast("int")).drop("_cut")


# ---- networks -------------------------------------------------------------------------------------


def undirected(edges: DataFrame, how: str = "lower", nodes: DataFrame | None = None) -> DataFrame:
    """One row for each unordered pair, src <= dst by position (by name without a node table).

    Where both directions exist, `lower` takes the weight of the entry below the diagonal, `max` and `mean` combine.
    """
    e = edges
    if nodes is not None:
        pos = nodes.select("node", "npos")
        e = e.join(pos.select(F.col("node").alias("src"), F.col("npos").alias("_i")), "src").join(pos.select(F.col("node").alias("dst"), F.col("npos").alias("_j")), "dst")
    else:
        e = e.withColumns({"_i": F.col("src"), "_j": F.col("dst")})
    up = F.col("_i") <= F.col("_j")
    pair = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("dst"), "weight", (~up).cast("int").alias("_low"))
    weight = {"lower": F.max_by("weight", "_low"), "max": F.max("weight"), "mean": F.avg("weight")}[how]
    return pair.groupBy("src", "dst").agg(weight.alias("weight"))


def prune(edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Edges of at least the threshold (all of them for 0); nodes are what the edges name, a loop keeps its node."""
    return edges.where(F.col("weight") >= threshold) if threshold > 0 else edges


def prune_quantile(edges: DataFrame, quantile: float = 0.5) -> DataFrame:
    """Edges of at least a quantile of all weights (linear interpolation)."""
    cut = ranks.quantiles(edges, [], "weight", [quantile]).select(F.col("quantiles")[0].alias("_cut"))
    return edges.join(F.broadcast(cut)).where((F.col("_cut") <= 0) | (F.col("weight") >= F.col("_cut"))).drop("_cut")


def _restrict(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    kept = nodes.select("node")
    return edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")


def node_columns(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each node the variance (sample, zeros included) and the share of zeros of its adjacency column."""
    n = nodes.agg(F.count("*").cast("double").alias("n"))
    sums = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("s"), F.sum(F.col("weight") ** 2).alias("q"), F.count_if(F.col("weight") != 0).alias("k"))
    full = nodes.select("node").join(sums, "node", "left").na.fill(0).join(F.broadcast(n))
    return full.select("node", ((F.col("q") - F.col("s") ** 2 / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0.0))).alias("variance"), (1 - F.col("k") / F.col("n")).alias("zeros"))


def drop_low_variance(edges: DataFrame, nodes: DataFrame, threshold: float = 1e-6) -> DataFrame:
    return _restrict(edges, node_columns(edges, nodes).where(F.col("variance") > threshold))


def drop_high_zero(edges: DataFrame, nodes: DataFrame, threshold: float = 0.95) -> DataFrame:
    return _restrict(edges, node_columns(edges, nodes).where(F.col("zeros") < threshold))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between the given nodes."""
    return _restrict(edges, nodes)
