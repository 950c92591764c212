"""Communities: Louvain, its phenotype-aware form, personalised PageRank with sweep cuts, and their combination.

Louvain runs on edge lists (`louvain.py`). In its phenotype-aware form moves are sequential, so that one partition is found by
one NumPy kernel on the edges of one network (a few thousand nodes), a task for each weight. What is a sum over edges or nodes
(modularity, conductance, contraction, rank iterations, prefix volumes) is a Spark plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexmat.functions import special
from plexmat.operators import condense
from plexmat.operators import louvain as parallel
from plexmat.plans.iterate import per_run, placed, saved, written

# ---- sums over edges ------------------------------------------------------------------------------


def symmetric(edges: DataFrame) -> DataFrame:
    """Undirected edges (one row a pair) in both directions; loops once."""
    return edges.select("src", "dst", "weight").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Of undirected edges and (node, community): the sum over communities of in / 2m - (tot / 2m)^2; 0 without edges."""
    e = symmetric(edges)
    c = partition.select("node", "community")
    both = e.join(c.select(F.col("node").alias("src"), F.col("community").alias("c1")), "src").join(c.select(F.col("node").alias("dst"), F.col("community").alias("c2")), "dst")
    by = both.groupBy("c1").agg(F.sum("weight").alias("tot"), F.sum(F.when(F.col("c1") == F.col("c2"), F.col("weight")).otherwise(0.0)).alias("inside"))
    m2 = F.sum("tot").over(Window.partitionBy())
    return by.select((F.col("inside") / F.nullif(m2, F.lit(0.0)) - (F.col("tot") / F.nullif(m2, F.lit(0.0))) ** 2).alias("q")).agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("modularity"))


def contract(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """The network of communities: weights summed; what lies inside a community is a loop of twice its weight."""
    c = partition.select("node", "community")
    both = symmetric(edges).join(c.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    return both.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight"))


def conductance(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Weight of edges that leave the members over the smaller of the two volumes."""
    m = members.select("node").distinct().withColumn("_in", F.lit(True))
    e = symmetric(edges).join(m.select(F.col("node").alias("src"), F.col("_in").alias("a")), "src", "left").join(m.select(F.col("node").alias("dst"), F.col("_in").alias("b")), "dst", "left")
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    # a loop adds twice its weight to a volume
    w = F.when(F.col("src") == F.col("dst"), 2 * F.col("weight")).otherwise(F.col("weight"))
    sums = e.agg(F.sum(F.when(a & ~b, F.col("weight")).otherwise(0.0)).alias("cut"), F.sum(F.when(a, w).otherwise(0.0)).alias("v1"), F.sum(F.when(~a, w).otherwise(0.0)).alias("v2"))
    return sums.select((F.col("cut") / F.nullif(F.least("v1", "v2"), F.lit(0.0))).alias("conductance"))


def pagerank(edges: DataFrame, seeds: DataFrame, teleport: float = 0.10, tol: float = 1e-6, max_iter: int = 100, fixed: int | None = None) -> DataFrame:
    """Personalised PageRank (node, score) over undirected edges; seeds are (node, weight). `fixed` rounds are run without looking."""
    edges = saved(edges.select("src", "dst", "weight"))
    e = symmetric(edges).where("weight > 0")
    strength = e.groupBy("src").agg(F.sum("weight").alias("_s"))
    step = saved(e.join(strength, "src").select("src", "dst", (F.col("weight") / F.col("_s")).alias("p")))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    sown = seeds.groupBy("node").agg(F.sum("weight").alias("weight"))
    v = sown.join(F.broadcast(sown.agg(F.sum("weight").alias("_all")))).select("node", (F.col("weight") / F.col("_all")).alias("v"))
    base = saved(nodes.join(v, "node", "left").join(step.select(F.col("src").alias("node")).distinct().withColumn("_goes", F.lit(True)), "node", "left").select("node", F.coalesce("v", F.lit(0.0)).alias("v"), F.col("_goes").isNull().alias("dangling")))
    size = base.agg(F.count("*").alias("n"), F.count_if("dangling").alias("ends"), F.count_if(F.col("v") > 0).alias("seeds")).head()
    if not size["seeds"]:
        raise ValueError("no seed is a node of the network")
    n = size["n"]
    rank = base.withColumn("score", F.lit(1.0 / max(n, 1)))
    for i in range(fixed or max_iter):
        got = step.join(rank.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("score")).alias("in"))
        both = rank.join(got, "node", "left")
        flow = F.coalesce("in", F.lit(0.0))
        if size["ends"]:  # one number a round: what nodes without an edge hand to the seeds
            both = both.join(F.broadcast(rank.where("dangling").agg(F.sum("score").alias("lost"))))
            flow = flow + F.col("lost") * F.col("v")
        new = (1 - teleport) * flow + teleport * F.col("v")
        rank = both.select("node", "v", "dangling", new.alias("score"), F.abs(new - F.col("score")).alias("move"))
        if i % 5 == 4:
            rank = saved(rank)
        if fixed is None and i % 5 == 4 and rank.agg(F.sum("move")).head()[0] < n * tol:  # looked at each time that rounds are saved
            break
    return rank.select("node", "score")


def sweep_cuts(edges: DataFrame, scores: DataFrame, cells: int = 256) -> DataFrame:
    """Prefixes of the nodes by score over strength: (place, node, cut, volume, conductance), the first place being 1.

    Each edge counts for its later end, so that cut and volume of every prefix are running sums of what its nodes add. They run over
    buckets of the order, between `cells` approximate quantiles, so no task has all nodes. Ties go to the higher name. Nodes
    without a positive score are left out; conductance is null for prefixes that leave no volume on one side.
    """
    e = written(symmetric(edges).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "sweep-edges")
    strength = e.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0)).alias("loop"))
    total = strength.agg(F.sum("k")).head()[0] or 0.0
    nodes = written(scores.where("score > 0").join(strength, "node").select("node", "k", "loop", (F.col("score") / F.greatest("k", F.lit(1e-12))).alias("ratio")), "sweep-nodes")
    cuts = nodes.agg(F.percentile_approx("ratio", F.array(*[F.lit(i / cells) for i in range(1, cells)]), 10_000)).head()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c > F.col("ratio"))) if cuts else F.lit(0)
    order = [F.desc("ratio"), F.desc("node")]
    at = written(placed(nodes.withColumn("_bucket", bucket), [], F.col("_bucket"), order, out="place"), "sweep-places")
    ends = at.select("node", "place")
    before = e.where("src <> dst").join(ends.select(F.col("node").alias("src"), "place"), "src").join(ends.select(F.col("node").alias("dst"), F.col("place").alias("place2")), "dst").where("place2 < place")
    inner = before.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("inner"))
    adds = written(at.join(inner, "node", "left").withColumn("add", F.col("k") - F.col("loop") - 2 * F.coalesce("inner", F.lit(0.0))), "sweep-adds")
    ran = placed(placed(adds, [], F.col("_bucket"), order, F.col("add"), "_cut"), [], F.col("_bucket"), order, F.col("k"), "_vol")
    cut, vol = F.col("_cut") + F.col("add"), F.col("_vol") + F.col("k")
    least = F.least("volume", F.lit(float(total)) - F.col("volume"))
    out = ran.select((F.col("place") + 1).alias("place"), "node", cut.alias("cut"), vol.alias("volume"))
    return out.withColumn("conductance", F.when(least > 1e-12 * total, F.col("cut") / least))


def katz(edges: DataFrame, alpha: float = 0.1, rounds: int = 50) -> DataFrame:
    """Katz centrality x = alpha A x + 1, scaled to length 1."""
    return _centrality(edges, lambda got: alpha * got + 1.0, rounds)


def eigenvector(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Leading eigenvector of A + I, scaled to length 1."""
    return _centrality(edges, None, rounds)


def _unit(rank: DataFrame) -> DataFrame:
    """Scores scaled to length 1; the length is one number for all tasks."""
    length = F.broadcast(rank.agg(F.sqrt(F.sum(F.col("score") ** 2)).alias("_length")))
    return rank.join(length).select("node", (F.col("score") / F.col("_length")).alias("score"))


def _centrality(edges: DataFrame, step, rounds: int) -> DataFrame:
    e = saved(symmetric(edges))
    rank = saved(e.select(F.col("src").alias("node")).distinct().withColumn("score", F.lit(1.0)))
    for i in range(rounds):
        got = e.join(rank.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("score")).alias("in"))
        flow = F.coalesce("in", F.lit(0.0))
        rank = rank.join(got, "node", "left").select("node", (step(flow) if step else F.col("score") + flow).alias("score"))
        if i % 5 == 4:  # scaling by one number commutes with the rounds, so it is done as often as rounds are saved
            rank = saved(rank if step else _unit(rank))
    return _unit(rank)


# ---- kernels --------------------------------------------------------------------------------------


def _gain(a: np.ndarray, c: np.ndarray, deg: np.ndarray, m: float, v: int, community: int) -> float:
    """Modularity gained by putting v, taken out of its own, into a community."""
    inside = c == community
    inside[v] = False
    return a[v, inside].sum() / m - deg[inside].sum() * deg[v] / (2 * m * m)


class CorrelationMemo:
    """|r| of the first component of node sets with y, remembered; columns of nodes without data are 0 and left out."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y, self.known = special.zscore(x), y, {}
        self.usable = self.x.std(0) > 0

    def __call__(self, nodes: frozenset[int]) -> float:
        if nodes not in self.known:
            cols = [i for i in sorted(nodes) if self.usable[i]]
            if len(cols) < 2:
                r = 0.0
            else:
                pc, _ = special.first_component(self.x[:, cols])
                r = abs(special.pearson(pc, self.y)) if (pc @ pc) >= 1e-10 else 0.0
            self.known[nodes] = r
        return self.known[nodes]


def louvain_kernel(a: np.ndarray, seed: int, rho: CorrelationMemo | None = None, k_l: float = 1.0, max_passes: int = 100, min_delta: float = 1e-10) -> tuple[np.ndarray, list[dict]]:
    """Community of each node, and what each level did. With rho the gain is k_l * modularity + (1 - k_l) * correlation."""
    rng = np.random.default_rng(seed)
    label = np.arange(len(a))
    history = []
    level = a.copy()
    members = [frozenset([i]) for i in range(len(a))]
    while True:
        n, deg, m = len(level), level.sum(1), level.sum() / 2
        c, moves = np.arange(n), 0
        if m > 0:
            for _ in range(max_passes):
                moved = 0
                for v in rng.permutation(n).tolist():
                    own, near = c[v], np.unique(c[np.flatnonzero(level[v] > 0)])
                    if not len(near):
                        continue
                    stay = _gain(level, c, deg, m, v, own)

                    def joined(k: int, with_v: bool, v: int = v) -> frozenset[int]:
                        return frozenset().union(*[members[u] for u in np.flatnonzero(c == k).tolist() if u != v], members[v] if with_v else frozenset())

                    best, to = 0.0, own
                    for k in near.tolist():
                        if k == own:
                            continue
                        net = _gain(level, c, deg, m, v, k) - stay
                        if rho is not None:
                            change = rho(joined(k, True)) - rho(joined(k, False)) + rho(joined(own, False)) - rho(joined(own, True))
                            net = k_l * net + (1 - k_l) * change
                        if net > best + min_delta:
                            best, to = net, k
                    if to != own:
                        c[v], moved = to, moved + 1
                moves += moved
                if not moved:
                    break
        names, c = np.unique(c, return_inverse=True)
        history.append({"level": len(history), "nodes_at_level": n, "moves": moves, "communities": len(names)})
        label = c[label]
        if not moves or len(names) == n or len(names) == 1:
            return np.unique(label, return_inverse=True)[1], history
        one = np.zeros((n, len(names)))
        one[np.arange(n), c] = 1
        level = one.T @ level @ one
        members = [frozenset().union(*[members[u] for u in np.flatnonzero(c == k).tolist()]) for k in range(len(names))]


def dense(edges: pd.DataFrame, nodes: list[str]) -> np.ndarray:
    at = {n: i for i, n in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for s, t, w in zip(edges["src"], edges["dst"], edges["weight"], strict=True):
        if s in at and t in at:
            a[at[s], at[t]] = a[at[t], at[s]] = w
    return a


def matrix_of(cells: pd.DataFrame, nodes: list[str]) -> tuple[np.ndarray, list[str]]:
    """Samples by nodes; nodes without data and missing cells are 0."""
    wide = cells.pivot_table(index="sample_id", columns="feature", values="value", aggfunc="first").sort_index()
    return wide.reindex(columns=nodes).fillna(0.0).to_numpy(), wide.index.tolist()


def louvain(edges: DataFrame, seeds: list[int] = [0], max_passes: int = 100, min_delta: float = 1e-10) -> DataFrame:  # noqa: B006
    """(seed, node, community) for undirected edges, a run for each seed, all in the same jobs."""
    return parallel.numbered(parallel.parallel(edges, seeds, max_passes, min_delta)[0])


def louvain_history(edges: DataFrame, seed: int = 0) -> DataFrame:
    """What each level of a run did."""
    rows = [(h["level"], h["nodes_at_level"], h["moves"], h["communities"]) for h in parallel.parallel(edges, [seed])[1]]
    return edges.sparkSession.createDataFrame(rows, "level long, nodes_at_level long, moves long, communities long")


def _with_data(edges: DataFrame, long: DataFrame, target: DataFrame, settings: DataFrame, run, schema: str) -> DataFrame:
    """Runs a kernel for every row of settings (run long, ...) over the edges, the data of their nodes and the phenotype.

    Many samples are condensed, cells that they lack being 0 to the kernels anyway; the column samples says how many they were (-1 where the data are the samples themselves).
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("feature")).distinct()
    long, target, n = condense.few(long.join(nodes, "feature", "left_semi"), target, fill=True)
    settings = settings.withColumn("samples", F.lit(-1 if n is None else n))
    own = long.join(target, "sample_id").select(F.lit(1).alias("kind"), "sample_id", "feature", "value", "y")
    net = edges.select(F.lit(0).alias("kind"), F.col("src").alias("sample_id"), F.col("dst").alias("feature"), F.col("weight").alias("value"), F.lit(None).cast("double").alias("y"))
    return per_run(net.unionByName(own), settings, ["run"], run, schema)


def _split(p: pd.DataFrame) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    e = p[p["kind"] == 0].rename(columns={"sample_id": "src", "feature": "dst", "value": "weight"})
    nodes = sorted({*e["src"], *e["dst"]})
    d = p[p["kind"] == 1]
    x, samples = matrix_of(d, nodes)
    y = d.groupby("sample_id")["y"].first().reindex(samples).to_numpy()
    return dense(e, nodes), nodes, x, y


def correlated_louvain(edges: DataFrame, long: DataFrame, target: DataFrame, k_l: float | list[float] = 0.2, seed: int = 0, max_passes: int = 50, min_delta: float = 1e-6) -> DataFrame:
    """(run, k_l, node, community, rho): communities that also go with the phenotype; rho is that of the node's community."""
    weights = k_l if isinstance(k_l, list) else [k_l]
    if any(not 0 <= k <= 1 for k in weights):
        raise ValueError("k_l lies in [0, 1]")
    settings = edges.sparkSession.createDataFrame([(i, float(k)) for i, k in enumerate(weights)], "run long, k_l double")

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        a, nodes, x, y = _split(p)
        k, rho = float(p["k_l"].iloc[0]), CorrelationMemo(x, y)
        c, _ = louvain_kernel(a, seed, rho, k, max_passes, min_delta)
        of = {g: rho(frozenset(np.flatnonzero(c == g).tolist())) for g in np.unique(c).tolist()}
        return pd.DataFrame({"run": key[0], "k_l": k, "node": nodes, "community": c, "rho": [of[g] for g in c.tolist()]})

    return _with_data(edges, long, target, settings, run, "run long, k_l double, node string, community long, rho double")


def top_communities(partition: DataFrame, n: int = 1) -> DataFrame:
    """Communities of two or more nodes by correlation."""
    by = partition.groupBy("community").agg(F.count("*").alias("size"), F.max("rho").alias("rho"), F.sort_array(F.collect_list("node")).alias("nodes"))
    return by.where("size >= 2").orderBy(F.desc("rho"), "community").limit(n)


def combined_quality(edges: DataFrame, partition: DataFrame, k_l: float = 0.2) -> DataFrame:
    """k_l * modularity + (1 - k_l) * mean correlation of communities of two or more."""
    rho = partition.groupBy("community").agg(F.count("*").alias("n"), F.max("rho").alias("rho")).where("n >= 2").agg(F.coalesce(F.avg("rho"), F.lit(0.0)).alias("rho"))
    return modularity(edges, partition).join(rho).select((k_l * F.col("modularity") + (1 - k_l) * F.col("rho")).alias("quality"))


def seed_weights(x: np.ndarray, y: np.ndarray, seeds: list[int]) -> np.ndarray:
    """What each seed adds to |rho| of the seeds, none below 1e-4 of the largest, scaled by it."""
    rho = CorrelationMemo(x, y)
    whole = rho(frozenset(seeds))
    add = np.array([whole - rho(frozenset(seeds) - {i}) for i in seeds])
    most = max(float(add.max(initial=0.0)), 1e-12)
    return np.maximum(add, 1e-4 * most) / most


def pagerank_kernel(a: np.ndarray, v: np.ndarray, teleport: float, tol: float = 1e-6, max_iter: int = 100) -> np.ndarray:
    deg = a.sum(1)
    p = a / np.where(deg > 0, deg, 1)[:, None]
    x = np.full(len(a), 1 / len(a))
    for _ in range(2 * max_iter):
        new = (1 - teleport) * (p.T @ x + x[deg == 0].sum() * v) + teleport * v
        if np.abs(new - x).sum() < len(a) * tol:
            return new
        x = new
    return x


def sweep_kernel(a: np.ndarray, score: np.ndarray, x: np.ndarray, y: np.ndarray, k_p: float, least: int = 2, n: int | None = None) -> dict:
    """The prefix of nodes by score over strength that is best by k_p * conductance - (1 - k_p) * |rho|, compared at 4 decimals. n: how many samples the rows stand for."""
    deg = a.sum(1)
    order = sorted((i for i in range(len(a)) if score[i] > 0), key=lambda i: (-score[i] / max(deg[i], 1e-12), -i))
    rho, best = CorrelationMemo(x, y), {}
    inside, cut, vol, total = np.zeros(len(a), bool), 0.0, 0.0, deg.sum()
    for k, i in enumerate(order, 1):
        cut += deg[i] - a[i, i] - 2 * a[i, inside].sum()
        inside[i] = True
        vol += deg[i]
        if k < least or k == len(a) or min(vol, total - vol) <= 0:
            continue
        phi, r = cut / min(vol, total - vol), rho(frozenset(order[:k]))
        value = round(k_p * phi - (1 - k_p) * r, 4)
        if not best or value < best["composite"]:
            best = {"members": order[:k], "conductance": round(phi, 4), "correlation": round(r, 4), "composite": value, "p": special.pearson_tail(r, n or len(y))}
    return best


def correlated_pagerank(edges: DataFrame, long: DataFrame, target: DataFrame, seeds: list[str], teleport: float = 0.10, k_p: float = 0.5, least: int = 2) -> DataFrame:
    """The sweep cut around the seeds: (node, conductance, correlation, composite, p)."""
    if not seeds:
        raise ValueError("there are no seeds")
    if not 0 < teleport < 1 or not 0 <= k_p <= 1:
        raise ValueError("teleport lies in (0, 1) and k_p in [0, 1]")
    settings = edges.sparkSession.createDataFrame([(0,)], "run long")

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        a, nodes, x, y = _split(p)
        missing = set(seeds) - set(nodes)
        if missing:
            raise ValueError(f"seeds that aren't in the network: {sorted(missing)}")
        found = _cut_around(a, x, y, [nodes.index(s) for s in seeds], teleport, k_p, least, _samples(p))
        own = found.pop("members", [])
        return pd.DataFrame({"node": [nodes[i] for i in own], **{k: found.get(k) for k in ("conductance", "correlation", "composite", "p")}})

    return _with_data(edges, long, target, settings, run, "node string, conductance double, correlation double, composite double, p double")


def _samples(p: pd.DataFrame) -> int | None:
    n = int(p["samples"].iloc[0])
    return None if n < 0 else n


def _cut_around(a, x, y, seeds, teleport, k_p, least, n=None) -> dict:
    v = np.zeros(len(a))
    v[seeds] = seed_weights(x, y, seeds)
    return sweep_kernel(a, pagerank_kernel(a, v / v.sum(), teleport), x, y, k_p, least, n)


def hybrid(edges: DataFrame, long: DataFrame, target: DataFrame, k_l: float = 0.8, teleport: float = 0.05, k_p: float = 0.7, max_iter: int = 10, min_nodes: int = 3, seed: int = 0) -> DataFrame:
    """Rounds of correlated Louvain, its best community, and the sweep cut around it, each on the nodes the round before left.

    (iteration, node, size, correlation, conductance, composite, best): best marks the round of highest correlation.
    """
    settings = edges.sparkSession.createDataFrame([(0,)], "run long")
    columns = ["iteration", "node", "size", "correlation", "conductance", "composite", "best"]

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        a, nodes, x, y = _split(p)
        keep, rounds = np.arange(len(nodes)), []
        for _ in range(max_iter):
            if len(keep) < max(2, min_nodes):
                break
            sub, sx = a[np.ix_(keep, keep)], x[:, keep]
            rho = CorrelationMemo(sx, y)
            c, _ = louvain_kernel(sub, seed, rho, k_l, 50, 1e-6)
            groups = [np.flatnonzero(c == g).tolist() for g in np.unique(c)]
            groups = sorted((g for g in groups if len(g) >= 2), key=lambda g: -rho(frozenset(g)))
            found = _cut_around(sub, sx, y, groups[0], teleport, k_p, 2, _samples(p)) if groups else {}
            if not found:
                break
            new = keep[sorted(found["members"])]
            rounds.append((new, found))
            if len(new) == len(keep) or len(new) < min_nodes:
                break
            keep = new
        top = max(range(len(rounds)), key=lambda i: rounds[i][1]["correlation"], default=-1)
        rows = [(i, nodes[n], len(own), f["correlation"], f["conductance"], f["composite"], i == top) for i, (own, f) in enumerate(rounds) for n in own]
        return pd.DataFrame(rows, columns=columns)

    return _with_data(edges, long, target, settings, run, "iteration long, node string, size long, correlation double, conductance double, composite double, best boolean")


def best_subgraph(edges: DataFrame, rounds: DataFrame) -> DataFrame:
    """The edges among the nodes of the best round."""
    own = rounds.where("best").select("node")
    return edges.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi")
