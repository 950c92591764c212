"""Node features, graph networks, subject representations and outcome prediction.

Features, labels, edge weights, splits, fusion and metrics are Spark plans. A model is trained full-batch by a NumPy
kernel on one network (about a thousand nodes); trials, folds and seeds are rows of a frame, a task each.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from plexmat.functions import autodiff as ad
from plexmat.functions import forest, log, special
from plexmat.operators import ridge, search, select, together
from plexmat.operators.community import dense, matrix_of
from plexmat.plans.iterate import packed, per_run, placed, saved, unpacked, written

# ---- node features and labels (plans) -------------------------------------------------------------


def clinical_features(long: DataFrame, clinical: DataFrame, names: list[str]) -> DataFrame:
    """(feature, variable, z): Fisher's z of each feature with each clinical variable, 0 where undefined."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("y")) for c in names])
    vars_ = clinical.select("sample_id", F.inline(cells))
    out = None
    for c in names:
        r = select.pearson_with(long, vars_.where(F.col("variable") == c)).select("feature", F.lit(c).alias("variable"), fisher(F.coalesce("r", F.lit(0.0))).alias("z"))
        out = r if out is None else out.unionByName(r)
    return out


def fisher(r):
    return F.atanh(F.greatest(F.least(r, F.lit(0.999999)), F.lit(-0.999999)))


def statistical_features(long: DataFrame, target: DataFrame) -> DataFrame:
    """(feature, mean, skew, mad) over samples with a phenotype; skew as sign * log(1 + |skew|)."""
    own = long.join(target.where("y is not null").select("sample_id"), "sample_id", "left_semi")
    stats = own.groupBy("feature").agg(F.avg("value").alias("mean"), F.median("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    dev = own.join(F.broadcast(stats), "feature")
    z = (F.col("value") - F.col("mean")) / F.nullif("_s", F.lit(0.0))
    out = dev.groupBy("feature").agg(F.first("mean").alias("mean"), F.avg(z**3).alias("_k"), F.median(F.abs(F.col("value") - F.col("_m"))).alias("mad"))
    k = F.coalesce("_k", F.lit(0.0))
    return out.select("feature", "mean", (F.signum(k) * F.log1p(F.abs(k))).alias("skew"), "mad")


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns minus their mean over their sample deviation (1e-8 for 0)."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    out = df.join(F.broadcast(stats))  # one row
    return out.select(*[((F.col(c) - F.col(f"_mean_{c}")) / F.when(F.col(f"_sd_{c}") > 0, F.col(f"_sd_{c}")).otherwise(F.lit(1e-8))).alias(c) if c in columns else F.col(c) for c in df.columns])


def node_labels(long: DataFrame, target: DataFrame) -> DataFrame:
    """(feature, label): Fisher's z of each feature with the phenotype, standardised."""
    return standardized(select.pearson_with(long, target).select("feature", fisher(F.coalesce("r", F.lit(0.0))).alias("label")), ["label"])


def abs_pearson_features(long: DataFrame, clinical: DataFrame, names: list[str], train: DataFrame) -> DataFrame:
    """(feature, variable, score): |r| over training samples only, 0 where undefined."""
    own = long.join(train.select("sample_id"), "sample_id", "left_semi")
    out = None
    for c in names:
        r = select.pearson_with(own, clinical.select("sample_id", F.col(c).cast("double").alias("y"))).select("feature", F.lit(c).alias("variable"), F.coalesce(F.abs("r"), F.lit(0.0)).alias("score"))
        out = r if out is None else out.unionByName(r)
    return out


def adaptive_features(long: DataFrame, clinical: DataFrame, names: list[str], train: DataFrame) -> DataFrame:
    """(feature, variable, z): Fisher's z of r, standardised by variable. For 0/1 codes r is the phi or point-biserial coefficient."""
    own = long.join(train.select("sample_id"), "sample_id", "left_semi")
    z = clinical_features(own, clinical, names)
    w = Window.partitionBy("variable")
    sd = F.stddev_samp("z").over(w)
    return z.withColumn("z", (F.col("z") - F.avg("z").over(w)) / F.when(sd > 0, sd).otherwise(F.lit(1e-8)))


def both_directions(edges: DataFrame) -> DataFrame:
    """Edges without loops, in both directions."""
    e = edges.where("src <> dst")
    return e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def normalized_edges(edges: DataFrame) -> DataFrame:
    """Both directions and loops (of the mean weight), each over the square root of its ends' edge counts."""
    both = both_directions(edges)
    mean = F.broadcast(both.agg(F.avg("weight").alias("weight")))
    loops = both.select("src").distinct().join(mean).select("src", F.col("src").alias("dst"), "weight")
    every = both.unionByName(loops)
    deg = every.groupBy("dst").agg(F.count("*").alias("d"))
    return every.join(deg.select(F.col("dst").alias("src"), F.col("d").alias("ds")), "src").join(deg, "dst").select("src", "dst", (F.col("weight") / F.sqrt(F.col("ds") * F.col("d"))).alias("weight"))


# ---- graph networks (kernels) ---------------------------------------------------------------------


class GraphNet:
    """GCN, GAT, SAGE or GIN: 1 + max(0, layers - 2) convolutions, each with activation and dropout, and a linear head."""

    def __init__(self, kind: str, n_in: int, hidden: int, layers: int = 2, drop: float | bool = True, act: str = "relu", heads: int = 1, n_out: int | None = 1, seed: int = 0):
        if kind not in ("GCN", "GAT", "SAGE", "GIN"):
            raise ValueError(f"unknown model {kind!r}")
        rng = np.random.default_rng(seed)
        self.kind, self.act, self.drop, self.heads = kind, ad.activation(act), drop, heads if kind == "GAT" else 1
        self.hidden, self.params, self.layers = hidden, [], []
        size = n_in
        for _ in range(1 + max(0, layers - 2)):
            wide = hidden * self.heads
            parts = [ad.Linear(size, wide, rng)]
            if kind == "GAT":
                parts += [ad.Var(rng.normal(0, 0.1, (1, wide))) for _ in range(3)]
            if kind == "SAGE":
                parts.append(ad.Linear(size, wide, rng))
            if kind == "GIN":
                parts += [ad.Linear(wide, wide, rng), ad.Var(rng.normal(0, 0.1, (1, size)))]
            for p in parts:
                self.params += p.params if isinstance(p, ad.Linear) else [p]
            self.layers.append(parts)
            size = wide
        self.size = size
        self.head = ad.Linear(size, n_out, rng) if n_out else None
        self.params += self.head.params if self.head else []

    def _conv(self, x: ad.Var, parts: list, src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int) -> ad.Var:
        first = parts[0]
        if self.kind == "GCN":
            return ad.scatter((x @ first.w).at(src) * ad.Var(w[:, None]), dst, n) + first.b
        if self.kind == "SAGE":
            count = np.maximum(np.bincount(dst, minlength=n), 1)[:, None]
            return first(x) + parts[1](ad.scatter(x.at(src), dst, n) * ad.Var(1 / count))
        if self.kind == "GIN":
            sent = ad.activation("relu")(x.at(src) + ad.Var(w[:, None]) * parts[2])
            return parts[1](ad.activation("relu")(first(x + ad.scatter(sent, dst, n))))
        h = x @ first.w
        group = np.kron(np.eye(self.heads), np.ones((self.hidden, 1)))
        score = (h * parts[1]).at(src) + (h * parts[2]).at(dst) + ad.Var(w[:, None]) * parts[3]
        raw = score @ ad.Var(group)
        v = raw.value
        alpha = ad.segment_softmax(ad.pointwise(raw, np.where(v > 0, v, 0.2 * v), np.where(v > 0, 1.0, 0.2)), dst, n)
        return ad.scatter(h.at(src) * (alpha @ ad.Var(group.T)), dst, n) + first.b

    def embed(self, x: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, rng: np.random.Generator | None = None) -> ad.Var:
        h = ad.Var(x)
        for parts in self.layers:
            h = ad.dropout(self.act(self._conv(h, parts, src, dst, w, len(x))), self.drop, rng)
        return h

    def fit(self, x, src, dst, w, y, epochs: int = 200, rate: float = 1e-2, decay: float = 1e-4, patience: int = 50, seed: int = 0) -> float:
        """Mean squared error by Adam, until it hasn't fallen by 1e-6 for `patience` epochs; the last loss."""
        opt, rng, best, since, loss = ad.Adam(self.params, rate, decay), np.random.default_rng(seed), np.inf, 0, None
        for _ in range(epochs):
            loss = ad.mse(self.head(self.embed(x, src, dst, w, rng)), y[:, None])
            if not np.isfinite(loss.value):
                break
            loss.backward()
            opt.step()
            best, since = (float(loss.value), 0) if loss.value < best - 1e-6 else (best, since + 1)
            if since >= patience:
                break
        return float(loss.value)


def _with_loops(a: np.ndarray, normalize: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a dense network with loops, weights over the square roots of edge counts."""
    a = a.copy()
    np.fill_diagonal(a, a[a > 0].mean() if (a > 0).any() else 1.0)
    src, dst = np.nonzero(a)
    deg = np.bincount(dst, minlength=len(a))
    return src, dst, a[src, dst] / np.sqrt(deg[src] * deg[dst]) if normalize else a[src, dst]


def network_table(edges: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges, node features (feature, variable, z) and labels (feature, label) in one frame for a kernel."""
    e = edges.select(F.lit("e").alias("kind"), "src", "dst", "weight")
    f = features.select(F.lit("x").alias("kind"), F.col("feature").alias("src"), F.col("variable").alias("dst"), F.col("z").alias("weight"))
    y = labels.select(F.lit("y").alias("kind"), F.col("feature").alias("src"), F.col("feature").alias("dst"), F.col("label").alias("weight"))
    return e.unionByName(f).unionByName(y)


def _unpack(p: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    e, f, y = (p[p["kind"] == k] for k in "exy")
    nodes = sorted({*e["src"], *e["dst"]} & {*y["src"]})
    x = f.pivot_table(index="src", columns="dst", values="weight", aggfunc="first").reindex(nodes).fillna(0.0).to_numpy()
    return nodes, dense(e, nodes), x if x.size else np.ones((len(nodes), 1)), y.set_index("src")["weight"].reindex(nodes).fillna(0.0).to_numpy()


def embed_nodes(edges: DataFrame, features: DataFrame, labels: DataFrame, kind: str = "GCN", hidden: int = 16, layers: int = 2, epochs: int = 200, rate: float = 1e-2, drop: float | bool = 0.2, act: str = "relu", seed: int = 0) -> DataFrame:
    """(feature, embedding): the last hidden state of a network trained to predict the labels."""
    GraphNet(kind, 1, 1, act=act)  # names are checked before a task runs

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        nodes, a, x, y = _unpack(p)
        net, g = GraphNet(kind, x.shape[1], hidden, layers, drop, act, seed=seed), _with_loops(a)
        net.fit(x, *g, y, epochs, rate, seed=seed)
        return pd.DataFrame({"feature": nodes, "embedding": list(net.embed(x, *g).value)})

    return network_table(edges, features, labels).withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(run, "feature string, embedding array<double>")


def tune_embedding(edges: DataFrame, features: DataFrame, labels: DataFrame, trials: int = 20, epochs: int = 100, seed: int = 0) -> DataFrame:
    """(trial, kind, hidden, layers, rate, mse, spread, score, best): random settings, each a task.

    mse: a random forest's error on held-out nodes, of labels from the embedding without near-constant dimensions; score: mse
    over the mean deviation of dimensions. The lowest score among the three lowest errors is best.
    """
    rng = np.random.default_rng(seed)
    rows = [(t, str(rng.choice(["GCN", "GAT", "SAGE", "GIN"])), int(rng.choice([8, 16, 32])), int(rng.choice([2, 3])), float(10 ** rng.uniform(-3, -1.5))) for t in range(trials)]
    plan = edges.sparkSession.createDataFrame(rows, "trial int, kind_of string, hidden int, layers int, rate double")

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        nodes, a, x, y = _unpack(p)
        kind, hidden, layers, rate = (p[c].iloc[0] for c in ("kind_of", "hidden", "layers", "rate"))
        net, g = GraphNet(str(kind), x.shape[1], int(hidden), int(layers), 0.2, seed=seed), _with_loops(a)
        net.fit(x, *g, y, epochs, float(rate), seed=seed)
        h = net.embed(x, *g).value
        h = h[:, h.std(0) > 1e-5] if (h.std(0) > 1e-5).any() else h
        err, spread = -forest.score(h, y, False, seed), float(h.std(0).mean())
        return pd.DataFrame([(key[0], kind, hidden, layers, rate, err, spread, err / (spread + 1e-6))], columns=["trial", "kind", "hidden", "layers", "rate", "mse", "spread", "score"])

    tried = per_run(network_table(edges, features, labels), plan, ["trial"], run, "trial int, kind string, hidden int, layers int, rate double, mse double, spread double, score double")
    tried = saved(tried)
    few = tried.orderBy("mse", "trial").limit(3).agg(F.min_by("trial", F.struct("score", "trial")).alias("_t"))
    return tried.join(F.broadcast(few)).withColumn("best", F.col("trial") == F.col("_t")).drop("_t")


# ---- subject representation -----------------------------------------------------------------------


def reduce_embeddings(embeddings: DataFrame, dim: int = 2, method: str = "PCA", epochs: int = 200, seed: int = 0) -> DataFrame:
    """(feature, component, value): principal components, or the code of an autoencoder whose widths halve."""
    if method not in ("PCA", "AE"):
        raise ValueError(f"unknown method {method!r}")

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("feature")
        x = np.stack(p["embedding"].to_numpy())
        x = x - x.mean(0)
        if method == "PCA":
            u, s, _ = np.linalg.svd(x, full_matrices=False)
            z = (u * s)[:, :dim]
        else:
            z = _autoencode(x, dim, epochs, seed)
        i, j = np.indices(z.shape)
        return pd.DataFrame({"feature": p["feature"].to_numpy()[i.ravel()], "component": j.ravel().astype(np.int32), "value": z.ravel()})

    return embeddings.withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(run, "feature string, component int, value double")


def _autoencode(x: np.ndarray, dim: int, epochs: int, seed: int) -> np.ndarray:
    rng, widths = np.random.default_rng(seed), [x.shape[1]]
    while widths[-1] // 2 > dim:
        widths.append(widths[-1] // 2)
    widths.append(dim)
    down = [ad.Linear(a, b, rng) for a, b in itertools.pairwise(widths)]
    up = [ad.Linear(b, a, rng) for a, b in reversed(list(itertools.pairwise(widths)))]
    relu, opt = ad.activation("relu"), ad.Adam([p for l in down + up for p in l.params], 1e-2)

    def chain(h: ad.Var, layers: list) -> ad.Var:
        for i, layer in enumerate(layers):
            h = layer(h) if i == len(layers) - 1 else relu(layer(h))
        return h

    for _ in range(epochs):
        loss = ad.mse(chain(chain(ad.Var(x), down), up), x)
        loss.backward()
        opt.step()
    return chain(ad.Var(x), down).value


def feature_weights(reduced: DataFrame) -> DataFrame:
    """(feature, w): components scaled to [0, 1], averaged, ranked (ties averaged) and spread over [-1, 1]."""
    w = Window.partitionBy("component")
    span = F.max("value").over(w) - F.min("value").over(w)
    unit = reduced.withColumn("u", F.coalesce((F.col("value") - F.min("value").over(w)) / F.nullif(span, F.lit(0.0)), F.lit(0.0)))
    mean = unit.groupBy("feature").agg(F.round(F.avg("u"), 9).alias("m"))
    rank = F.rank().over(Window.orderBy("m")) + (F.count("*").over(Window.partitionBy("m")) - 1) / 2
    n = F.count("*").over(Window.partitionBy())
    return mean.select("feature", (2 * (rank - 1) / F.greatest(n - 1, F.lit(1)) - 1).alias("w"))


def fuse(long: DataFrame, weights: DataFrame, alpha: float = 2.0, beta: float = 0.5) -> DataFrame:
    """x * (beta + (1 - beta) * alpha * w); features without a weight are left as they are."""
    factor = F.coalesce(beta + (1 - beta) * alpha * F.col("w"), F.lit(1.0))
    return long.join(weights, "feature", "left").select("sample_id", "fpos", "feature", (F.col("value") * factor).alias("value"))


def represent(long: DataFrame, embeddings: DataFrame, method: str = "AE", dim: int = 2, alpha: float = 1.0, beta: float = 0.8) -> DataFrame:
    """The matrix with features reweighted by their embeddings."""
    if long.select("feature").distinct().join(embeddings.select("feature"), "feature", "left_semi").isEmpty():
        raise ValueError("embeddings and matrix share no feature")
    return fuse(long, feature_weights(reduce_embeddings(embeddings, dim, method)), alpha, beta)


def tune_representation(long: DataFrame, embeddings: DataFrame, target: DataFrame, trials: int = 20, epochs: int = 100, seed: int = 0) -> DataFrame:
    """(trial, method, dim, alpha, beta, score): random settings of `represent`, each a task, by what a random forest tells of the
    phenotype from the reweighted samples: accuracy for up to 20 whole classes, else minus the squared error; 0 where a setting fails."""
    rng = np.random.default_rng(seed)
    rows = [(t, str(rng.choice(["PCA", "AE"])), int(rng.choice([1, 2, 4])), float(rng.uniform(0.5, 3)), float(rng.uniform(0, 1))) for t in range(trials)]
    plan = long.sparkSession.createDataFrame(rows, "trial int, method string, dim int, alpha double, beta double")
    rows, names = packed(long, target.where("y is not null"))
    given = embeddings.orderBy("feature").toPandas()  # nodes of one network
    data, n, kind = _laid_out(rows, len(names))
    out = "trial int, method string, dim int, alpha double, beta double, score double"
    if not n:
        return plan.withColumn("score", F.lit(0.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, own = np.zeros((n, len(names)), kind, order="F"), np.empty(n), None
        for b in batches:
            for i in range(0, len(b), PART):
                c = b.iloc[i : i + PART]
                x[c["place"]] = np.frombuffer(b"".join(c["x"]), kind).reshape(len(c), len(names))
                y[c["place"]] = c["y"]
            own = b.iloc[0] if own is None and len(b) else own
        if own is None:
            return
        method, dim, alpha, beta = (own[c] for c in ("method", "dim", "alpha", "beta"))
        try:
            h = np.stack(given["embedding"].to_numpy())
            h = h - h.mean(0)
            z = _autoencode(h, int(dim), epochs, seed) if method == "AE" else (lambda u, s, _: (u * s)[:, : int(dim)])(*np.linalg.svd(h, full_matrices=False))
            span = z.max(0) - z.min(0)
            m = pd.Series(np.round(np.where(span > 0, (z - z.min(0)) / np.where(span > 0, span, 1), 0).mean(1), 9), index=given["feature"].to_numpy())
            w = (2 * (m.rank() - 1) / max(len(m) - 1, 1) - 1).reindex(names)
            factor = (beta + (1 - beta) * alpha * w).fillna(1.0).to_numpy()
            few = len(np.unique(y)) <= 20 and bool((y == np.round(y)).all())
            score = forest.score(x, y, few, seed, scale=factor)
        except (np.linalg.LinAlgError, ValueError):
            score = 0.0
        yield pd.DataFrame([(own["trial"], method, dim, alpha, beta, score)], columns=["trial", "method", "dim", "alpha", "beta", "score"])

    # a partition for each trial, and none for two
    return data.join(F.broadcast(plan)).repartitionById(trials, F.col("trial")).mapInPandas(run, out)


def _laid_out(rows: DataFrame, width: int) -> tuple[DataFrame, int, str]:
    """(place, y, x) of packed rows: their place in the order of the samples, and their values as bytes, missing cells 0; how many
    rows there are, and the type of a value: single precision where that loses nothing."""
    spread = written(rows.repartitionByRange("sample_id").withColumn("_range", F.spark_partition_id()), "rows-in-ranges")
    size = spread.agg(F.count("*").alias("n"), F.bool_and(F.forall("v", lambda v: v.cast("float").cast("double") == v)).alias("single")).head()
    kind = "<f4" if size["single"] else "<f8"

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.zeros((len(b), width), kind)
            for i, (at, v) in enumerate(zip(b["at"], b["v"], strict=True)):
                x[i, at] = v
            yield pd.DataFrame({"place": b["place"], "y": b["y"], "x": [r.tobytes() for r in x]})

    own = placed(spread, [], F.col("_range"), ["sample_id"], out="place")
    return written(own.select("place", F.col("y").cast("double").alias("y"), "at", "v").mapInPandas(lay, "place long, y double, x binary"), "rows-laid-out"), int(size["n"]), kind


# ---- outcome prediction ---------------------------------------------------------------------------


def stratified(target: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """A fold for each sample, classes spread evenly."""
    return _shuffled(target, seed).select(*target.columns, (F.col("_place") % k).cast("int").alias("fold"))


def _shuffled(target: DataFrame, seed: int) -> DataFrame:
    """target with the place of each sample in its class, in a pseudorandom order."""
    keyed = target.withColumn("_key", F.md5(F.concat(F.col("sample_id").cast("string"), F.lit(f":{seed}"))))
    return placed(keyed, ["y"], F.substring("_key", 1, 3), ["_key", "sample_id"])


def holdout(target: DataFrame, share: float = 0.3, seed: int = 0) -> DataFrame:
    """test boolean for each sample: the first `share` of every class in a pseudorandom order."""
    size = target.groupBy(F.col("y").alias("_y")).agg(F.count("*").alias("_all"))
    both = _shuffled(target, seed).join(size, F.col("y").eqNullSafe(F.col("_y")))
    return both.select(*target.columns, (F.col("_place") < F.round(share * F.col("_all"))).alias("test"))


class Outcome:
    """Network to embedding to one weight a feature; samples times weights through two normalised layers to class scores."""

    def __init__(self, kind: str, n_in: int, features: int, classes: int, hidden: int = 16, layers: int = 2, reduction: str = "ae", encoding: int = 4, nn1: int = 32, nn2: int = 16, drop: float = 0.4, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.net = GraphNet(kind, n_in, hidden, layers, drop, n_out=None, seed=seed)
        code = 1 if reduction == "ae" else encoding
        widths = [self.net.size, 8, 4, 1] if code == 1 else [self.net.size, min(2 * code, self.net.size), code]
        self.encoder = [ad.Linear(a, b, rng) for a, b in itertools.pairwise(widths)]
        if reduction == "linear":
            self.encoder.append(ad.Linear(code, 1, rng))
        elif reduction == "mlp":
            self.encoder += [ad.Linear(code, 8, rng), ad.Linear(8, 1, rng)]
        self.head = [ad.Linear(features, nn1, rng), ad.Linear(nn1, nn2, rng), ad.Linear(nn2, classes, rng)]
        self.norm = [(ad.Var(np.ones(n)), ad.Var(np.zeros(n)), {}) for n in (nn1, nn2)]
        self.params = self.net.params + [p for layer in self.encoder + self.head for p in layer.params] + [v for s, t, _ in self.norm for v in (s, t)]

    def weights(self, x, g, rng=None) -> ad.Var:
        h, relu = self.net.embed(x, *g, rng), ad.activation("relu")
        for i, layer in enumerate(self.encoder):
            h = layer(h) if i == len(self.encoder) - 1 else relu(layer(h))
        return h

    def scores(self, x, g, rows: np.ndarray, rng=None) -> ad.Var:
        w = self.weights(x, g, rng)
        h = ad.Var(rows) * Var_t(w)
        for layer, (s, t, stats) in zip(self.head[:2], self.norm, strict=True):
            h = ad.activation("relu")(ad.batch_norm(layer(h), s, t, stats, rng is not None))
        return self.head[2](h)

    def fit(self, x, g, rows, label, epochs: int = 128, rate: float = 5e-3, decay: float = 1e-4, seed: int = 0) -> None:
        """Cross-entropy by Adam with a cosine-annealed rate."""
        opt, rng = ad.Adam(self.params, rate, decay), np.random.default_rng(seed)
        for t in range(epochs):
            self.slope(self.weights(x, g, rng), rows, label)
            opt.step(1e-6 + (rate - 1e-6) * (1 + np.cos(np.pi * t / epochs)) / 2)

    def slope(self, weights: ad.Var, rows: np.ndarray, label: np.ndarray) -> None:
        """Gradients of the cross-entropy of all rows, as `scores` and `backward` give them, PART rows at a time: of what lies between, only
        the standardised layers and their gradients are kept for all rows. What is added before standardising has no gradient: what rounding
        leaves of one, Adam would make steps of."""
        n, w, (one, two, last) = len(rows), weights.value[:, 0], self.head
        parts = [slice(i, i + PART) for i in range(0, n, PART)]
        z1, z2 = np.empty((n, one.w.value.shape[1])), np.empty((n, two.w.value.shape[1]))
        g1, g2 = np.empty_like(z1), np.empty_like(z2)
        (scale1, shift1, _), (scale2, shift2, _) = self.norm

        def standardise(z: np.ndarray, stats: dict, eps: float = 1e-5) -> np.ndarray:
            m = sum(z[p].sum(0) for p in parts) / n
            s = sum(((z[p] - m) ** 2).sum(0) for p in parts) / n
            stats["m"], stats["s"] = 0.9 * stats.get("m", m) + 0.1 * m, 0.9 * stats.get("s", s) + 0.1 * s
            inv = 1 / np.sqrt(s + eps)
            for p in parts:
                z[p] = (z[p] - m) * inv
            return inv

        for p in parts:
            z1[p] = (rows[p] * w) @ one.w.value + one.b.value
        inv1 = standardise(z1, self.norm[0][2])
        for p in parts:
            z2[p] = np.maximum(z1[p] * scale1.value + shift1.value, 0) @ two.w.value + two.b.value
        inv2 = standardise(z2, self.norm[1][2])
        for v in (one.w, one.b, two.w, two.b, last.w, last.b, scale1, shift1, scale2, shift2):
            v.grad = np.zeros_like(v.value)
        mean, along = np.zeros(z2.shape[1]), np.zeros(z2.shape[1])
        for p in parts:
            h = np.maximum(z2[p] * scale2.value + shift2.value, 0)
            d = h @ last.w.value + last.b.value
            d = np.exp(d - d.max(1, keepdims=True))
            d /= d.sum(1, keepdims=True)
            d[np.arange(len(d)), label[p]] -= 1
            d /= n
            last.w.grad += h.T @ d
            last.b.grad += d.sum(0)
            mean, along = _through(d @ last.w.value.T * (h > 0), z2[p], scale2, shift2, g2[p], mean, along)
        mean1, along1 = np.zeros(z1.shape[1]), np.zeros(z1.shape[1])
        for p in parts:
            h = np.maximum(z1[p] * scale1.value + shift1.value, 0)
            d = inv2 * (g2[p] - mean / n - z2[p] * (along / n))
            two.w.grad += h.T @ d
            mean1, along1 = _through(d @ two.w.value.T * (h > 0), z1[p], scale1, shift1, g1[p], mean1, along1)
        cross = np.zeros_like(one.w.value)
        for p in parts:
            d = inv1 * (g1[p] - mean1 / n - z1[p] * (along1 / n))
            cross += rows[p].T @ d
        one.w.grad = w[:, None] * cross
        own = (cross * one.w.value).sum(1, keepdims=True)
        ad.Var(0.0, ((weights, lambda g: g * own),)).backward()


#: Samples whose layers are worked out at a time.
PART = 4096


def _through(g: np.ndarray, z: np.ndarray, scale: ad.Var, shift: ad.Var, out: np.ndarray, mean: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Takes a gradient through scale and shift into out; the sums that the standardisation before them needs."""
    scale.grad += (g * z).sum(0)
    shift.grad += g.sum(0)
    out[:] = g * scale.value
    return mean + out.sum(0), along + (out * z).sum(0)


def Var_t(w: ad.Var) -> ad.Var:  # noqa: N802
    """The transpose of a variable."""
    return ad.Var(w.value.T, ((w, lambda g: g.T),))


#: What a trial of an outcome model may set, with the values that are used where it doesn't.
SETTINGS = {"kind": "GCN", "hidden": 16, "layers": 2, "reduction": "ae", "drop": 0.4, "rate": 5e-3, "epochs": 60}
_TASK = "rep int, trial int, fold int, inner int, kind_of string, hidden int, layers int, reduction string, drop double, rate double, epochs int"
_KEYS = ["rep", "trial", "fold", "inner"]
#: Cells of a matrix that a task takes as a whole.
WHOLE = 1 << 22


def _outcomes(edges: DataFrame, long: DataFrame, target: DataFrame, clinical: DataFrame | None, names: list[str] | None, k: int, inner: int, repeats: int, share: float | None, seed: int) -> Callable[[list[dict]], DataFrame]:
    """What gives scores of every task's test samples. Scaling and node features come from the task's training samples alone.

    A task has a repeat, a fold that is set aside and, inside the others, a fold to test on (inner; -1 tests on the one
    set aside). With a share, the one fold of a repeat is a hold-out of that share of every class. Tasks of a matrix of up to WHOLE
    cells are Spark's; those of a larger one are fitted together, over blocks of the samples.
    """
    known = target.where("y is not null").select("sample_id", "y")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("feature")).distinct()
    long = long.join(nodes, "feature", "left_semi")
    if long.isEmpty():
        raise ValueError("network and matrix share no feature")
    rows, names_ = packed(long, known)
    places = known.select("sample_id").distinct()
    for r in range(repeats):
        place = _shuffled(known, seed + r)
        if share is not None:
            size = known.groupBy(F.col("y").alias("_y")).agg(F.count("*").alias("_all"))
            place = place.join(size, F.col("y") == F.col("_y")).withColumn("_place", F.when(F.col("_place") < F.round(share * F.col("_all")), 0).otherwise(F.col("_place") * 2 + 1))
        places = places.join(place.select("sample_id", F.col("_place").cast("long").alias(f"_{r}")), "sample_id")
    rows = rows.join(places.select("sample_id", F.array(*[f"_{r}" for r in range(repeats)]).alias("place")), "sample_id")
    if clinical is not None and names:
        rows = rows.join(clinical.groupBy("sample_id").agg(*[F.first(F.col(c).cast("double"), True).alias(f"_{i}") for i, c in enumerate(sorted(names))]).select("sample_id", F.array(*[F.coalesce(f"_{i}", F.lit(float("nan"))) for i in range(len(names))]).alias("clinical")), "sample_id", "left")
    # one row a sample, with all that tasks need of it
    parts = rows.select(F.lit("d").alias("part"), F.col("sample_id").alias("src"), *[c for c in rows.columns if c != "sample_id"]).unionByName(edges.select(F.lit("e").alias("part"), "src", "dst", "weight"), allowMissingColumns=True)
    cut = 2 if share is not None else k

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        rep, _, fold, within = (int(v) for v in key)
        one = p.iloc[0]
        e, d = p[p["part"] == "e"], p[p["part"] == "d"].sort_values("src")
        x, y, samples = unpacked(d.rename(columns={"src": "sample_id"}), len(names_))
        train, test = together.sides(np.stack(d["place"].to_numpy())[:, rep], fold, within, cut, inner)
        classes, label = np.unique(y, return_inverse=True)
        mean, sd = _spread(x, train)
        x -= mean
        x /= np.where(sd > 0, sd, 1)
        if "clinical" in d:
            empty = np.full(len(names), np.nan)
            own = np.stack([v if v is not None else empty for v in d["clinical"]])
            own = own[train][:, np.isfinite(own).any(0)]
            feats = together.node_features(np.array([[_training_r(x[train, f], own[:, v]) for v in range(own.shape[1])] for f in range(len(names_))]))
        else:
            feats = _random_features(len(names_))
        net = Outcome(str(one["kind_of"]), feats.shape[1], len(names_), len(classes), int(one["hidden"]), int(one["layers"]), str(one["reduction"]), drop=float(one["drop"]), seed=seed)
        g = _with_loops(dense(e, names_))
        net.fit(feats, g, x[train], label[train], int(one["epochs"]), float(one["rate"]), seed=seed)
        held = np.flatnonzero(test)
        z = np.concatenate([net.scores(feats, g, x[held[i : i + PART]]).value for i in range(0, max(1, len(held)), PART)])
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        i, j = np.indices(z.shape)
        out = pd.DataFrame({"sample_id": np.array(samples)[test][i.ravel()], "y": y[test][i.ravel()], "class": classes[j.ravel()], "score": z.ravel()})
        return out.assign(**dict(zip(_KEYS, key, strict=True)))

    data = written(parts, "outcome-rows")
    given = data.where("part = 'd'").drop("part", "dst", "weight").withColumnRenamed("src", "sample_id")

    @functools.cache
    def samples() -> together.Samples:
        return together.Samples(given, len(names_), len(names) if "clinical" in given.columns else 0, repeats, cut, inner)

    def fit(tasks: list[dict]) -> DataFrame:
        settings = {tuple(t[c] for c in _KEYS): {**SETTINGS, **t} for t in tasks}
        if given.count() * len(names_) > WHOLE:
            g = _with_loops(dense(data.where("part = 'e'").select("src", "dst", "weight").toPandas(), names_))

            def made(key: together.Run, of: together.Training) -> together.Fit:
                t = settings[key]
                feats = together.node_features(of.r) if "clinical" in given.columns else _random_features(len(names_))
                net = Outcome(t["kind"], feats.shape[1], len(names_), len(samples().classes), t["hidden"], t["layers"], t["reduction"], drop=t["drop"], seed=seed)
                return together.Fit(net, feats, g, of, t["epochs"], t["rate"], seed)

            return together.scored(samples(), list(settings), together.fitted(samples(), list(settings), made))
        rows = [(*key, t["kind"], t["hidden"], t["layers"], t["reduction"], float(t["drop"]), float(t["rate"]), t["epochs"]) for key, t in settings.items()]
        plan = edges.sparkSession.createDataFrame(rows, _TASK)
        return per_run(data, plan, _KEYS, run, "rep int, trial int, fold int, inner int, sample_id string, y double, class double, score double", len(names_))

    return fit


def _random_features(n: int) -> np.ndarray:
    return np.random.default_rng(1998).normal(size=(n, 7))


def _spread(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the columns over some rows, a column at a time; columns of one value, but for rounding, have none."""
    both = np.array([(c.mean(), c.std()) for c in (x[rows, j] for j in range(x.shape[1]))]).reshape(-1, 2)
    return both[:, 0], np.where(both[:, 1] <= 1e-13 * np.abs(both[:, 0]), 0.0, both[:, 1])


def _training_r(a: np.ndarray, b: np.ndarray) -> float:
    both = np.isfinite(a) & np.isfinite(b)
    return float(special.pearson(a[both], b[both])) if both.sum() > 2 else 0.0


def predict(edges: DataFrame, long: DataFrame, target: DataFrame, clinical: DataFrame | None = None, names: list[str] | None = None, k: int = 3, repeats: int = 1, share: float | None = None, seed: int = 0, **settings) -> DataFrame:
    """(rep, fold, sample_id, y, class, score): class scores of held-out samples, by stratified folds or, with a share, hold-outs; repeated.

    Without clinical variables nodes get random features. Features are the nodes of the network that the matrix has.
    """
    if set(settings) - set(SETTINGS):
        raise ValueError(f"unknown settings {sorted(set(settings) - set(SETTINGS))}")
    tasks = [{"rep": r, "trial": 0, "fold": f, "inner": -1, **settings} for r in range(repeats) for f in range(1 if share is not None else k)]
    return _outcomes(edges, long, target, clinical, names, k, 1, repeats, share, seed)(tasks).drop("trial", "inner")


def evaluate(*args, **options) -> dict[str, DataFrame]:
    """Scores of `predict`, metrics of each repeat and fold with the most accurate one marked, and their mean and deviation."""
    scores = saved(predict(*args, **options))
    per = saved(metrics(scores, ["rep", "fold"]))
    best = per.agg(F.max_by(F.struct("rep", "fold"), F.struct("accuracy", -F.col("rep"), -F.col("fold"))).alias("_best"))
    return {"scores": scores, "runs": per.join(F.broadcast(best)).withColumn("best", F.struct("rep", "fold") == F.col("_best")).drop("_best"), "summary": summary(per, ["rep", "fold"])}


def metrics(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, macro and weighted F1, macro recall and precision, and one-against-rest AUC and average precision, for each group of keys."""
    best = scores.groupBy(*keys, "sample_id", "y").agg(F.max_by("class", F.struct("score", -F.col("class"))).alias("guess"))
    truth = best.groupBy(*keys, F.col("y").alias("c")).agg(F.count("*").alias("n"), F.count_if(F.col("guess") == F.col("y")).alias("hit"))
    said = best.groupBy(*keys, F.col("guess").alias("c")).agg(F.count("*").alias("said"))
    per = truth.join(said, [*keys, "c"], "left").na.fill(0, ["said"])
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    recall, precision, f1 = div(F.col("hit"), F.col("n")), div(F.col("hit"), F.col("said")), div(2 * F.col("hit"), F.col("n") + F.col("said"))
    one = per.groupBy(*keys).agg((F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(f1).alias("f1_macro"), (F.sum(f1 * F.col("n")) / F.sum("n")).alias("f1_weighted"), F.avg(recall).alias("recall_macro"), F.avg(precision).alias("precision_macro"))
    by = scores.withColumn("pos", (F.col("y") == F.col("class")).cast("int")).groupBy(*keys, "class", "score").agg(F.count("*").alias("n"), F.sum("pos").alias("p"))
    w = Window.partitionBy(*keys, "class")
    up = w.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    down = w.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = by.withColumns({"r": F.coalesce(F.sum("n").over(up), F.lit(0)) + (F.col("n") + 1) / 2, "tp": F.sum("p").over(down), "seen": F.sum("n").over(down)})
    curve = ranked.groupBy(*keys, "class").agg(F.sum(F.col("r") * F.col("p")).alias("s"), F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(F.col("p") * F.col("tp") / F.col("seen")).alias("ap"))
    areas = curve.groupBy(*keys).agg(F.avg((F.col("s") - F.col("P") * (F.col("P") + 1) / 2) / F.nullif(F.col("P") * (F.col("N") - F.col("P")), F.lit(0))).alias("auc"), F.avg(F.col("ap") / F.nullif("P", F.lit(0))).alias("aupr"))
    return one.join(areas, keys)


def summary(per_fold: DataFrame, keys: list[str]) -> DataFrame:
    """(metric, average, deviation) over folds or repeats."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in per_fold.columns if c not in keys])
    return per_fold.select(F.inline(cells)).groupBy("metric").agg(F.avg("v").alias("average"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("deviation"))


def settings_of(trials: int, seed: int = 0) -> list[dict]:
    """Random settings of an outcome model."""
    rng = np.random.default_rng(seed)
    pick = lambda *values: values[int(rng.integers(len(values)))]
    return [{"kind": pick("GCN", "GAT", "SAGE", "GIN"), "hidden": pick(8, 16, 32), "layers": pick(2, 3), "reduction": pick("ae", "linear", "mlp"), "drop": pick(0.2, 0.4, 0.6), "rate": float(10 ** rng.uniform(-3, -2)), "epochs": pick(30, 60, 120)} for _ in range(trials)]


def tune_outcome(edges: DataFrame, long: DataFrame, target: DataFrame, trials: int = 3, k: int = 3, inner: int = 5, seed: int = 0, clinical: DataFrame | None = None, names: list[str] | None = None, settings: list[dict] | None = None) -> dict[str, DataFrame]:
    """Nested tuning: for every outer fold the trial of the best mean macro F1 over inner folds of the others is fitted on all of
    them and judged on the fold that was set aside. chosen: (fold, trial, inner_f1, setting), runs: metrics of the outer folds.
    """
    tried = settings or settings_of(trials, seed)
    tasks = [{"rep": 0, "trial": t, "fold": f, "inner": i, **s} for t, s in enumerate(tried) for f in range(k) for i in range(inner)]
    fit = _outcomes(edges, long, target, clinical, names, k, inner, 1, None, seed)
    scores = saved(fit(tasks))  # metrics reads them more than once
    mean = metrics(scores, ["fold", "trial", "inner"]).groupBy("fold", "trial").agg(F.avg("f1_macro").alias("inner_f1"))
    best = mean.groupBy("fold").agg(F.max_by(F.struct("trial", "inner_f1"), F.struct("inner_f1", -F.col("trial"))).alias("b")).select("fold", "b.*").orderBy("fold").collect()
    outer = saved(fit([{"rep": 0, "trial": r["trial"], "fold": r["fold"], "inner": -1, **tried[r["trial"]]} for r in best]))
    chosen = edges.sparkSession.createDataFrame([(r["fold"], r["trial"], r["inner_f1"], str(tried[r["trial"]])) for r in best], "fold int, trial int, inner_f1 double, setting string")
    return {"chosen": chosen, "runs": metrics(outer, ["fold"])}


#: Fits that run beside each other.
FITS = 3


def baseline(long: DataFrame, target: DataFrame, model: str = "lr", k: int = 3, seed: int = 0) -> DataFrame:
    """(fold, accuracy, f1) of a Spark ML classifier: lr, rf, dt, gbt (two classes), mlp or svm (two classes)."""
    from pyspark.ml import classification as ml
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    from plexmat.sources.frames import row_vectors

    data = row_vectors(long).join(stratified(target, k, seed), "sample_id").select(array_to_vector("x").alias("features"), F.col("y").alias("label"), "fold").cache()
    size, classes = len(data.head()["features"]), int(data.agg(F.max("label")).head()[0]) + 1
    make = {"lr": lambda: ml.LogisticRegression(maxIter=50), "rf": lambda: ml.RandomForestClassifier(numTrees=50, seed=seed), "dt": lambda: ml.DecisionTreeClassifier(seed=seed), "gbt": lambda: ml.GBTClassifier(maxIter=20, seed=seed), "mlp": lambda: ml.MultilayerPerceptronClassifier(layers=[size, 32, classes], seed=seed), "svm": lambda: ml.LinearSVC(maxIter=50)}

    def fold(f: int) -> tuple:
        guess = make[model]().fit(data.where(F.col("fold") != f)).transform(data.where(F.col("fold") == f))
        return (f, *[float(MulticlassClassificationEvaluator(metricName=m).evaluate(guess)) for m in ("accuracy", "f1")])

    # a fit is many short jobs one after the other, so a few folds are fitted beside each other
    with ThreadPool(min(k, FITS)) as pool:
        fits = [inheritable_thread_target(long.sparkSession)(functools.partial(fold, f)) for f in range(k)]
        rows = pool.map(lambda fit: fit(), fits, chunksize=1)
    data.unpersist()
    return long.sparkSession.createDataFrame(rows, "fold int, accuracy double, f1 double")


# ---- network search -------------------------------------------------------------------------------


def proxy_score(x: np.ndarray, y: np.ndarray, folds: int = 5, ridge: float = 1.0) -> float:
    """Macro F1 of a ridge classifier by stratified folds."""
    classes, label = np.unique(y, return_inverse=True)
    fold = np.empty(len(y), int)
    for c in range(len(classes)):
        at = np.flatnonzero(label == c)
        fold[at] = np.arange(len(at)) % folds
    guess = np.zeros(len(y), int)
    for f in range(folds):
        a = fold != f
        z = np.column_stack([x, np.ones(len(x))])
        t = (label[a][:, None] == np.arange(len(classes))) * 2.0 - 1
        w = np.sqrt(len(y) / np.maximum(np.bincount(label[a], minlength=len(classes))[label[a]], 1))[:, None]
        b = np.linalg.solve((z[a] * w).T @ (z[a] * w) + ridge * np.eye(z.shape[1]), (z[a] * w).T @ (t * w))
        guess[~a] = (z[~a] @ b).argmax(1)
    f1 = [2 * ((guess == c) & (label == c)).sum() / max(1, (guess == c).sum() + (label == c).sum()) for c in range(len(classes))]
    return float(np.mean(f1))


def parameter_grid(methods: list[str], **values: dict[str, list]) -> list[dict]:
    """All combinations of the values of each method's parameters, with the method's name."""
    out = []
    for m in methods:
        own = values.get(m, GRIDS[m])
        out += [{"method": m, **dict(zip(own, v, strict=True))} for v in itertools.product(*own.values())]
    return out


#: What a search tries by default.
GRIDS = {
    "gaussian": {"k": list(range(5, 30)), "sigma": [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, None], "mutual_only": [True, False]},
    "similarity": {"k": list(range(5, 30)), "metric": ["cosine", "gaussian"], "mutual_only": [True, False]},
    "correlation": {"k": list(range(5, 30)), "by": ["pearson", "spearman"], "signed_map": [False]},
    "threshold": {"b": [5.0, 5.5, 6.0, 6.25, 6.5, 6.75, 7.0, 7.25, 7.5, 7.75, 8.0, 8.5, 9.0], "k": list(range(5, 30)), "mutual_only": [True, False]},
}


def network_search(long: DataFrame, target: DataFrame, settings: list[dict] | None = None, methods: list[str] | None = None, trials: int | None = None, weight: float = 0.15, mode: str = "eigenvector", seed: int = 1883) -> DataFrame:
    """(config, score, f1, topology): networks by each setting (a builder's name and arguments), scored by how well features
    weighted by centrality (or smoothed, mode laplacian) tell the phenotype, and by the topology of the network.

    Without settings the grids of the methods are tried, in a pseudorandom order, `trials` of them at most. A setting that
    fails is logged and left out; if all fail that is an error. `best_network` builds the network of the best. Weighted by
    centrality, all settings are one plan (`search`); smoothed, one is tried after another.
    """
    from plexmat.operators import analyze
    from plexmat.operators.similarity import BUILDERS, features_of

    if settings is None:
        grid = parameter_grid(methods or list(GRIDS))
        settings = [grid[i] for i in np.random.default_rng(seed).permutation(len(grid))[:trials]]
    long = saved(long)
    if mode == "eigenvector":
        plans = []
        for i, s in enumerate(settings):
            try:
                plans.append(search.plan_of(i, s))
            except (ValueError, TypeError) as why:
                log.get_logger(__name__).warning("setting %s left out: %s", s, why)
        found = written(search.search(long, target, plans, weight, proxy_score), "search") if plans else None
        if found is None or found.isEmpty():
            raise RuntimeError("no setting gave a network")
        names = long.sparkSession.createDataFrame([(i, str(s)) for i, s in enumerate(settings)], "config int, setting string")
        return found.join(names, "config").select("config", "setting", "score", "f1", "topology")
    rows = []
    nodes = saved(features_of(long).select(F.col("feature").alias("node"), F.col("fpos").alias("npos")))

    def measure(s: dict) -> tuple[float, float]:
        edges = saved(BUILDERS[s["method"]](long, self_loops=False, **_arguments(s)))
        quality = analyze.topology_quality(edges, nodes).head()["quality"]
        cells = written(analyze.smoothed(long, edges), "search-smoothed")
        data, names = packed(cells, target)
        found = ridge.macro_f1(written(data, "search-rows"), names, [(0, names)])
        if found is not None:
            return found.head()["f1"], quality

        def run(p: pd.DataFrame) -> pd.DataFrame:
            x, samples = matrix_of(p, sorted(set(p["feature"])))
            y = p.groupby("sample_id")["y"].first().reindex(samples).to_numpy()
            return pd.DataFrame({"f1": [proxy_score(special.zscore(x), y)]})

        return cells.join(target, "sample_id").withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(run, "f1 double").head()["f1"], quality

    for i, s in enumerate(settings):
        try:
            f1, quality = measure(s)
        except Exception as why:  # whatever a setting fails by, the others go on
            log.get_logger(__name__).warning("setting %s left out: %s", s, why)
            continue
        rows.append((i, str(s), (1 - weight) * f1 + weight * min(max(quality, 0.0), 1.0), f1, quality))
    if not rows:
        raise RuntimeError("no setting gave a network")
    return long.sparkSession.createDataFrame(rows, "config int, setting string, score double, f1 double, topology double")


def _arguments(setting: dict) -> dict:
    """What a builder is called with: the builder's name is `method`, its own argument of that name is `by`."""
    own = {k: v for k, v in setting.items() if k != "method"}
    return {**{k: v for k, v in own.items() if k != "by"}, **({"method": own["by"]} if "by" in own else {})}


def best_network(long: DataFrame, settings: list[dict], found: DataFrame) -> tuple[DataFrame, dict]:
    """The edges of the setting of the highest score, and the setting."""
    from plexmat.operators.similarity import BUILDERS

    best = settings[found.orderBy(F.desc("score"), "config").head()["config"]]
    return BUILDERS[best["method"]](long, self_loops=False, **_arguments(best)), best
