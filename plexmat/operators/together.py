"""Outcome models of many samples: all runs are fitted beside each other, an epoch being three passes over blocks of samples.

Full-batch gradients are sums over the samples, once the means and deviations that the layers are standardised by are known. Those of the
first layer follow from the products of the features, added up once for each set of training samples. Those of the second take
a pass, the sums that its standardisation needs on the way back another, the gradients a third. Spark adds up what the blocks
of a task give for all runs; the network's part of the models and Adam's steps are the driver's. No task holds more than a block
for a run, and no run gets a copy of the samples.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexmat.functions import autodiff as ad
from plexmat.functions import special
from plexmat.operators.condense import MERGED
from plexmat.plans.iterate import written

#: Samples of a block; cells of one at most.
PART, CELLS = 2048, 1 << 20
_EPS = 1e-5
_BLOCK = "n int, single boolean, x binary, label binary, place binary, clinical binary, ids array<string>"

#: A run: repeat, trial, fold set aside, and fold inside the others (-1: none).
Run = tuple[int, int, int, int]


def sides(place: np.ndarray, fold: int, within: int, cut: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """Which samples a run trains on and which it tests on, by their places."""
    aside = place % cut == fold
    test = aside if within < 0 else ~aside & (place // cut % inner == within)
    return ~aside & ~test, test


@dataclass
class Training:
    """Training samples: their number, means of the features (from the origin) and deviations, products of the standardised features
    over the number, and correlations with the clinical variables that any of them has."""

    n: int
    mean: np.ndarray
    sd: np.ndarray
    products: np.ndarray
    r: np.ndarray


class Samples:
    """Blocks of samples, and what fits share: the features' origin, classes, and how places make folds."""

    def __init__(self, rows: DataFrame, width: int, variables: int, repeats: int, cut: int, inner: int):
        """rows: (sample_id, y, at, v, place[, clinical]), see `iterate.packed`."""
        self.spark, self.width, self.variables, self.cut, self.inner = rows.sparkSession, width, variables, cut, inner
        self.classes = np.array(sorted(r["y"] for r in rows.select(F.col("y").cast("double").alias("y")).distinct().collect()))
        classes, part = self.classes, max(1, min(PART, CELLS // max(width, 1)))
        columns = ["sample_id", F.col("y").cast("double").alias("y"), "at", "v", "place", *(["clinical"] if variables else [])]

        def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in range(0, len(b), part):
                    c = b.iloc[i : i + part]
                    x = np.zeros((len(c), width))
                    for j, (at, v) in enumerate(zip(c["at"], c["v"], strict=True)):
                        x[j, at] = v
                    with np.errstate(over="ignore"):
                        short = x.astype("<f4")
                    single = bool((short == x).all())  # half the bytes where that loses nothing
                    empty = np.full(variables, np.nan)
                    own = np.array([empty if v is None else v for v in c["clinical"]], float) if variables else np.zeros(0)
                    label, place = np.searchsorted(classes, c["y"].to_numpy()).astype("<i4"), np.stack(c["place"].to_numpy()).astype("<i8")
                    yield pd.DataFrame({"n": [len(c)], "single": [single], "x": [(short if single else x).tobytes()], "label": [label.tobytes()], "place": [place.tobytes()], "clinical": [own.tobytes()], "ids": [c["sample_id"].tolist()]})

        self.blocks = written(rows.select(*columns).mapInPandas(lay, _BLOCK).repartition(4 * self.spark.sparkContext.defaultParallelism), "sample-blocks")
        one = _Block(self.blocks.drop("ids").head(), width, 0.0, repeats, variables)
        self.origin = one.x.mean(0)
        known = np.isfinite(one.clinical)
        self.zero = np.where(known, one.clinical, 0.0).sum(0) / np.maximum(known.sum(0), 1)
        self.repeats = repeats

    def read(self) -> Callable:
        """A reader of rows as blocks, fit to be sent to tasks."""
        width, origin, repeats, variables = self.width, self.origin, self.repeats, self.variables
        return lambda r: _Block(r, width, origin, repeats, variables)

    def added(self, visit: Callable[[object, _Block], Iterator[tuple[int, np.ndarray]]], given: object, *more: str) -> dict[int, np.ndarray]:
        """The sums over all blocks of the arrays that visit(given, block) yields under a number."""
        shared, read = self.spark.sparkContext.broadcast(given), self.read()

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: dict[int, np.ndarray] = {}
            for b in batches:
                for r in b.itertuples():
                    for k, s in visit(shared.value, read(r)):
                        if k in found:
                            found[k] += s
                        else:
                            found[k] = s
            yield pd.DataFrame({"part": TaskContext.get().partitionId(), "k": list(found), "s": [s.tobytes() for s in found.values()]})

        def merge(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(len(p["s"].iloc[0]) // 8)
            for s in p["s"]:
                total += np.frombuffer(s)
            return pd.DataFrame({"part": [int(key[1])], "k": [int(key[0])], "s": [total.tobytes()]})

        schema = "part int, k int, s binary"
        got, parts = self.blocks.select("n", "single", "x", "label", "place", *more).mapInPandas(add, schema), self.parts
        while parts > MERGED:  # so that the driver gets few arrays of a run
            got, parts = got.groupBy("k", F.expr(f"int(part / {MERGED})").alias("p")).applyInPandas(merge, schema), parts // MERGED + 1
        out: dict[int, np.ndarray] = {}
        for r in got.collect():
            s = np.frombuffer(r["s"])
            out[r["k"]] = out[r["k"]] + s if r["k"] in out else s
        shared.destroy()
        return out

    @functools.cached_property
    def parts(self) -> int:
        """Tasks of a pass."""
        return self.blocks.rdd.getNumPartitions()

    def trainings(self, sets: list[tuple[int, int, int]]) -> list[Training]:
        """Of the training samples of each (repeat, fold, fold inside)."""
        p, zero, variables, cut, inner = self.width, self.zero, self.variables, self.cut, self.inner

        def visit(given: list, b: _Block) -> Iterator[tuple[int, np.ndarray]]:
            for k, (rep, fold, within) in enumerate(given):
                train = sides(b.place[:, rep], fold, within, cut, inner)[0]
                x, sums = b.x[train], []
                for v in range(variables):
                    c = b.clinical[train, v]
                    known = np.isfinite(c)
                    z, c = x[known], c[known] - zero[v]
                    sums += [[len(c), c.sum(), c @ c], z.sum(0), np.einsum("ij,ij->j", z, z), c @ z]
                yield k, np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel(), *sums])

        sums = self.added(visit, sets, "clinical")
        return [self._training(sums[k], p) for k in range(len(sets))]

    def _training(self, s: np.ndarray, p: int) -> Training:
        n, mean = int(s[0]), s[1 : p + 1] / max(s[0], 1)
        m2 = s[p + 1 : p + 1 + p * p].reshape(p, p) / max(n, 1) - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(m2), 0))
        still = sd <= 1e-13 * np.abs(mean + self.origin)  # columns of one value, but for rounding
        sd = np.where(still | (sd == 0), 1.0, sd)
        m2[still] = m2[:, still] = 0.0
        r, at = [], 1 + p + p * p
        for _ in range(self.variables):
            (m, c, cc), z, zz, cz = s[at : at + 3], *s[at + 3 : at + 3 + 3 * p].reshape(3, p)
            at += 3 + 3 * p
            if m:
                d = np.sqrt(np.maximum((zz - z * z / m) * (cc - c * c / m), 0)) / sd
                r.append(np.where((d > 1e-12) & (m > 2), (cz - z * (c / m)) / sd / np.where(d > 1e-12, d, 1), 0.0))
        return Training(n, mean, sd, m2 / np.outer(sd, sd), np.array(r).reshape(len(r), p).T)


class _Block:
    """A block's arrays; features from their origin."""

    def __init__(self, r, width: int, origin: np.ndarray | float, repeats: int, variables: int):
        n = int(r.n)
        self.x = np.frombuffer(r.x, "<f4" if r.single else "<f8").reshape(n, width) - np.asarray(origin, float)
        self.label, self.place = np.frombuffer(r.label, "<i4"), np.frombuffer(r.place, "<i8").reshape(n, repeats)
        self.clinical = np.frombuffer(r.clinical).reshape(n, variables) if hasattr(r, "clinical") else None


class Fit:
    """A run's model while it is fitted, as `learn.Outcome.fit` does."""

    def __init__(self, net, feats: np.ndarray, g: tuple, of: Training, epochs: int, rate: float, seed: int, decay: float = 1e-4):
        self.net, self.feats, self.g, self.of, self.epochs, self.rate, self.t = net, feats, g, of, epochs, rate, 0
        self.opt, self.rng = ad.Adam(net.params, rate, decay), np.random.default_rng(seed)
        self.reference = np.zeros(net.head[1].w.value.shape[1])

    def first(self) -> dict:
        """What a pass needs to get to the second layer."""
        (one, two, _), (scale, shift, stats) = self.net.head, self.net.norm[0]
        self.weights = self.net.weights(self.feats, self.g, self.rng)
        self.own = self.weights.value * one.w.value
        var = np.maximum((self.own * (self.of.products @ self.own)).sum(0), 0)
        self.inv1 = 1 / np.sqrt(var + _EPS)
        _run(stats, one.b.value, var)
        a = self.own / self.of.sd[:, None] * (self.inv1 * scale.value)
        self.given = {"a": a, "c": shift.value - self.of.mean @ a, "w2": two.w.value, "ref": self.reference, "n": self.of.n}
        return self.given

    def second(self, sums: np.ndarray) -> dict:
        """What it needs besides to get to the scores, by the sums of the second layer."""
        (_, two, last), (scale, shift, stats) = self.net.head, self.net.norm[1]
        m, sq = sums.reshape(2, -1) / max(self.of.n, 1)
        var, mean = np.maximum(sq - m * m, 0), m + self.reference
        self.inv2, self.reference = 1 / np.sqrt(var + _EPS), mean
        _run(stats, mean + two.b.value, var)
        self.given |= {"inv": self.inv2, "mean": mean, "scale": scale.value, "shift": shift.value, "w3": last.w.value, "b3": last.b.value}
        return self.given

    def third(self, sums: np.ndarray) -> dict:
        """And back, by the sums of the scores' gradients."""
        (_, _, last), (scale, shift, _) = self.net.head, self.net.norm[1]
        b, c = last.w.value.shape
        last.w.grad, last.b.grad, shift.grad, scale.grad = np.split(sums, np.cumsum([b * c, c, b]))
        last.w.grad = last.w.grad.reshape(b, c)
        n = max(self.of.n, 1)
        self.given |= {"back": scale.value * shift.grad / n, "along": scale.value * scale.grad / n}
        return self.given

    def close(self, sums: np.ndarray) -> None:
        """Adam's step, by the sums of the gradients."""
        (one, two, _), (scale, shift, _) = self.net.head, self.net.norm[0]
        p, a = one.w.value.shape
        b = two.w.value.shape[1]
        w2, cross, total = np.split(sums, np.cumsum([a * b, p * a]))
        two.w.grad, shift.grad = w2.reshape(a, b), total
        one.b.grad, two.b.grad = np.zeros(a), np.zeros(b)  # standardising takes them out
        cross, z = (cross.reshape(p, a) - np.outer(self.of.mean, total)) / self.of.sd[:, None], self.own * self.inv1
        scale.grad = (z * cross).sum(0)
        cross = self.inv1 * scale.value * (cross - (self.of.products @ z) * scale.grad)
        one.w.grad = self.weights.value * cross
        own = (cross * one.w.value).sum(1, keepdims=True)
        ad.Var(0.0, ((self.weights, lambda g: g * own),)).backward()
        self.opt.step(1e-6 + (self.rate - 1e-6) * (1 + np.cos(np.pi * self.t / self.epochs)) / 2)
        self.t += 1

    def model(self) -> dict:
        """The fitted model: layers are standardised by their running figures."""
        (one, two, last), ((scale, shift, s1), (scale2, shift2, s2)) = self.net.head, self.net.norm
        inv = scale.value / np.sqrt(s1["s"] + _EPS)
        a = self.net.weights(self.feats, self.g).value * one.w.value / self.of.sd[:, None] * inv
        c = shift.value + (one.b.value - s1["m"]) * inv - self.of.mean @ a
        return {"a": a, "c": c, "w2": two.w.value, "mean": s2["m"] - two.b.value, "inv": 1 / np.sqrt(s2["s"] + _EPS), "scale": scale2.value, "shift": shift2.value, "w3": last.w.value, "b3": last.b.value}


def _run(stats: dict, m: np.ndarray, s: np.ndarray) -> None:
    stats["m"], stats["s"] = 0.9 * stats.get("m", m) + 0.1 * m, 0.9 * stats.get("s", s) + 0.1 * s


def _layer(x: np.ndarray, w: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The first layer, samples as columns: what runs along them is fast."""
    h = w.T @ x.T
    h += c[:, None]
    return np.maximum(h, 0, out=h)


def _scores(z: np.ndarray, g: dict) -> tuple[np.ndarray, np.ndarray]:
    """The second layer and class probabilities; z is standardised on the way."""
    z -= g["mean"][:, None]
    z *= g["inv"][:, None]
    h = z * g["scale"][:, None]
    h += g["shift"][:, None]
    np.maximum(h, 0, out=h)
    d = g["w3"].T @ h
    d += g["b3"][:, None]
    d -= d.max(0)
    np.exp(d, out=d)
    d /= d.sum(0)
    return h, d


def step(x: np.ndarray, label: np.ndarray, g: dict) -> np.ndarray:
    """A run's sums over some of its training samples: of the second layer, of the scores' gradients or of all gradients, by what is given."""
    h = _layer(x, g["a"], g["c"])
    z = g["w2"].T @ h
    if "inv" not in g:
        z -= g["ref"][:, None]
        return np.concatenate([z.sum(1), np.einsum("ij,ij->i", z, z)])
    top, d = _scores(z, g)
    d[label, np.arange(len(label))] -= 1
    d /= g["n"]
    e = g["w3"] @ d
    e *= top > 0
    if "back" not in g:
        return np.concatenate([(top @ d.T).ravel(), d.sum(1), e.sum(1), np.einsum("ij,ij->i", e, z)])
    e *= g["scale"][:, None]
    e -= g["back"][:, None]
    z *= g["along"][:, None]
    e -= z
    e *= g["inv"][:, None]
    f = g["w2"] @ e
    f *= h > 0
    return np.concatenate([(h @ e.T).ravel(), (f @ x).T.ravel(), f.sum(1)])


def fitted(samples: Samples, runs: list[Run], made: Callable[[Run, Training], Fit]) -> list[dict]:
    """The models of all runs."""
    cut, inner = samples.cut, samples.inner
    sets = sorted({(r, f, i) for r, _, f, i in runs})
    of = dict(zip(sets, samples.trainings(sets), strict=True))
    fits = [made(r, of[r[0], r[2], r[3]]) for r in runs]

    def visit(given: list, b: _Block) -> Iterator[tuple[int, np.ndarray]]:
        last, x, label = None, None, None
        for k, (rep, fold, within), g in given:  # in order of the sets
            if (rep, fold, within) != last:
                last, train = (rep, fold, within), sides(b.place[:, rep], fold, within, cut, inner)[0]
                x, label = b.x[train], b.label[train]
            if len(x):
                yield k, step(x, label, g)

    order = sorted(range(len(runs)), key=lambda k: (runs[k][0], runs[k][2], runs[k][3]))
    while True:
        open_ = [k for k in order if fits[k].t < fits[k].epochs]
        if not open_:
            return [f.model() for f in fits]
        sums = None
        for phase in (Fit.first, Fit.second, Fit.third):
            sums = samples.added(visit, [(k, (runs[k][0], *runs[k][2:]), phase(fits[k], *([] if sums is None else [sums[k]]))) for k in open_])
        for k in open_:
            fits[k].close(sums[k])


def scored(samples: Samples, runs: list[Run], models: list[dict]) -> DataFrame:
    """(rep, trial, fold, inner, sample_id, y, class, score) of the samples that runs test on."""
    cut, inner, classes, read = samples.cut, samples.inner, samples.classes, samples.read()
    shared = samples.spark.sparkContext.broadcast(list(zip(runs, models, strict=True)))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                b, ids = read(r), np.asarray(r.ids, object)
                for (rep, trial, fold, within), g in shared.value:
                    test = sides(b.place[:, rep], fold, within, cut, inner)[1]
                    if not test.any():
                        continue
                    s = _scores(g["w2"].T @ _layer(b.x[test], g["a"], g["c"]), g)[1].T
                    i, j = np.indices(s.shape)
                    yield pd.DataFrame({"rep": rep, "trial": trial, "fold": fold, "inner": within, "sample_id": ids[test][i.ravel()], "y": classes[b.label[test]][i.ravel()], "class": classes[j.ravel()], "score": s.ravel()})

    schema = "rep int, trial int, fold int, inner int, sample_id string, y double, class double, score double"
    return samples.blocks.select("n", "single", "x", "label", "place", "ids").mapInPandas(judge, schema)


def node_features(r: np.ndarray) -> np.ndarray:
    """Nodes' features of their correlations with clinical variables."""
    return special.zscore(np.arctanh(np.clip(r, -0.999999, 0.999999)), ddof=1)
