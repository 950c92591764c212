"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow trees are boosted on statistics of a bounded sample of labelled documents; every path from a root is a rule
(a conjunction of `statistic <= cut` and `statistic > cut`); lasso logistic regression by accelerated proximal
gradient keeps a few dozen of them; and these are compiled into one Spark column, so scoring runs no Python.

Null and empty texts have all statistics 0 and are scored like any other; labels that are null or whose document is
missing are left out, of a document labelled more than once the lowest label counts, and without labels of both
kinds every score is the share of label 1 (0.5 without any). Repeated rows get equal scores; of labelled rows with the same
id one counts; null ids are scored and never learnt from; texts of any length are read whole; ties of cuts go to the first
statistic and the lowest cut; a table without rows gives none; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexmat.llm.textstats import base_counts

#: Labelled documents that a model is fitted on at most, chosen by a hash of their id.
SAMPLE = 20_000


def statistics(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """Ratios of counts of each text, as doubles named s_*; the names."""
    df = base_counts(docs, keep, more=True)
    words, chars, letters = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("n_letters", F.lit(1))
    ratios = {
        "s_words": F.log1p("n_words"),
        "s_word_length": F.col("word_chars") / words,
        "s_upper": F.col("n_upper") / letters,
        "s_letters": F.col("n_letters") / chars,
        "s_symbols": F.col("n_symbols") / words,
        "s_digits": F.col("n_digits") / chars,
        "s_bangs": F.col("n_bangs") / words,
        "s_pipes": F.col("n_pipes") / words,
        "s_punct": F.col("n_punct") / words,
        "s_distinct": F.col("n_distinct_words") / words,
        "s_repeats": F.col("n_repeat_words") / words,
        "s_dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "s_line_words": F.log1p(F.col("n_words") / F.greatest("n_lines", F.lit(1))),
    }
    return df.select(*keep, *[c.cast("double").alias(n) for n, c in ratios.items()]), list(ratios)


@dataclass
class Rules:
    """The fitted rules: each a tuple of (statistic, above, cut) with a weight."""

    names: list[str]
    intercept: float
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score as a Spark column over the statistics."""
        terms = [F.lit(self.intercept)]
        for parts, weight in self.rules:
            tests = [(F.col(self.names[j]) > cut) if above else (F.col(self.names[j]) <= cut) for j, above, cut in parts]
            terms.append(F.when(reduce(lambda a, b: a & b, tests), F.lit(weight)).otherwise(F.lit(0.0)))
        return 1.0 / (1.0 + F.exp(-reduce(lambda a, b: a + b, terms)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for parts, weight in self.rules:
            z += weight * holds(parts, x)
        return 1 / (1 + np.exp(-z))


def holds(parts: tuple[tuple[int, bool, float], ...], x: np.ndarray) -> np.ndarray:
    """Which rows of x a rule holds for."""
    out = np.ones(len(x), bool)
    for j, above, cut in parts:
        out &= (x[:, j] > cut) if above else (x[:, j] <= cut)
    return out


def _grow(x: np.ndarray, grad: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, path: tuple, least: int, out: list) -> list[tuple[np.ndarray, float]]:
    """Splits rows by the cut that lowers the squared error of grad most; adds every path to out; returns the leaves."""
    if path:
        out.append(path)
    best = (1e-9, -1, 0.0)
    if depth and len(rows) >= 2 * least:
        g = grad[rows]
        total, n = g.sum(), len(rows)
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            at = np.searchsorted(cut, x[rows, j], side="left")
            num, sums = np.bincount(at, minlength=len(cut) + 1), np.bincount(at, weights=g, minlength=len(cut) + 1)
            left, low = np.cumsum(num)[:-1], np.cumsum(sums)[:-1]
            fits = (left >= least) & (n - left >= least)
            gain = np.where(fits, low**2 / np.maximum(left, 1) + (total - low) ** 2 / np.maximum(n - left, 1) - total**2 / n, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(cut[k]))
    if best[1] < 0:
        return [(rows, float(grad[rows].mean()) if len(rows) else 0.0)]
    _, j, cut = best
    below = x[rows, j] <= cut
    return _grow(x, grad, rows[below], cuts, depth - 1, (*path, (j, False, cut)), least, out) + _grow(x, grad, rows[~below], cuts, depth - 1, (*path, (j, True, cut)), least, out)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.5, seed: int = 7) -> list[tuple]:
    """The distinct paths of boosted trees, each tree grown on half of the rows."""
    rng, cuts = np.random.default_rng(seed), [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1])) for c in x.T]
    z, out = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.sort(rng.permutation(len(y))[: max(1, (len(y) + 1) // 2)])
        paths: list[tuple] = []
        grown = _grow(x, y - p, rows, cuts, depth, (), max(5, len(y) // 500), paths)
        if not paths:
            break
        out += paths
        for leaf, _ in grown:
            # The rows of a leaf get a Newton step; rows outside the half are moved by the leaf's rule below.
            step = (y[leaf] - p[leaf]).sum() / max((p[leaf] * (1 - p[leaf])).sum(), 1e-3)
            z[leaf] += rate * np.clip(step, -4, 4)
    return list(dict.fromkeys(tuple(sorted(p)) for p in out))


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, the intercept free, by accelerated proximal gradient."""
    n, m = r.shape
    w, b, v, c, t = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(m), 0.0, 1.0
    c = b
    probe = np.ones(m + 1) / np.sqrt(m + 1)
    for _ in range(20):  # the largest eigenvalue of the Gram matrix bounds the step
        s = r @ probe[:m] + probe[m]
        probe = np.append(r.T @ s, s.sum())
        size = np.linalg.norm(probe)
        probe /= size
    step = 4 * n / (1.05 * size)
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(r @ v + c))) - y
        w2 = v - step * (r.T @ g) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * g.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c, w, b, t = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b), w2, b2, t2
    return w, float(b)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 5e-4) -> Rules:
    """The rule ensemble for statistics x and labels y (0 or 1)."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Rules(names, float(np.log(share / (1 - share))))
    paths = tree_rules(x, y)
    if not paths:
        return Rules(names, float(np.log(share / (1 - share))))
    r = np.stack([holds(p, x) for p in paths], 1).astype(float)
    w, b = lasso(r, y, penalty)
    return Rules(names, b, [(p, float(k)) for p, k in zip(paths, w, strict=True) if k])


def train(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, sample: int = SAMPLE) -> Rules:
    """Fits on at most `sample` labelled documents that are not held out; only their statistics reach the driver."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.min(label).cast("double").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    stats, names = statistics(texts, ("doc_id", "_y"))
    one = stats.groupBy("doc_id").agg(F.min(F.struct("_y", *names)).alias("_s")).select("doc_id", "_s.*")  # however often an id comes
    rows = one.toPandas().sort_values("doc_id")
    return fit(rows[names].to_numpy(float), rows["_y"].to_numpy(float), names)


def held_out(of: int, at: int) -> Column:
    """Whether the crc32 of the id as text leaves the remainder `at`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of == at


def score(docs: DataFrame, model: Rules, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with the score of each text."""
    stats, _ = statistics(docs, keep)
    return stats.select(*keep, model.column().alias("score"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row for each document: held_out, score, predicted."""
    fold = held_out(4, 2)
    model = train(docs, labels, "quality", fold)
    scored = score(docs, model)
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs whose score is at least the threshold, unchanged."""
    model = train(docs, labels, "quality", held_out(4, 2))
    packed = docs.select("text", F.struct(*docs.columns).alias("_own"))
    return score(packed, model, ("_own",)).where(F.col("score") >= threshold).select("_own.*")
