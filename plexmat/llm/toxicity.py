"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word (lower case, outer punctuation off) is the bag of its character 3- to 5-grams with the word's ends marked, and
the marked word itself; each is hashed to a row of a table of vectors. A passage of WINDOW words is the average of its
words' vectors, its two class scores are linear in that average, and a document is toxic if any passage is (noisy or).
Vectors and class weights are learnt together by Adam on a bounded sample of labelled documents. A misspelling
that was never seen shares most of its n-grams, hence most of its vector, with the word it stands for.

Rows of the table that fewer than MIN_DOCS training documents touch stay zero and n-grams are dropped at random while
training, so that documents aren't learnt by heart; a part of the labelled documents is kept from the fit, and the
log-odds of passages are moved to where 0.5 parts its classes best (by F1).

Since everything after the lookup is linear, a word's share of a passage's score is one number, which workers
keep for words seen before; whole texts are scored in one pass, whatever their length.

Null and empty texts have no passage and score the fitted prior of an empty passage; null labels and labels
without a document are left out, of a document labelled more than once the highest label counts, of labelled rows with the
same id the lowest text; without labels of both kinds the score is the share of label 1 (0.5 without any). Repeated rows
get equal scores; null ids are scored and never learnt from; a table without rows gives none; other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexmat.llm.common import SPACE_CLASS, written

#: Fixed parameters of the features: words to a passage, rows of the vector table, length of the n-grams.
WINDOW, ROWS, GRAMS = 2, 1 << 17, (3, 4, 5)
#: Training documents that a row of the table must be touched by; share of n-grams dropped; share of labelled documents kept from the fit.
MIN_DOCS, DROP, KEPT_OUT = 5, 0.2, 0.2
#: Labelled documents to fit on at most, of either class, chosen by a hash of their id; and the characters that they may have together.
SAMPLE, MOST_CHARS = 3_000, 15_000_000
_WORD = re.compile(f"[^{SPACE_CLASS}]+")
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_OUTER = ".,;:!?\"'()[]{}|#*$%&<>-"


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For every n-gram of every word, and for the word itself: the word's place in the list, and the table row."""
    text = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))  # characters up to the word's end
    at = np.repeat(starts, sizes)
    power = np.cumprod(np.full(int(sizes.max(initial=1)), _STEP, np.uint64))
    whole = np.add.reduceat(codes * power[np.arange(len(codes)) - at], starts) if len(words) else np.zeros(0, np.uint64)
    hashes, owners = [whole + np.uint64(1)], [np.arange(len(words))]
    for n in GRAMS:
        here = np.flatnonzero(left >= n)
        h = np.full(len(here), n, np.uint64)
        for k in range(n):
            h = h * _STEP + codes[here + k]
        hashes.append(h)
        owners.append(owner[here])
    h = np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return np.concatenate(owners), ((h ^ (h >> np.uint64(32))) % np.uint64(ROWS)).astype(np.int64)


def normal(word: str) -> str:
    return word.strip(_OUTER).lower() or word


@dataclass
class Model:
    """share: each table row's part of the toxic log-odds; bias: the log-odds of a passage of no content."""

    share: np.ndarray
    bias: float

    def of_words(self, words: list[str]) -> np.ndarray:
        owner, row = grams_of(words)
        return np.bincount(owner, weights=self.share[row], minlength=len(words)) / np.maximum(np.bincount(owner, minlength=len(words)), 1)


def windows(n: int) -> np.ndarray:
    """Where the passages of n words start: every half passage, so that no phrase is cut in all of them."""
    return np.arange(0, max(1, n - WINDOW // 2), WINDOW // 2)


class Scorer:
    """Scores texts, keeping the values of up to `most` words between calls."""

    def __init__(self, model: Model, most: int = 500_000):
        self.model, self.most, self.seen = model, most, {}

    def chunk(self, texts: list[str]) -> np.ndarray:
        docs = [_WORD.findall(t) for t in texts]
        new = list({w for ws in docs for w in ws}.difference(self.seen))
        if len(self.seen) + len(new) > self.most:
            self.seen.clear()
            new = list({w for ws in docs for w in ws})
        if new:
            plain = [normal(w) for w in new]
            each = list(dict.fromkeys(plain))
            value = dict(zip(each, self.model.of_words(each).tolist(), strict=True))
            self.seen.update(zip(new, map(value.__getitem__, plain), strict=True))
        sizes = np.array([len(ws) for ws in docs])
        values = np.fromiter((v for ws in docs for v in map(self.seen.__getitem__, ws)), float, int(sizes.sum()))
        values = np.append(values, 0.0)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        begins = [windows(n) for n in sizes]
        starts = np.concatenate([a + s for a, s in zip(at, begins, strict=True)])
        ends = np.concatenate([a + np.minimum(s + WINDOW, n) for a, s, n in zip(at, begins, sizes, strict=True)])
        # word by word, so that equal texts have equal scores whatever stands before them
        sums = sum(np.where(starts + k < ends, values[np.minimum(starts + k, len(values) - 1)], 0.0) for k in range(WINDOW))
        z = self.model.bias + sums / np.maximum(ends - starts, 1)
        none = np.bincount(np.repeat(np.arange(len(docs)), [len(s) for s in begins]), weights=np.logaddexp(0, z), minlength=len(docs))
        return np.clip(-np.expm1(-none), 0.0, 1.0)

    def __call__(self, texts: list[str], chunk_chars: int = 1_000_000) -> np.ndarray:
        out, part, size = [], [], 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size >= chunk_chars:
                out.append(self.chunk(part))
                part, size = [], 0
        if part:
            out.append(self.chunk(part))
        return np.concatenate(out) if out else np.zeros(0)


#: The scorer of the model that this worker used last; tasks of one worker share its words.
_LAST: dict[tuple[float, float], Scorer] = {}


def scorer_of(shared: Broadcast) -> Scorer:
    share, bias = shared.value
    key = (bias, float(share.sum()))
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Scorer(Model(share, bias))
    return _LAST[key]


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1, one span after the other."""
    if not lengths.sum():
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return first + np.arange(lengths.sum())


def f1(y: np.ndarray, said: np.ndarray, weight: np.ndarray) -> float:
    hit, extra, missed = (float(weight[m].sum()) for m in ((y == 1) & said, (y == 0) & said, (y == 1) & ~said))
    return 2 * hit / max(2 * hit + extra + missed, 1e-12)


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray, seed: int = 11) -> Model:
    """A model learnt on most of the documents, its passages' log-odds moved to suit the others; weight undoes the sampling of classes."""
    share = float((y * weight).sum() / weight.sum()) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(ROWS), float(np.log(share / (1 - share))))
    apart = np.random.default_rng(seed).random(len(y)) < KEPT_OUT
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2 or apart.sum() < 50:  # too few to move by
        return learn(texts, y, weight, seed=seed)
    model = learn([t for t, k in zip(texts, apart, strict=True) if not k], y[~apart], weight[~apart], seed=seed)
    others = [t for t, k in zip(texts, apart, strict=True) if k]
    moves = sorted(np.arange(-4, 4.25, 0.25).tolist(), key=abs)
    return max((Model(model.share, model.bias + m) for m in moves), key=lambda m: round(f1(y[apart], Scorer(m)(others) >= 0.5, weight[apart]), 9))


def learn(texts: list[str], y: np.ndarray, weight: np.ndarray, dim: int = 4, epochs: int = 8, batch: int = 128, rate: float = 0.1, scale: float = 20.0, seed: int = 11) -> Model:
    """Joint training of n-gram vectors and class weights on whole texts by Adam over batches of documents."""
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(normal(w), len(vocab)) for w in _WORD.findall(text or "")], np.int64) for text in texts]
    owner_of, row_of = grams_of(list(vocab) or [""])
    flat, per = row_of[np.argsort(owner_of, kind="stable")], np.bincount(owner_of)
    where = np.concatenate([[0], np.cumsum(per)[:-1]])
    touched = np.zeros(ROWS, np.int64)
    for d in docs:
        own = np.unique(d)
        touched[np.unique(flat[_spans(where[own], per[own])])] += 1
    live = (touched >= MIN_DOCS).astype(float)
    rng = np.random.default_rng(seed)
    e, v = rng.normal(0, 0.05, (ROWS, dim)), rng.normal(0, 0.3, (dim, 2))
    bias = np.array([0.0, -4.0])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, v, bias)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for first in range(0, len(order), batch):
            part = order[first : first + batch]
            step += 1
            sizes = np.array([len(docs[d]) for d in part])
            words, ids = np.unique(np.concatenate([docs[d] for d in part]), return_inverse=True)
            rows = flat[_spans(where[words], per[words])]
            of = np.repeat(np.arange(len(words)), per[words])
            n = per[words][:, None] if len(words) else np.ones((0, 1))
            kept = live[rows] * (rng.random(len(rows)) >= DROP) / (1 - DROP)
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            begins = [windows(k) for k in sizes]
            starts = np.concatenate([a + s for a, s in zip(at, begins, strict=True)])
            ends = np.concatenate([a + np.minimum(s + WINDOW, k) for a, s, k in zip(at, begins, sizes, strict=True)])
            owner = np.repeat(np.arange(len(part)), [len(s) for s in begins])
            length = np.maximum(ends - starts, 1)[:, None]
            # forward: n-gram vectors, word vectors, passage averages, class scores, documents
            wv = np.stack([np.bincount(of, weights=e[rows, k] * kept, minlength=len(words)) for k in range(dim)], 1) / n
            run = np.concatenate([np.zeros((1, dim)), np.cumsum(wv[ids], 0)])
            h = scale * (run[ends] - run[starts]) / length
            z = h @ v + bias
            odds = z[:, 1] - z[:, 0]
            none = np.bincount(owner, weights=np.logaddexp(0, odds), minlength=len(part))  # -log(prod(1 - p))
            fall = np.exp(-none) / np.maximum(-np.expm1(-none), 1e-9)
            w = weight[part]
            d_odds = (np.where(y[part] == 1, -fall, 1.0) * w / w.sum())[owner] / (1 + np.exp(-odds))
            dz = np.stack([-d_odds, d_odds], 1)
            # backward through the averages: a word gets the gradient of every passage that it is in
            dh = scale * (dz @ v.T) / length
            edge = np.zeros((len(ids) + 1, dim))
            for k in range(dim):
                edge[:, k] = np.bincount(starts, weights=dh[:, k], minlength=len(ids) + 1) - np.bincount(ends, weights=dh[:, k], minlength=len(ids) + 1)
            dwords = np.cumsum(edge, 0)[:-1]
            dwv = np.stack([np.bincount(ids, weights=dwords[:, k], minlength=len(words)) for k in range(dim)], 1) / n
            de = np.stack([np.bincount(rows, weights=dwv[of, k] * kept, minlength=ROWS) for k in range(dim)], 1)
            for p, g, m in zip((e, v, bias), (de, h.T @ dz, dz.sum(0)), moments, strict=True):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.02 * (g * g - m[1])
                p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.98**step)) + 1e-9)
    return Model(scale * live * (e @ (v[:, 1] - v[:, 0])), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled documents of either class that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max(label).alias("_y"))
    counts = {int(r["_y"]): r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("_y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # One row an id, however often it comes. Either class has MOST_CHARS to learn from: longer texts are passed over, and
    # documents whose turn in their class is past it are left out whole.
    texts = written(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_y").alias("_y")), "labelled")
    so_far = F.sum(F.length("text")).over(Window.partitionBy("_y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    turn = texts.where(F.length("text") <= MOST_CHARS).select("doc_id", so_far.alias("_upto")).where(F.col("_upto") <= MOST_CHARS)
    rows = texts.join(F.broadcast(turn.select("doc_id")), "doc_id").toPandas().sort_values("doc_id")
    y = rows["_y"].to_numpy(float)
    weight = np.array([counts.get(int(k), 1) / max(1, int((y == k).sum())) for k in y])
    return fit(rows["text"].tolist(), y, weight)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row. The model (a table of fixed size) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((model.share.astype(np.float32), model.bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_of(shared)
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "score": scorer(x["text"].tolist())})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each document: held_out, score, predicted."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    scored = score(docs, train(docs, labels, "toxic", fold))
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
