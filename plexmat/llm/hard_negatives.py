"""Hard negatives by product quantisation: table lookups bound every score, exact integer products settle what the bounds leave.

A vector is quantised to whole numbers and cut into short subspaces; each subspace has CODEWORDS centres, fitted by k-means on
SAMPLE rows (chosen by a hash of their content), and every row of the table is indexed: a code for each subspace and the norm of
what the codes leave (its residual). The product of an anchor and a row is the sum of the anchor's table entries at the row's codes,
plus or minus the anchor's norm times the residual's, so a row whose upper bound is below the k-th best found so far, or whose
interval misses a window, cannot be in the result. All others are multiplied exactly: results are those of brute force, and a
poor fit costs time, never rows.

Anchors go in blocks against parts of the rows, a task for each pair. Its rows stream through in Arrow batches, so a task holds the
block of anchors, one batch and the best rows so far of each anchor. Two passes: the best rows of the anchor's own label (positives),
then, for each of them, the best rows of other labels in its window. Tasks return their own best few for each anchor; a window
over those gives the best of all.

Rows with a null label, a null vector, or a component that is null or not finite take no part. Shorter vectors count as filled
up with zeros. Repeated rows are rows of their own; a row is never its own positive, but an equal one may be. Null ids
come last among equal scores and are no anchors. Components whose quantised products could pass 2**62 are an error. A table without rows
gives none; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexmat.llm.common import keep_nothing, written

#: The index: components to a subspace, centres to each, rows to fit them on, rounds of k-means.
SUBSPACE, CODEWORDS, SAMPLE, ROUNDS = 2, 256, 8192, 8
#: Most anchors to a block, least rows to a part, most parts; anchors and rows whose bounds are held at once.
ANCHORS, ROWS, PARTS, STEP_ANCHORS, STEP_ROWS = 4096, 4096, 4096, 128, 4096
#: Candidates that are multiplied at once.
PRODUCTS = 1 << 15
#: Stands for a null id within tasks, where it sorts last.
_NO_ID = int(np.iinfo(np.int64).max)

_ITEM = "num long, vec_id long, label long, vec binary, codes binary, rest float"


def quantised(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x.astype(np.float64)).astype(np.int64)


def fit_codebooks(rows: np.ndarray, seed: int = 5) -> np.ndarray:
    """Centres of every subspace, (subspaces, CODEWORDS, SUBSPACE); fewer rows than centres are repeated."""
    rng = np.random.default_rng(seed)
    parts = rows.reshape(len(rows), -1, SUBSPACE).astype(np.float32)
    first = rng.permutation(len(parts))[np.arange(CODEWORDS) % len(parts)]
    books = parts[first].transpose(1, 0, 2).copy()
    for m in range(parts.shape[1]):
        own = np.ascontiguousarray(parts[:, m])
        for _ in range(ROUNDS):
            near = nearest(own, books[m])
            n = np.bincount(near, minlength=CODEWORDS)
            full = n > 0
            for k in range(SUBSPACE):
                books[m, full, k] = np.bincount(near, weights=own[:, k], minlength=CODEWORDS)[full] / n[full]
    return books


def nearest(own: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (0.5 * (centres * centres).sum(1) - own @ centres.T).argmin(1)


def encode(y: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and residual norms (rounded up) of quantised rows."""
    parts = y.reshape(len(y), -1, SUBSPACE)
    codes = np.empty((len(y), len(books)), np.uint8)
    left = np.zeros(len(y))
    for m, centres in enumerate(books):
        own = parts[:, m].astype(np.float32)
        codes[:, m] = nearest(own, centres)
        left += ((parts[:, m] - centres[codes[:, m]].astype(np.float64)) ** 2).sum(1)
    return codes, (np.sqrt(left) * (1 + 1e-6) + 1e-6).astype(np.float32)


class Block:
    """Some anchors, as a task meets them: vectors, tables of their subspaces, norms."""

    def __init__(self, x: pd.DataFrame, books: np.ndarray):
        self.books = books
        self.num, self.label = x["num"].to_numpy(), x["label"].to_numpy()
        self.y = np.frombuffer(b"".join(x["vec"]), "<i4").reshape(len(x), -1)
        self.norm = np.sqrt((self.y.astype(np.float64) ** 2).sum(1))
        self.reach = float(np.sqrt((np.abs(books).max(1).astype(np.float64) ** 2).sum()))

    def bounds(self, at: np.ndarray, codes: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated products of some anchors and rows, and how far they may be off."""
        parts = self.y[at].reshape(len(at), -1, SUBSPACE).astype(np.float32)
        out = np.zeros((len(at), len(codes)), np.float32)
        for m, centres in enumerate(self.books):
            out += np.take(parts[:, m] @ centres.T, codes[:, m], axis=1)
        # 4-byte sums are off by far less than a 2**17th of the norms' product
        off = self.norm[at, None] * (rest[None, :].astype(np.float64) + (self.reach + rest[None, :]) * 2.0**-17) + 1e-3
        return out, off.astype(np.float32) * np.float32(1 + 1e-6)

    def products(self, at: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact products of pairs (anchor, row)."""
        out = np.empty(len(at), np.int64)
        for k in range(0, len(at), PRODUCTS):
            s = slice(k, k + PRODUCTS)
            out[s] = np.einsum("ij,ij->i", self.y[at[s]].astype(np.int64), y[rows[s]].astype(np.int64))
        return out


class Best:
    """The best `most` rows of each of n groups so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, most: int):
        self.n, self.most = n, most
        self.group = np.zeros(0, np.int64)
        self.score, self.id, self.num = (np.zeros(0, np.int64) for _ in range(3))
        self.worst = np.full(n, -np.inf)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, num: np.ndarray) -> None:
        if not len(group):
            return
        g, s, i, u = (np.concatenate(p) for p in ((self.group, group), (self.score, score), (self.id, ids), (self.num, num)))
        order = np.lexsort((u, i, -s, g))
        g = g[order]
        place = np.arange(len(g)) - np.searchsorted(g, g)
        kept = order[place < self.most]
        self.group, self.score, self.id, self.num = g[place < self.most], s[kept], i[kept], u[kept]
        last = place == self.most - 1
        self.worst[g[last]] = s[order[last]]


def _kth(lower: np.ndarray, most: int) -> np.ndarray:
    """The most-th largest of every row, -inf where there are fewer."""
    if lower.shape[1] < most:
        return np.full(len(lower), -np.inf, np.float32)
    return np.partition(lower, lower.shape[1] - most, axis=1)[:, lower.shape[1] - most]


def _search_positives(block: Block, best: Best, x: pd.DataFrame) -> None:
    labels = x["label"].to_numpy()
    for label in np.intersect1d(labels, block.label):
        _positives_of_label(block, best, x[labels == label], np.flatnonzero(block.label == label))


def _positives_of_label(block: Block, best: Best, x: pd.DataFrame, anchors: np.ndarray) -> None:
    num, ids, y, codes, rest = _arrays(x, len(block.books))
    for a in range(0, len(anchors), STEP_ANCHORS):
        at = anchors[a : a + STEP_ANCHORS]
        est, off = block.bounds(at, codes, rest)
        other = num[None, :] != block.num[at, None]
        limit = best.worst[at]
        if np.isinf(limit).any():
            limit = np.maximum(limit, _kth(np.where(other, est - off, -np.inf), best.most))
        i, j = np.nonzero(other & (est + off >= limit[:, None]))
        best.add(at[i], block.products(at[i], y, j), ids[j], num[j])


def _search_negatives(block: Block, best: Best, x: pd.DataFrame, windows: np.ndarray) -> None:
    """windows: (anchors, positives, 2), the least and the greatest score of each window; none where least > greatest."""
    num, ids, y, codes, rest = _arrays(x, len(block.books))
    label, wide = x["label"].to_numpy(), windows.shape[1]
    for a in range(0, len(block.num), STEP_ANCHORS):
        at = np.arange(a, min(a + STEP_ANCHORS, len(block.num)))
        est, off = block.bounds(at, codes, rest)
        other = label[None, :] != block.label[at, None]
        low, high = np.where(other, est - off, np.inf), np.where(other, est + off, -np.inf)
        found = []
        for w in range(wide):
            least, most = windows[at, w, 0].astype(float), windows[at, w, 1].astype(float)
            limit = best.worst[at * wide + w]
            if np.isinf(limit).any():
                inside = other & (low >= least[:, None]) & (high <= most[:, None])
                limit = np.maximum(limit, _kth(np.where(inside, low, -np.inf), best.most))
            found.append(np.flatnonzero((high >= np.maximum(limit, least)[:, None]) & (low <= most[:, None])))
        flat = np.unique(np.concatenate(found))  # a row is multiplied once, whatever the number of windows
        i, j = np.divmod(flat, len(num))
        score = block.products(at[i], y, j)
        for w, own in enumerate(found):
            k = np.searchsorted(flat, own)
            s, g = score[k], at[i[k]]
            ok = (s >= windows[g, w, 0]) & (s <= windows[g, w, 1])
            best.add(g[ok] * wide + w, s[ok], ids[j[k[ok]]], num[j[k[ok]]])


def _arrays(x: pd.DataFrame, subspaces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    y = np.frombuffer(b"".join(x["vec"]), "<i4").reshape(len(x), -1)
    codes = np.frombuffer(b"".join(x["codes"]), np.uint8).reshape(len(x), subspaces)
    return x["num"].to_numpy(), x["vec_id"].to_numpy(), y, codes, x["rest"].to_numpy()


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, bool, pd.DataFrame]]:
    """Runs of one task and side, of up to STEP_ROWS rows; the partition is sorted by (task, side)."""
    for x in batches:
        key = x["task"].to_numpy() * 2 + x["side"].to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(x)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for k in range(a, b, STEP_ROWS):
                yield int(x["task"].iloc[k]), bool(x["side"].iloc[k]), x.iloc[k : min(k + STEP_ROWS, b)]


class Index:
    """The indexed rows of a table (num, vec_id, label, vec, codes, rest), written once; num tells rows apart."""

    def __init__(self, rows: DataFrame, scale: float = 256.0, sample: int = SAMPLE):
        """rows: vec_id long, label long, vec array of numbers."""
        rows = rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
        size, most = rows.agg(F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs)))).first()
        self.dim = max(SUBSPACE, -(-(size or 1) // SUBSPACE) * SUBSPACE)
        if (most or 0) * scale + 1 > min(2.0**31 - 2, (2.0**62 / self.dim) ** 0.5):
            raise ValueError("components are too large for exact products")
        taken = rows.orderBy(F.xxhash64("vec_id", "label", "vec"), "vec_id").limit(sample).select("vec").toPandas()["vec"]
        # the rows are content-ordered, so reruns fit the same centres
        self.books = fit_codebooks(self._whole(taken, scale)) if len(taken) else np.zeros((self.dim // SUBSPACE, CODEWORDS, SUBSPACE), np.float32)
        books, whole = self.books, self._whole

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keep_nothing()
            for x in batches:
                y = whole(x["vec"], scale)
                codes, rest = encode(y, books)
                yield pd.DataFrame({"num": x["num"], "vec_id": x["vec_id"], "label": x["label"], "vec": [v.tobytes() for v in y.astype("<i4")], "codes": [c.tobytes() for c in codes], "rest": rest})

        own = rows.select(F.monotonically_increasing_id().alias("num"), F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("vec_id"), F.col("label").cast("long"), "vec")
        self.rows = written(own.mapInPandas(run, _ITEM), "pq-rows")
        self.count = self.rows.count()

    def _whole(self, vectors: pd.Series, scale: float) -> np.ndarray:
        """Quantised vectors as one array, shorter ones filled up with zeros."""
        sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
        out = np.zeros((len(vectors), self.dim), np.int64)
        filled = np.arange(self.dim)[None, :] < sizes[:, None]
        if filled.any():
            out[filled] = quantised(np.concatenate([np.asarray(v, np.float64) for v in vectors]), scale)
        return out

    def tasks(self, anchors: DataFrame, n_anchors: int) -> tuple[DataFrame, int]:
        """Anchors (with windows) and rows, once for each task that needs them, sorted by task; the number of tasks."""
        blocks = max(1, -(-n_anchors // ANCHORS))
        parts = min(PARTS, max(1, -(-self.count // ROWS)))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        block = F.pmod(F.xxhash64(F.col("num")), F.lit(blocks)).cast("int")
        part = F.pmod(F.xxhash64(F.col("num"), F.lit(1)), F.lit(parts)).cast("int")
        base = ["num", "vec_id", "label", "vec", "codes", "rest", "windows"]
        # the first of a sorted task are its anchors
        left = anchors.select(*base, block.alias("_b"), spread(parts).alias("_p")).select((F.col("_b") * parts + F.col("_p")).alias("task"), F.lit(0).alias("side"), *base)
        rows = self.rows.withColumn("windows", F.lit(None).cast("array<long>"))
        right = rows.select(*base, part.alias("_p"), spread(blocks).alias("_b")).select((F.col("_b") * parts + F.col("_p")).alias("task"), F.lit(1).alias("side"), *base)
        n = blocks * parts
        dealt = min(n, 1 << 14)
        both = left.unionByName(right).repartitionById(dealt, F.pmod("task", F.lit(dealt)).cast("int"))
        return both.sortWithinPartitions("task", "side"), n

    def positives(self, anchors: DataFrame, n_anchors: int, most: int) -> DataFrame:
        """For each anchor (num) its best `most` other rows of the same label: num, rank, id, score."""
        dealt, _ = self.tasks(anchors.withColumn("windows", F.lit(None).cast("array<long>")), n_anchors)
        books = self.books

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keep_nothing()
            for _, pieces in groupby(_pieces(batches), lambda p: p[0]):
                block, best, held = None, None, []
                for _, side, x in pieces:
                    if not side:
                        held.append(x)
                        continue
                    if block is None:
                        if not held:
                            continue
                        block = Block(pd.concat(held, ignore_index=True), books)
                        best = Best(len(block.num), most)
                    _search_positives(block, best, x)
                if best is not None and len(best.group):
                    yield _out(block.num[best.group], 0, best)

        found = dealt.mapInPandas(run, "num long, w int, score long, id long, row long")
        return self._top(found, most)

    def negatives(self, anchors: DataFrame, n_anchors: int, wide: int, most: int) -> DataFrame:
        """For each anchor (num) and window (w) the best `most` rows of other labels in it; anchors have windows, (least, greatest) after one another."""
        dealt, _ = self.tasks(anchors, n_anchors)
        books = self.books

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keep_nothing()
            for _, pieces in groupby(_pieces(batches), lambda p: p[0]):
                block, best, held, windows = None, None, [], None
                for _, side, x in pieces:
                    if not side:
                        held.append(x)
                        continue
                    if block is None:
                        if not held:
                            continue
                        own = pd.concat(held, ignore_index=True)
                        block = Block(own, books)
                        windows = np.tile(np.array([1, 0], np.int64), (len(own), wide, 1))
                        for k, v in enumerate(own["windows"]):
                            windows[k, : len(v) // 2] = np.asarray(v).reshape(-1, 2)
                        best = Best(len(own) * wide, most)
                        # windows without a score, or none at all, need no third row
                        best.worst[(windows[:, :, 0] > windows[:, :, 1]).ravel()] = np.inf
                    _search_negatives(block, best, x, windows)
                if best is not None and len(best.group):
                    yield _out(block.num[best.group // wide], best.group % wide, best)

        found = dealt.mapInPandas(run, "num long, w int, score long, id long, row long")
        return self._top(found, most)

    @staticmethod
    def _top(found: DataFrame, most: int) -> DataFrame:
        place = Window.partitionBy("num", "w").orderBy(F.desc("score"), "id", "row")
        ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)
        return ranked.withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id")))


def _out(num: np.ndarray, w: np.ndarray | int, best: Best) -> pd.DataFrame:
    return pd.DataFrame({"num": num, "w": np.int32(w) if np.isscalar(w) else w.astype(np.int32), "score": best.score, "id": best.id, "row": best.num})


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, greatest: int = 95, scale: float = 256.0) -> DataFrame:
    """For each anchor and positive the best rows of other labels whose score lies between least and greatest percent of the positive's.

    rows: vec_id, label, vec; is_anchor is a condition on vec_id. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.
    """
    index = Index(rows, scale)
    anchors = index.rows.where((F.col("vec_id") != _NO_ID) & is_anchor)
    n = anchors.count()
    found = written(index.positives(anchors, n, positives), "pq-positives")
    # percent * s / 100, rounded towards the inside of the window
    edge = lambda s, percent, up: F.expr(f"{'-' if up else ''}(({'-' if up else ''}{percent} * {s} - pmod({'-' if up else ''}{percent} * {s}, 100L)) div 100)")
    by_rank = F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), edge("score", least, True).alias("least"), edge("score", greatest, False).alias("greatest"))))
    listed = found.groupBy("num").agg(by_rank.alias("given"))
    own = written(anchors.join(listed, "num").withColumn("windows", F.flatten(F.transform("given", lambda g: F.array(g["least"], g["greatest"])))), "pq-anchors")
    best = index.negatives(own.drop("given"), n, positives, negatives)
    named = best.withColumnRenamed("id", "negative_id").join(own.select("num", F.col("vec_id").alias("anchor_id"), "given"), "num").withColumn("_g", F.get("given", F.col("w")))
    return named.select("anchor_id", F.col("_g")["positive_id"].alias("positive_id"), F.col("rank").cast("int"), "negative_id", F.col("_g")["positive_score"].alias("positive_score"), F.col("score").alias("negative_score"))


def mine_embeddings(table: DataFrame, anchor_every: int = 50, wrong_every: int = 7, labels: int = 10) -> DataFrame:
    """mine() over vec_id, label and embedding; rows whose vec_id is divisible by wrong_every first get the next label."""
    wrong = F.coalesce(F.col("vec_id") % wrong_every == 0, F.lit(False))
    label = F.when(wrong, (F.col("label").cast("long") + 1) % labels).otherwise(F.col("label").cast("long"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").alias("vec"))
    return mine(rows, F.col("vec_id") % anchor_every == 0)
