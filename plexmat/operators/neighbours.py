"""Exact nearest neighbours by cosine, with blocks left out that cannot hold one.

Rows are dealt to the nearest of some pivots (rows chosen by a hash of their id) and, by their angle to it, into blocks. Angles are a metric:
two rows are at least as far apart as their pivots are, less both their angles to these; rows of one pivot at least as far as those
angles differ. Each block is compared with itself first, which bounds the k-th neighbour of each of its rows from above; it is then
compared with those blocks only that the bounds let be nearer. Where bounds leave nothing out all blocks are compared, as without
them, and the result is the same in every case.

A task has some of the blocks twice, as GROUPS groups of them at most (more where a group would be over CELLS numbers), so that a row is sent
on about GROUPS times however many rows there are. Blocks are multiplied in single precision, and exactly what may be among the k best of a
row so far; a task passes on the k best of each row. Ties, after rounding to DIGITS places, go to the lower id. Rows of length 0
have the similarity -2 to all others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexmat.plans.iterate import placed, written

#: Rows to a block; most pivots; decimal places that are compared.
BLOCK, PIVOTS, DIGITS = 1000, 512, 9
#: What angles may be off by, near 0, for the rounding of their cosines.
SLACK = 1e-7
#: Groups of blocks; numbers in a group at most; pairs that are multiplied exactly at once.
GROUPS, CELLS, EXACT = 10, 1 << 23, 1 << 15

_FOUND = "a string, b string, s double"


def _compare(ia: np.ndarray, xa: np.ndarray, ib: np.ndarray, xb: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each row of the first block among the second, whose ids ascend."""
    s = np.round(xa @ xb.T, DIGITS)
    s[ia[:, None] == ib[None, :]] = -np.inf
    pick = np.argsort(-s, axis=1, kind="stable")[:, :k]
    r, c = np.repeat(np.arange(len(ia)), pick.shape[1]), pick.ravel()
    good = np.isfinite(s[r, c])
    return pd.DataFrame({"a": ia[r[good]], "b": ib[c[good]], "s": s[r[good], c[good]]})


class _Block:
    """A block in a task: its rows, and the k best (rounded similarity, rank of the id) of each so far; new tells which were found there."""

    def __init__(self, row, rank: dict[str, int], k: int):
        n = len(row.ids)
        self.rank = np.array([rank[i] for i in row.ids])
        self.x = np.frombuffer(row.x).reshape(n, -1)
        self.fast = self.x.astype(np.float32)
        self.s = np.frombuffer(row.s).reshape(n, k).copy()
        at = np.frombuffer(row.at, np.int64).reshape(n, k)
        self.who = np.where(at >= 0, self.rank[at], len(rank))
        self.new = np.zeros((n, k), bool)

    def meet(self, other: _Block, fast: np.ndarray) -> None:
        """Takes in the best of the other's rows; fast: all similarities in single precision."""
        low, k = self.s[:, -1], self.s.shape[1]
        off = (self.x.shape[1] + 8) * 1.2e-7
        r, c = np.divmod(np.flatnonzero(fast >= (low - off).astype(np.float32)[:, None]), fast.shape[1])
        if not len(r):
            return
        if len(r) > fast.size // 16:
            v = np.round(self.x @ other.x.T, DIGITS)[r, c]
        else:
            v = np.concatenate([np.round(np.einsum("ij,ij->i", self.x[r[i : i + EXACT]], other.x[c[i : i + EXACT]]), DIGITS) for i in range(0, len(r), EXACT)])
        good = v >= low[r]
        r, c, v = r[good], c[good], v[good]
        if not len(r):
            return
        who = other.rank[c]
        order = np.lexsort((who, -v, r))
        r, v, who = r[order], v[order], who[order]
        rows, start, place = np.unique(r, return_index=True, return_inverse=True)
        nth = np.arange(len(r)) - start[place]
        own = nth < k
        s, w = np.full((len(rows), k), -np.inf), np.full((len(rows), k), np.iinfo(np.int64).max)
        s[place[own], nth[own]], w[place[own], nth[own]] = v[own], who[own]
        s, w, new = np.hstack([self.s[rows], s]), np.hstack([self.who[rows], w]), np.hstack([self.new[rows], np.ones(s.shape, bool)])
        pick = np.lexsort((w, -s), axis=1)[:, :k]
        self.s[rows], self.who[rows], self.new[rows] = (np.take_along_axis(m, pick, 1) for m in (s, w, new))


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return found.withColumn("_r", place).where(F.col("_r") <= k).drop("_r")


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


class Neighbours:
    """rows: id string and x, an array of numbers, all of one size; ids are distinct. `compared` counts the pairs that were multiplied."""

    def __init__(self, rows: DataFrame, k: int, block: int | None = None, pivots: int | None = None):
        self.k, self.block = k, block or BLOCK
        length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double")))
        self.rows = written(rows.select("id", "x", length.alias("_length")).select("id", F.when(F.col("_length") > 0, F.transform("x", lambda v: v.cast("double") / F.col("_length"))).alias("x")), "unit-rows")
        self.count = self.rows.where("x is not null").count()
        self.compared = 0
        self.pivots = pivots or min(PIVOTS, max(1, int(np.sqrt(self.count / self.block) * 4)))

    def result(self) -> DataFrame:
        """(a, b, s): the k best others of each row."""
        full = self.rows.where("x is not null")
        if self.count <= self.block:
            found = full.withColumn("block", F.lit(0)).groupBy("block").applyInPandas(self._alone(), _FOUND)
            self.compared = self.count**2
        else:
            found = self._by_blocks(full)
        return _best(found.unionByName(self._without_length()), self.k)

    def _alone(self):
        k = self.k

        def run(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("id")
            ids, x = p["id"].to_numpy(), np.stack(p["x"].to_numpy())
            return _compare(ids, x, ids, x, k)

        return run

    def _without_length(self) -> DataFrame:
        """Rows of length 0 have the lowest ids for neighbours; they are others' only where there are too few rows beside them."""
        none = self.rows.where("x is null").select("id")
        lowest = self.rows.select(F.col("id").alias("b")).orderBy("b").limit(self.k + 1)
        found = none.select(F.col("id").alias("a")).join(F.broadcast(lowest), F.col("a") != F.col("b"))
        if self.count <= self.k:
            few = none.select(F.col("id").alias("b")).orderBy("b").limit(self.k)
            found = found.unionByName(self.rows.where("x is not null").select(F.col("id").alias("a")).join(F.broadcast(few)))
        return found.select("a", "b", F.lit(-2.0).alias("s"))

    def _by_blocks(self, full: DataFrame) -> DataFrame:
        chosen = full.orderBy(F.xxhash64("id"), "id").limit(self.pivots).toPandas()
        centres = np.stack(chosen["x"].to_numpy())

        def deal(batches):
            for p in batches:
                angle = _angles(np.stack(p["x"].to_numpy()), centres)
                cell = angle.argmin(1)
                yield pd.DataFrame({"id": p["id"], "x": p["x"], "cell": cell.astype(np.int32), "angle": angle[np.arange(len(p)), cell]})

        dealt = written(full.mapInPandas(deal, "id string, x array<double>, cell int, angle double"), "dealt-rows")
        # rows of a cell by their angle, roughly: equal angles, as copies have, are dealt on by a hash
        mark = F.md5(F.col("id").cast("binary"))
        ring = F.concat(F.lpad(F.floor(F.col("angle") * 4096).cast("string"), 5, "0"), F.substring(mark, 1, 2))
        dealt = placed(dealt, ["cell"], ring, [mark], out="_place")
        dealt = written(dealt.select("id", "x", "cell", "angle", F.expr(f"_place div {self.block}").cast("int").alias("part")), "blocks-rows")
        packed = written(dealt.groupBy("cell", "part").applyInPandas(self._packed(), "cell int, part int, n long, near double, far double, bound double, ids array<string>, x binary, s binary, at binary, a array<string>, b array<string>, found array<double>"), "packed-blocks")
        blocks = packed.select("cell", "part", "n", "near", "far", "bound")
        pairs = written(self._pairs(blocks, centres), "pairs")
        sums = pairs.agg(F.sum(F.col("n") * F.col("n2"))).head()[0] or 0
        self.compared = int(sums + blocks.agg(F.sum(F.col("n") * F.col("n"))).head()[0])
        own = packed.select(F.inline(F.arrays_zip("a", "b", F.col("found").alias("s")))).toDF("a", "b", "s")
        return own.unionByName(self._across(packed, pairs, centres.shape[1]))

    def _packed(self):
        """A block as one row: sizes, least and greatest angle to the pivot, the least similarity that a row's k-th neighbour has so
        far; ids and rows; the k best within the block, by place (s, at) and by id (a, b, found)."""
        k = self.k

        def run(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("id")
            ids, x = p["id"].to_numpy(), np.ascontiguousarray(np.stack(p["x"].to_numpy()), float)
            own, place = _compare(ids, x, ids, x, k), {i: j for j, i in enumerate(ids)}
            s, at = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1)
            nth = own.groupby("a").cumcount().to_numpy()
            r = own["a"].map(place).to_numpy(int)
            s[r, nth], at[r, nth] = own["s"], own["b"].map(place).to_numpy(int)
            bound = np.maximum(s[:, -1], -2.0).min()
            one = {"cell": p["cell"].iloc[0], "part": p["part"].iloc[0], "n": len(ids), "near": p["angle"].min(), "far": p["angle"].max(), "bound": bound, "ids": ids, "x": x.tobytes(), "s": s.tobytes(), "at": at.astype(np.int64).tobytes(), "a": own["a"].to_numpy(), "b": own["b"].to_numpy(), "found": own["s"].to_numpy()}
            return pd.DataFrame([one])

        return run

    def _pairs(self, blocks: DataFrame, centres: np.ndarray) -> DataFrame:
        """Pairs of different blocks of which the second may hold a neighbour of a row of the first: first by cells, then by blocks."""
        apart = _angles(centres, centres)
        reach = {r["cell"]: r["far"] for r in blocks.groupBy("cell").agg(F.max("far").alias("far")).collect()}  # a row a pivot
        far = np.array([reach.get(c, -np.inf) for c in range(len(centres))])

        def cells(batches):
            for p in batches:
                limit = np.arccos(np.clip(p["bound"].to_numpy() - 10.0**-DIGITS, -1, 1))
                least = apart[p["cell"].to_numpy()] - p["far"].to_numpy()[:, None] - far[None, :] - SLACK
                i, j = np.nonzero((least <= limit[:, None]) & np.isfinite(far)[None, :])
                q = p.iloc[i]
                yield pd.DataFrame({"cell": q["cell"].to_numpy(), "part": q["part"].to_numpy(), "n": q["n"].to_numpy(), "near": q["near"].to_numpy(), "far": q["far"].to_numpy(), "limit": limit[i], "cell2": j.astype(np.int32), "apart": apart[q["cell"].to_numpy(), j]})

        wide = blocks.mapInPandas(cells, "cell int, part int, n long, near double, far double, limit double, cell2 int, apart double")
        other = blocks.select(F.col("cell").alias("cell2"), F.col("part").alias("part2"), F.col("n").alias("n2"), F.col("near").alias("near2"), F.col("far").alias("far2"))
        least = F.greatest(F.col("apart") - F.col("far") - F.col("far2"), F.when(F.col("cell") == F.col("cell2"), F.greatest(F.col("near2") - F.col("far"), F.col("near") - F.col("far2"))).otherwise(F.lit(-4.0))) - SLACK
        met = wide.join(other, "cell2").where(((F.col("cell") != F.col("cell2")) | (F.col("part") != F.col("part2"))) & (least <= F.col("limit")))
        return met.select("cell", "part", "cell2", "part2", "n", "n2")

    def _across(self, packed: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
        """The best of each row in other blocks. A task has the blocks of two groups (or one) that meet, each once, and multiplies them both ways at once."""
        k = self.k
        size = max(1, min(-(-self.count // GROUPS), CELLS // max(1, width)))
        before = F.sum("n").over(Window.orderBy("cell", "part")) - F.col("n")  # a row a block
        group = packed.select("cell", "part", F.floor(before / size).cast("int").alias("g"))
        met = pairs.join(F.broadcast(group), ["cell", "part"]).join(F.broadcast(group.toDF("cell2", "part2", "h")), ["cell2", "part2"])
        met = written(met.select(F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"), "cell", "part", "cell2", "part2"), "group-pairs")
        need = met.select("i", "j", "cell", "part").unionByName(met.select("i", "j", F.col("cell2").alias("cell"), F.col("part2").alias("part"))).distinct()
        sent = packed.select("cell", "part", "ids", "x", "s", "at").join(written(need, "blocks-of-groups"), ["cell", "part"])

        def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            ids = np.array(sorted(i for own in p["ids"] for i in own), object)
            rank = {i: n for n, i in enumerate(ids)}
            blocks = {(r.cell, r.part): _Block(r, rank, k) for r in p.itertuples()}
            todo = dict.fromkeys(zip(zip(q["cell"], q["part"], strict=True), zip(q["cell2"], q["part2"], strict=True), strict=True))
            for one, two in sorted(todo):
                back = (two, one) in todo
                if back and two < one:
                    continue  # multiplied already
                a, b = blocks[one], blocks[two]
                fast = a.fast @ b.fast.T
                a.meet(b, fast)
                if back:
                    b.meet(a, fast.T)
            out = []
            for b in blocks.values():
                r, c = np.nonzero(b.new & np.isfinite(b.s))
                out.append(pd.DataFrame({"a": ids[b.rank[r]], "b": ids[b.who[r, c]], "s": b.s[r, c]}))
            return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "s": []})

        return sent.groupBy("i", "j").cogroup(met.groupBy("i", "j")).applyInPandas(run, _FOUND)


def nearest(rows: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(a, b, s) for rows (id, x): the k most similar others of each, by cosine."""
    return Neighbours(rows, k, block).result()
