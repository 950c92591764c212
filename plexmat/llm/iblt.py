"""Document fingerprints by invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines, cut further at sentence ends and every 40 characters), each is hashed to 64
bits together with how often it came before, and every digest is added to three cells of a table: count, sum of
digests, sum of check values. Tables of two versions subtract cell by cell; cells that then hold one digest are
peeled until nothing is left, which recovers the differing digests of either side. Where peeling fails, larger
tables are built and subtracted, doubled until they peel. A fingerprint is the base table of a text; stored fingerprints
are read back and subtracted by `changed` and `changed_digests`, which tell the digests of either side.

The likeness of two texts is the Jaccard index of their digests, from the counts and the recovered differences.
Null and empty texts have an empty table; two empty texts have likeness 1. Repeated rows follow one another, so the
next document may hold the same text; with one document only, it is its own next. Null ids come first; rows of equal id
follow by a hash of the text. Texts of any length are cut whole; a table without rows gives none; other columns are left
alone, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Cells in each of the three parts of a base table.
BASE = 16
PARTS = 3
_PARAGRAPH = re.compile(r"[^\n.!?]{1,40}[.!?\n]*|[.!?\n]+")
_ODD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEEDS = np.array([0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def paragraphs(text: str) -> list[str]:
    return _PARAGRAPH.findall(text)


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The paragraph digests of all texts, one text after the other, and where each text's start (with the end)."""
    found = [[xxhash.xxh3_64_intdigest(p) for p in paragraphs(t)] for t in texts]
    sizes = np.array([len(f) for f in found], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    h = np.fromiter((x for f in found for x in f), np.uint64, int(at[-1]))
    doc = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    place = np.arange(len(h))
    before = np.empty(len(h), np.int64)
    before[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return _mix(h + before.astype(np.uint64) * _ODD), at


class Tables:
    """Many tables in one array of cells; table t has PARTS parts of size[t] cells each, a power of two."""

    def __init__(self, size: np.ndarray):
        self.size = size.astype(np.int64)
        self.off = np.concatenate([[0], np.cumsum(PARTS * self.size)])
        n = int(self.off[-1])
        self.count, self.sum, self.check = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def cells(self, table: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
        size = self.size[table]
        return [self.off[table] + j * size + (_mix(keys ^ _SEEDS[j]).astype(np.int64) & (size - 1)) for j in range(PARTS)]

    def add(self, table: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> list[np.ndarray]:
        by = sign.astype(np.int64).view(np.uint64)
        checks = _mix(keys ^ _SEEDS[3])
        places = self.cells(table, keys)
        for at in places:
            np.add.at(self.count, at, sign)
            np.add.at(self.sum, at, keys * by)
            np.add.at(self.check, at, checks * by)
        return places

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The digests recovered: their tables, the digests, their signs; and whether each table peeled to nothing."""
        tables = len(self.size)
        of = np.repeat(np.arange(tables), PARTS * self.size)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.flatnonzero(self.count)
        while len(look):
            look = look[np.abs(self.count[look]) == 1]
            sign = self.count[look]
            keys = self.sum[look] * sign.view(np.uint64)
            pure = _mix(keys ^ _SEEDS[3]) == self.check[look] * sign.view(np.uint64)
            look, sign, keys = look[pure], sign[pure], keys[pure]
            if not len(look):
                break
            table = of[look]
            _, one = np.unique(keys + table.astype(np.uint64) * _ODD, return_index=True)
            touched = self.add(table[one], keys[one], -sign[one])
            got.append((table[one], keys[one], sign[one]))
            look = np.unique(np.concatenate(touched))
        left = np.bincount(of, weights=(self.count != 0) | (self.sum != 0) | (self.check != 0), minlength=tables)
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        table, keys, sign = (np.concatenate(x) for x in zip(*got, strict=True)) if got else none
        return table, keys, sign, left == 0


def base_tables(keys: np.ndarray, at: np.ndarray) -> Tables:
    n = len(at) - 1
    out = Tables(np.full(n, BASE))
    out.add(np.repeat(np.arange(n), np.diff(at)), keys, np.ones(len(keys), np.int64))
    return out


#: A stored cell: how many digests, and the sums of digests and of check values, modulo 2 ** 64.
_CELL = np.dtype([("count", "<i4"), ("sum", "<u8"), ("check", "<u8")])


def fingerprints(tables: Tables, which: range) -> list[str]:
    """Base tables as text."""
    cells = np.empty(len(tables.count), _CELL)
    cells["count"], cells["sum"], cells["check"] = tables.count, tables.sum, tables.check
    return [base64.b64encode(cells[tables.off[t] : tables.off[t + 1]].tobytes()).decode() for t in which]


def from_fingerprints(stored: list[str]) -> Tables:
    """The tables that `fingerprints` wrote."""
    raw = [np.frombuffer(base64.b64decode(f), _CELL) for f in stored]
    tables = Tables(np.array([len(r) // PARTS for r in raw], np.int64))
    cells = np.concatenate(raw) if raw else np.zeros(0, _CELL)
    tables.count, tables.sum, tables.check = cells["count"].astype(np.int64), cells["sum"].copy(), cells["check"].copy()
    return tables


def subtract(left: Tables, right: Tables) -> Tables:
    """left minus right, cell by cell; table t of either must have the same size."""
    if not np.array_equal(left.size, right.size):
        raise ValueError("tables of different sizes can't be subtracted")
    out = Tables(left.size)
    out.count, out.sum, out.check = left.count - right.count, left.sum - right.sum, left.check - right.check
    return out


def changed(before: list[str], after: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """For stored fingerprints of two versions each: the digests gone and the digests new, or None where they differ in
    more than these tables hold (larger ones of the texts are wanted then: see `changed_digests`)."""
    table, keys, sign, done = subtract(from_fingerprints(before), from_fingerprints(after)).peel()
    return [(np.sort(keys[(table == t) & (sign > 0)]), np.sort(keys[(table == t) & (sign < 0)])) if done[t] else None for t in range(len(before))]


def changed_digests(before: str, after: str) -> tuple[np.ndarray, np.ndarray]:
    """The digests gone and new between two texts: by their base tables, and by larger ones until they peel."""
    keys, at = digests([before, after])
    for size in BASE << np.arange(40):
        tables = Tables(np.array([size]))
        tables.add(np.zeros(len(keys), np.int64), keys, np.where(np.arange(len(keys)) < at[1], 1, -1))
        _, found, sign, done = tables.peel()
        if done[0]:
            break
        if size > 4 * len(keys) + BASE:  # two digests in the same cells at every size: hold them against each other
            a, b = keys[: at[1]], keys[at[1] :]
            return np.setdiff1d(a, b), np.setdiff1d(b, a)
    return np.sort(found[sign > 0]), np.sort(found[sign < 0])


def changed_documents(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, gone and new (digests, as signed 64-bit numbers) of the documents that both tables have and whose texts differ.

    Ids are taken to be keys of either table; rows without an id are left out.
    """
    both = before.select("doc_id", F.coalesce("text", F.lit("")).alias("a")).join(after.select("doc_id", F.coalesce("text", F.lit("")).alias("b")), "doc_id").where("a <> b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            sides = [tuple(v.view(np.int64) for v in changed_digests(a, b)) for a, b in zip(x["a"], x["b"], strict=True)]
            yield pd.DataFrame({"doc_id": x["doc_id"], "gone": [s[0] for s in sides], "new": [s[1] for s in sides]})

    return both.mapInPandas(run, "doc_id long, gone array<long>, new array<long>")


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not lengths.sum():
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())


def differences(keys: np.ndarray, at: np.ndarray, base: Tables, left: np.ndarray, right: np.ndarray, tries: int = 16) -> np.ndarray:
    """The number of digests in which texts left[i] and right[i] differ."""
    n, sizes = len(left), np.diff(at)
    first = Tables(np.full(n, BASE))
    cells = np.arange(PARTS * BASE)
    a, b = (base.off[x][:, None] + cells for x in (left, right))
    for name in ("count", "sum", "check"):
        own = getattr(base, name)
        setattr(first, name, (own[a] - own[b]).ravel())
    table, _, _, done = first.peel()
    out = np.bincount(table, minlength=n)
    todo = np.flatnonzero(~done)
    size = np.full(n, BASE)
    for _ in range(tries):
        if not len(todo):
            return out
        need = (sizes[left[todo]] + sizes[right[todo]]) / 2
        size[todo] = np.maximum(2 * size[todo], 1 << np.ceil(np.log2(np.maximum(need, 1))).astype(np.int64))
        tables = Tables(size[todo])
        for side, sign in ((left, 1), (right, -1)):
            lens = sizes[side[todo]]
            tables.add(np.repeat(np.arange(len(todo)), lens), keys[_spans(at[side[todo]], lens)], np.full(int(lens.sum()), sign))
        table, _, _, done = tables.peel()
        out[todo[done]] = np.bincount(table, minlength=len(todo))[done]
        todo = todo[~done]
    for i in todo:  # two digests in the same cells at every size: compare them one by one
        x, y = (keys[at[s[i]] : at[s[i] + 1]] for s in (left, right))
        out[i] = len(np.setxor1d(x, y))
    return out


def likeness(n_left: np.ndarray, n_right: np.ndarray, differ: np.ndarray) -> np.ndarray:
    both = (n_left + n_right - differ) / 2
    total = both + differ
    return np.where(total == 0, 1.0, both / np.maximum(total, 1))


def edited(text: str, after: str) -> str:
    """text with its last half replaced by the start of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare(texts: list[str]) -> pd.DataFrame:
    """Fingerprints of all texts but the last, each held against its edited text and the text after it."""
    n = len(texts) - 1
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    keys, at = digests(texts + changed)
    base = base_tables(keys, at)
    sizes = np.diff(at)
    own = np.arange(n)
    left, right = np.concatenate([own, own]), np.concatenate([own + n + 1, own + 1])
    near = likeness(sizes[left], sizes[right], differences(keys, at, base, left, right))
    return pd.DataFrame(
        {
            "n_chars": [len(t) for t in texts[:-1]],
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": fingerprints(base, range(n)),
            "edited_fingerprint": fingerprints(base, range(n + 1, 2 * n + 1)),
            "near_edited": near[:n],
            "near_next": near[n:],
        }
    )


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIRST = -(1 << 63)


def fingerprint_documents(docs: DataFrame, chunk_chars: int = 1_000_000) -> DataFrame:
    """One row for each document, held against the next in ascending order of id, then of a hash of the text, then of the text.

    Ids are cut into ranges at quantiles, and an id that many rows have into ranges of the hash; the texts are shuffled
    once, by range, and read in order; the first document of a range also goes to the range before it, as the next of its
    last one.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id"), F.lit(_FIRST)).alias("_at"), F.xxhash64(text).alias("_hash"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = rows.agg(F.percentile_approx("_at", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("m")).head()["m"]
    cuts, often = np.unique(np.array(marks or [], np.int64), return_counts=True)
    # the ranges of an id start at first[...]; an id between two cuts has one, one that is m cuts at once m
    first = np.concatenate([[0], np.cumsum(often)])

    @pandas_udf("int")
    def range_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, ids.to_numpy(), side="left")
        pieces = np.where(np.isin(ids.to_numpy(), cuts), np.append(often, 1)[at], 1)
        share = (hashes.to_numpy().astype(float) + 2.0**63) / 2.0**64
        return pd.Series(first[at] + np.minimum((share * pieces).astype(np.int64), pieces - 1))

    rows = rows.withColumn("_range", range_of("_at", "_hash"))
    firsts = rows.groupBy("_range").agg(F.min(F.struct("_at", "_hash")).alias("_first"))
    before = Window.orderBy("_range")
    firsts = firsts.withColumn("_before", F.coalesce(F.lag("_range").over(before), F.max("_range").over(Window.partitionBy(F.lit(0)))))
    tails = F.broadcast(firsts.select("_first._at", "_first._hash", "_before"))  # one row for each range at most
    marked = rows.join(tails, ["_at", "_hash"], "left")
    own = F.struct(F.col("_range").alias("_part"), F.lit(0).alias("_tail"))
    both = F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_before").alias("_part"), F.lit(1).alias("_tail"))))
    dealt = marked.select("doc_id", "text", "_at", "_hash", F.inline(both))
    ordered = dealt.repartition(ranges // 4, "_part").sortWithinPartitions("_part", "_tail", "_at", "_hash", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, ids, texts, size, closed = None, [], [], 0, False

        def done() -> pd.DataFrame:
            out = compare(texts)
            out.insert(0, "doc_id", pd.array(ids[: len(texts) - 1], "Int64"))
            return out

        for x in batches:
            for doc_id, text, p, tail in zip(x["doc_id"], x["text"], x["_part"], x["_tail"], strict=True):
                if p != part:
                    if len(texts) > 1:
                        yield done()
                    part, ids, texts, size, closed = p, [], [], 0, False
                if closed:
                    continue
                closed = bool(tail)
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                texts.append(text)
                size += len(text)
                if size >= chunk_chars and len(texts) > 1:
                    yield done()
                    ids, texts, size = ids[-1:], texts[-1:], len(text)
        if len(texts) > 1:
            yield done()

    return ordered.select("doc_id", "text", "_part", "_tail").mapInPandas(run, SCHEMA)
