"""N-gram Jaccard join by chosen paths: all texts whose sets of word 5-grams have a Jaccard index of 0.8 or more.

Equal texts are one class from the start; what follows joins different texts. In each run a set chooses the tokens
whose hash is below CHOSEN / size, about CHOSEN of them, and joins their buckets. Two sets that share most tokens choose
a common one with known probability. Buckets up to SMALL sets are compared pair by pair; a larger one whose sets
mostly resemble one another is compared in blocks; any other is split by choosing again, among the bins of the sets' sketches,
seeded by the path so far. The number of runs follows from the target recall at the deepest level.

Comparing takes two steps. Sketches (64 bins, the lowest token of each) drop pairs that can't reach the threshold,
and for the rest the whole token sets (40-bit hashes) give the exact index. A pair that meets in several buckets
is counted in the lowest one. No pairs are written: each comparison writes, for each set, its number of links and the
lowest set that it is connected to there; components of these stars are the classes.

Words are runs of anything but ASCII white space, as they stand; a text of 1 to 4 words is one token. Null texts count
as empty, and empty texts are equal texts. Repeated rows are copies; a null id sorts before all others. Texts
are told apart by digest, not by id, so several may share an id or have none. Long texts are taken whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexmat.llm.common import SPACE_CLASS, Remembered, kept_in_worker, written

WORDS, THRESHOLD_NUM, THRESHOLD_DEN = 5, 4, 5  # Jaccard >= 4/5
#: Tokens that a set chooses on average; largest bucket that is compared at once; sets to a block; deepest level.
CHOSEN, SMALL, BLOCK, DEPTH = 2.0, 48, 192, 4
#: Recall of pairs right at the threshold, in the worst case (every bucket on the way split DEPTH times).
RECALL = 0.999
#: A large bucket with this mean similarity is compared in blocks: splitting would only repeat it.
DENSE = 0.5
BINS = 64
_FIND = re.compile(f"[^{SPACE_CLASS}]+").findall
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def id_key(name: str) -> Column:
    """An id as text that tells null from all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs so that a pair at the threshold meets in a leaf with probability `recall`.

    Sets of equal size with Jaccard index j share 2j / (1 + j) of their tokens, so a path has a Poisson number of
    common children with mean CHOSEN times that; q is the chance that some path survives to the given level.
    """
    j, q = THRESHOLD_NUM / THRESHOLD_DEN, 1.0
    for _ in range(depth - 1):  # below the first level sets choose among the bins of their sketches, a share j of which agree
        q = 1 - math.exp(-CHOSEN * j * q)
    q = 1 - math.exp(-CHOSEN * 2 * j / (1 + j) * q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


class WordHashes(Remembered):
    """Hashes of words."""

    def make(self, word: str) -> int:
        return xxhash.xxh3_64_intdigest(word)


def word_hashes() -> WordHashes:
    return kept_in_worker("word_hashes", WordHashes)


def tokens(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The distinct tokens of a text, ascending, as 40-bit numbers."""
    words = _FIND(text or "")
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(w) - WORDS + 1
    if not len(w):
        return w
    if n < 1:
        h = (w * _WEIGHTS[: len(w)]).sum(keepdims=True) + np.uint64(len(w))
    else:
        h = w[:n] * _WEIGHTS[0]
        for k in range(1, WORDS):
            h = h + w[k : n + k] * _WEIGHTS[k]
    return np.unique(mix(h) >> np.uint64(24))


def choose(own: np.ndarray, seed: int) -> np.ndarray:
    """Keys of the buckets that a set joins under a seed: the same token gives the same key in every set."""
    u = mix(own + np.uint64(seed & 0xFFFFFFFFFFFFFFFF))
    return mix(u[u.astype(float) < CHOSEN / max(len(own), 1) * 2.0**64] + np.uint64(1)).astype(np.int64)


def sketch(own: np.ndarray) -> bytes:
    """The lowest token of each of BINS ranges of (mixed) tokens, 16 bits of each; 0 for an empty bin."""
    out = np.zeros(BINS, np.uint16)
    if len(own):
        m = np.sort(mix(own))
        at = (m >> np.uint64(58)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[first]] = (m[first] & np.uint64(0xFFFF)) | np.uint64(1)
    return out.tobytes()


def sketch_tokens(data: bytes) -> np.ndarray:
    """The full bins of a sketch as tokens."""
    s = np.frombuffer(data, np.uint16).astype(np.uint64)
    return (np.arange(BINS, dtype=np.uint64) << np.uint64(16) | s)[s > 0]


def to_bytes(own: np.ndarray) -> bytes:
    """40-bit tokens, 5 bytes each."""
    return own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _shared_leaf_before(leaves: list[np.ndarray], bucket: int) -> np.ndarray:
    """Which pairs also meet in a leaf below this one."""
    lists = [x[x < bucket] for x in leaves]
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    if not len(flat):
        return np.zeros((len(leaves), len(leaves)), bool)
    names, at = np.unique(flat, return_inverse=True)
    m = np.zeros((len(leaves), len(names)), np.float32)
    m[np.repeat(np.arange(len(lists)), [len(x) for x in lists]), at] = 1
    return m @ m.T > 0


def _sides(side: np.ndarray) -> np.ndarray:
    """Which pairs (i < j) a task compares: all of a bucket or block, or those across two blocks."""
    n = len(side)
    upper = np.triu(np.ones((n, n), bool), 1)
    return upper & (side[:, None] != side[None, :]) if side.any() else upper


def alike(sketches: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Which pairs may reach the threshold, from sizes and sketches; errs on the side of keeping."""
    n = sizes.astype(np.int64)
    fits = THRESHOLD_DEN * np.minimum(n[:, None], n[None, :]) >= THRESHOLD_NUM * np.maximum(n[:, None], n[None, :])
    s = np.frombuffer(b"".join(sketches), np.uint16).reshape(-1, BINS)
    equal, used = np.zeros((len(n), len(n)), np.int16), np.zeros((len(n), len(n)), np.int16)
    for k in range(BINS):
        c = s[:, k]
        full = c > 0
        equal += (c[:, None] == c[None, :]) & full[:, None]
        used += full[:, None] | full[None, :]
    # the share of equal bins estimates the index; 5 standard deviations below 0.8 are let through
    least = 0.8 - 5 * np.sqrt(0.16 / np.maximum(used, 1))
    return fits & (equal >= least * used)


def links(sets: list[np.ndarray], wanted: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Which of the wanted pairs reach the threshold, exactly: common tokens counted by blocks of a 0/1 matrix."""
    sizes = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    same = flat[1:] == flat[:-1]
    multi = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    flat, owner = flat[multi], owner[multi]
    number = np.cumsum(np.concatenate([[0], (flat[1:] != flat[:-1]).astype(np.int64)])) if len(flat) else flat.astype(np.int64)
    common = np.zeros((len(sets), len(sets)), np.float64)
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        a, b = np.searchsorted(number, (first, first + columns))
        m = np.zeros((len(sets), columns), np.float32)
        m[owner[a:b], number[a:b] - first] = 1
        common += m @ m.T
    total = sizes[:, None] + sizes[None, :]
    return wanted & ((THRESHOLD_NUM + THRESHOLD_DEN) * common.astype(np.int64) >= THRESHOLD_NUM * total)


def _tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the same task, from rows sorted by task; a repeated row counts once."""
    held: list[pd.DataFrame] = []
    for x in batches:
        if not len(x):
            continue
        cuts = np.flatnonzero(np.concatenate([[True], x["task"].to_numpy()[1:] != x["task"].to_numpy()[:-1]])).tolist() + [len(x)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = x.iloc[a:b]
            if held and held[-1]["task"].iloc[0] != part["task"].iloc[0]:
                yield pd.concat(held).drop_duplicates("num") if len(held) > 1 else held[0].drop_duplicates("num")
                held = []
            held.append(part)
    if held:
        yield pd.concat(held).drop_duplicates("num")


class Join:
    """The join over a frame of documents; every table it needs twice is written to the shared folder."""

    def __init__(self, docs: DataFrame, recall: float = RECALL):
        self.runs = runs_for(recall)
        text = F.coalesce(F.col("text"), F.lit(""))
        self.docs = docs.select(F.col("doc_id").alias("id"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"))
        seen = self._chosen()
        self.seen = written(seen.select(F.when(F.col("known"), F.col("id")).alias("id"), *seen.columns[2:]), "chosen")
        texts = self.seen.groupBy("digest").agg(F.min(F.struct("id"))["id"].alias("rep"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
        # Ids may be null or stand for several texts, so a text is known by a number of its own.
        self.texts = written(texts.withColumn("num", F.monotonically_increasing_id()), "texts")

    def _chosen(self) -> DataFrame:
        seeds = [0x51ED270B + r for r in range(self.runs)]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashes = word_hashes()
            for x in batches:
                sets = [tokens(t, hashes) for t in x["text"]]
                keys = [np.concatenate([choose(s, int(mix(np.uint64([seed]))[0])) for seed in seeds]) if len(s) else np.zeros(0, np.int64) for s in sets]
                yield pd.DataFrame({"id": x["id"], "known": x["known"], "digest": x["digest"], "size": [len(s) for s in sets], "sketch": [sketch(s) for s in sets], "keys": keys})

        # pandas would turn a column of ids with nulls into doubles
        given = self.docs.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("known"), "digest", "text")
        return given.mapInPandas(run, "id long, known boolean, digest string, size int, sketch binary, keys array<long>")

    def _sets(self, active: DataFrame) -> DataFrame:
        """Token sets of the texts of these numbers. The texts are shuffled once, whatever how many are asked for."""
        named = active.join(self.texts.select("num", "rep", "digest"), "num").select("num", id_key("rep").alias("_key"), "digest")
        wanted = self.docs.select(id_key("id").alias("_key"), "digest", "text").join(named.hint("merge"), ["_key", "digest"]).select("num", "text")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashes = word_hashes()
            for x in batches:
                yield pd.DataFrame({"num": x["num"], "set": [to_bytes(tokens(t, hashes)) for t in x["text"]]})

        return wanted.mapInPandas(run, "num long, set binary")

    def _sort_out(self, rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """Leaves that are small or dense (bucket, num, n), and rows (key, num) of the buckets to split further."""
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        rows = written(rows.join(sizes, "key"), f"buckets{level}")
        small, large = rows.where(F.col("n") <= SMALL), rows.where(F.col("n") > SMALL)
        # equal small buckets are one
        lists = small.groupBy("key").agg(F.sort_array(F.collect_list("num")).alias("nums")).groupBy("nums").agg(F.min("key").alias("bucket"))
        leaves = lists.select("bucket", F.explode("nums").alias("num"), F.size("nums").cast("long").alias("n"))
        if level >= DEPTH:
            return leaves.unionByName(large.select(F.col("key").alias("bucket"), "num", "n")), large.where("false")
        # about SMALL members of each large bucket show how alike its sets are
        probe = large.where(F.pmod(F.xxhash64("key", "num"), F.col("n")) < SMALL).join(self.texts.select("num", "sketch"), "num")
        probe = probe.groupBy("key").agg(F.collect_list("sketch").alias("sketches"))

        def likeness(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                out = []
                for own in x["sketches"]:
                    s = np.frombuffer(b"".join(own), np.uint16).reshape(-1, BINS)
                    n = len(s)
                    hit = sum(int((c * (c - 1)).sum()) for k in range(BINS) for c in [np.unique(s[:, k][s[:, k] > 0], return_counts=True)[1]])
                    full = sum(n * (n - 1) - e * (e - 1) for e in (s == 0).sum(0).tolist())
                    out.append(hit / full if full else 0.0)
                yield pd.DataFrame({"key": x["key"], "like": out})

        dense = probe.mapInPandas(likeness, "key long, like double").where(F.col("like") >= DENSE).select("key", F.lit(True).alias("dense"))
        large = written(large.join(dense, "key", "left"), f"large{level}")
        # Dense buckets that share their lowest member (by a hash) hold mostly the same sets: they are compared as one.
        full = large.where("dense").select("key", "num")
        anchor = full.groupBy("key").agg(F.xxhash64(F.lit(level), F.min_by("num", F.struct(F.xxhash64("num"), "num"))).alias("bucket"))
        merged = full.join(anchor, "key").select("bucket", "num").distinct()
        merged = merged.join(merged.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
        leaves = leaves.unionByName(merged.select("bucket", "num", "n"))
        return leaves, large.where("dense is null").select("key", "num")

    def leaves(self) -> DataFrame:
        """All leaves (bucket, num, n)."""
        rows = self.texts.select("num", F.explode(F.array_distinct("keys")).alias("key"))
        found, rest = self._sort_out(rows, 1)
        out = written(found, "leaves")

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                keys = [choose(sketch_tokens(s), int(mix(np.uint64([k & 0xFFFFFFFFFFFFFFFF]))[0])) for s, k in zip(x["sketch"], x["key"], strict=True)]
                yield pd.DataFrame({"key": np.concatenate(keys) if keys else np.zeros(0, np.int64), "num": np.repeat(x["num"].to_numpy(), [len(k) for k in keys])})

        for level in range(2, DEPTH + 1):
            if rest.isEmpty():
                break
            rows = rest.join(self.texts.select("num", "sketch"), "num").select("key", "num", "sketch").mapInPandas(split, "key long, num long").distinct()
            found, rest = self._sort_out(rows, level)
            out = out.unionByName(written(found, "leaves"))
        return out

    def stars(self) -> DataFrame:
        """For each comparison and set in it with links: num, root (the lowest set it is connected to), n_links."""
        leaves = self.leaves()
        of_text = leaves.groupBy("num").agg(F.sort_array(F.collect_set("bucket")).alias("leaves"))
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("num"), blocks).cast("int")
        # a bucket of several blocks is compared block by block, each pair of blocks a task
        pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(F.least(b, own).alias("i"), F.greatest(b, own).alias("j"), (own > b).cast("int").alias("side")))
        dealt = leaves.select("bucket", "num", F.inline(F.when(blocks > 1, pairs).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))))))
        dealt = dealt.withColumn("task", F.xxhash64("bucket", "i", "j"))
        rows = dealt.join(self.texts.select("num", "size", "sketch").join(of_text, "num"), "num")

        def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in _tasks(batches):
                if len(x) < 2:
                    continue
                leaf = [np.asarray(v) for v in x["leaves"]]
                pairs = _sides(x["side"].to_numpy()) & alike(x["sketch"].tolist(), x["size"].to_numpy())
                if pairs.any():
                    pairs &= ~_shared_leaf_before(leaf, int(x["bucket"].iloc[0]))
                    keep = pairs.any(0) | pairs.any(1)
                    yield x.loc[keep, ["task", "bucket", "side", "num", "leaves"]]

        tasks = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
        screened = rows.repartition(tasks, "task").sortWithinPartitions("task").mapInPandas(screen, "task long, bucket long, side int, num long, leaves array<long>")
        screened = written(screened, "screened")
        screened = screened.join(written(self._sets(screened.select("num").distinct()), "sets"), "num")

        def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in _tasks(batches):
                if len(x) < 2:
                    continue
                pairs = _sides(x["side"].to_numpy()) & ~_shared_leaf_before([np.asarray(v) for v in x["leaves"]], int(x["bucket"].iloc[0]))
                pairs = links([from_bytes(s) for s in x["set"]], pairs)
                either = pairs | pairs.T
                count = either.sum(1)
                nums = x["num"].to_numpy()
                root = nums.copy()
                while True:  # the lowest set reachable, by repeated minima over links
                    low = np.where(either, root[None, :], np.iinfo(np.int64).max).min(1)
                    new = np.minimum(root, low)
                    if (new == root).all():
                        break
                    root = new
                some = count > 0
                if some.any():
                    yield pd.DataFrame({"num": nums[some], "root": root[some], "n_links": count[some].astype(np.int64)})

        out = screened.repartition(tasks, "task").sortWithinPartitions("task").mapInPandas(verify, "num long, root long, n_links long")
        return written(out, "stars")

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """(num, label) of all texts in links, by lowest labels and pointer jumping; and (num, n_links)."""
        stars = self.stars()
        counts = stars.groupBy("num").agg(F.sum("n_links").alias("n_links"))
        edges = stars.where("num <> root").select("num", "root").distinct()
        both = written(edges.unionByName(edges.select(F.col("root").alias("num"), F.col("num").alias("root"))).distinct(), "edges")
        labels = written(both.groupBy("num").agg(F.min("root").alias("_low")).select("num", F.least("num", "_low").alias("label")), "labels")
        while True:
            near = both.join(labels.select(F.col("num").alias("root"), "label"), "root").groupBy("num").agg(F.min("label").alias("_near"))
            step = labels.join(near, "num").select("num", F.least("label", "_near").alias("label"), F.col("label").alias("was"))
            jump = step.join(labels.select(F.col("num").alias("label"), F.col("label").alias("_far")), "label", "left")
            labels = written(jump.select("num", F.least("label", F.coalesce("_far", "label")).alias("label"), "was"), "labels")
            if labels.where("label <> was").isEmpty():
                return labels.select("num", "label"), counts
            labels = labels.select("num", "label")

    def result(self) -> DataFrame:
        """One row for each document: doc_id, digest, rep, class_id, _first (digest), n_links (different texts), n_copies (documents with its text).

        rep is the lowest id with the text, class_id that of its class; _first is the text of the class with the lowest (id, digest).
        """
        labels, counts = self.classes()
        linked = written(self.texts.select("num", "digest", "rep").join(labels, "num"), "linked")
        firsts = linked.groupBy("label").agg(F.min(F.struct("rep", "digest")).alias("_low"))
        found = linked.select("num", "label").join(firsts, "label").select("num", "_low")
        named = self.texts.select("num", "digest", "rep", "n_copies").join(found, "num", "left").join(counts, "num", "left")
        low = F.coalesce("_low", F.struct("rep", "digest"))
        named = named.select("digest", "rep", low["rep"].alias("class_id"), low["digest"].alias("_first"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
        rows = self.seen.select(F.col("id").alias("doc_id"), "digest").join(named, "digest")
        return rows.select("doc_id", "digest", "rep", "class_id", "_first", "n_links", "n_copies")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: its class, the first document with its text, links to different texts, copies.

    class_id is the lowest id in the class, null where that id is; class_key, the digest of the class's first text, tells
    classes apart even where ids are null or shared.
    """
    return Join(docs).result().select("doc_id", "class_id", F.col("_first").alias("class_key"), "rep", "n_links", "n_copies")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: the one of lowest id, then digest; of repeated rows one stays."""
    found = Join(docs.select("doc_id", "text")).result().where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("_first")))
    keys = found.select(id_key("doc_id").alias("_id"), "digest").distinct()
    own = docs.select(id_key("doc_id").alias("_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest"), F.struct(*docs.columns).alias("_own"))
    return own.join(keys, ["_id", "digest"], "left_semi").dropDuplicates(["_id", "digest"]).select("_own.*")
