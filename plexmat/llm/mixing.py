"""Mixing sources to target weights in fixed-length blocks.

The words of a source, documents in a pseudorandom order, are packed into blocks of BLOCK words. Each source has a
target in words; the slots that this takes are dealt over output shards by multinomial draws, each shard's draw from
the slots that are left, so the shards' counts add up to the targets. Slot t of a source reads the block that
a keyed permutation of the source's block indices (a Feistel network with cycle walking) gives for t; slots are joined
to blocks by index. A source is read whole as often as its target allows, and the rest of the target is the first slots
of one more permutation, the last of them cut to length: every source's words come to its target, rounded, and no
document is taken more often than its source, rounded up.

Null texts have no words; a null source is a source of its own, last; documents without words are taken 0 times;
repeated rows are documents of their own. The number of sources is taken to be small (their names and sizes reach the
driver, with documents, blocks and slots never doing so).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plexmat.llm.common import SPACE_CLASS, keep_nothing, key_text, running_offsets, written

BLOCK = 256
#: Fixed values of the query: weights in turn, words taken of all words, most of a source's own size.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take of each source: weights in turn, no more than `most` times its size, the excess dealt anew by weight."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))])
    size = np.array(sizes, float)
    limit, total = most * size, share * size.sum()
    out, free = np.zeros(len(sizes)), size > 0
    while free.any():
        left = total - out[~free].sum()
        out[free] = left * w[free] / w[free].sum()
        over = free & (out > limit)
        if not over.any():
            break
        out[over] = limit[over]
        free &= ~over
    return out.tolist()


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def permuted(t: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The places of t under a pseudorandom permutation of 0 .. n-1, or (back) what has its place at t."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [int.from_bytes(np.random.SeedSequence([seed, r]).generate_state(2).tobytes(), "little") for r in range(4)]

    def step(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for key in reversed(keys) if back else keys:
            if back:
                a, b = b ^ (_round(a, key) & mask), a
            else:
                a, b = b, a ^ (_round(b, key) & mask)
        return a << np.uint64(half) | b

    out = step(np.asarray(t).astype(np.uint64))
    while (far := out >= n).any():  # walk the cycle until it comes back into the range
        out[far] = step(out[far])
    return out.astype(np.int64)


def source_plan(size: int, target: float, block: int, seed: int) -> dict:
    """How a source is read: whole `passes` times, then `slots` permuted blocks of one more pass, the last cut to `cut` words."""
    blocks, want = -(-size // block), int(np.floor(target + 0.5))
    passes, rest = divmod(want, size) if size else (0, 0)
    if not rest:
        return {"blocks": blocks, "passes": passes, "slots": 0, "cut": block}
    tail = size - (blocks - 1) * block  # words of the last block
    at = int(permuted(np.array([blocks - 1]), blocks, seed, back=True)[0])  # its slot
    if rest <= at * block:  # the slots before it are all full
        slots = -(-rest // block)
        return {"blocks": blocks, "passes": passes, "slots": slots, "cut": rest - (slots - 1) * block}
    if rest <= at * block + tail:
        return {"blocks": blocks, "passes": passes, "slots": at + 1, "cut": rest - at * block}
    more = -(-(rest - at * block - tail) // block)
    return {"blocks": blocks, "passes": passes, "slots": at + 1 + more, "cut": rest - (at + more) * block - tail + block}


def deal(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source for each output shard: multinomial draws over the slots that are left."""
    rng, left = np.random.default_rng(seed), np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for k in range(shards):
        n = int(left.sum()) // (shards - k)
        draw = np.minimum(rng.multinomial(n, left / left.sum()) if left.sum() else 0 * left, left)
        for s in np.argsort(-(left - draw)):  # what a nearly empty source could not give comes from the fullest
            more = min(n - int(draw.sum()), int(left[s] - draw[s]))
            draw[s] += max(0, more)
        out[k], left = draw, left - draw
    return out


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


class Mixture:
    """The blocks of all sources, the plan of each source, and the slots of every output shard."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, shards: int = 64, seed: int = 20, **law):
        self.block, self.shards, self.seed = block, shards, seed
        words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(f"[^{SPACE_CLASS}]+")).cast("long")
        tagged = docs.select("doc_id", _source_key().alias("_source"), words.alias("size"), _text_key().alias("_text_key"))
        self.docs = written(running_offsets(tagged, "_source", "doc_id", F.col("size"), "start", ties=("_text_key",)), "mixture")
        size_of = {r["_source"]: int(r["n"]) for r in self.docs.groupBy("_source").agg(F.sum("size").alias("n")).collect()}
        # ascending by code point, null (the empty key) last
        self.sources = sorted(size_of, key=lambda s: (s == "", s))
        self.sizes = [size_of[s] for s in self.sources]
        self.targets = targets(self.sizes, **law)
        self.plans = [source_plan(n, t, block, self.seed_of(i, None)) for i, (n, t) in enumerate(zip(self.sizes, self.targets, strict=True))]

    def seed_of(self, number: int, whole_pass: int | None) -> int:
        """Each pass over a source has a permutation of its own; None is the part pass."""
        return (self.seed * 1_000_003 + number) * 1_009 + (0 if whole_pass is None else whole_pass + 1)

    def laws(self) -> DataFrame:
        """One row for each source: its key, number, size and target."""
        rows = [(s, i, n, float(t)) for i, (s, n, t) in enumerate(zip(self.sources, self.sizes, self.targets, strict=True))]
        return self.docs.sparkSession.createDataFrame(rows, "_source string, _number int, source_size long, target double")

    def slots(self, piece: int = 1 << 16) -> DataFrame:
        """Every slot: shard, _number, _pass, _block, and how many words of the block are read (less in the last slot)."""
        plans, block = self.plans, self.block
        counts = deal([p["passes"] * p["blocks"] + p["slots"] for p in plans], self.shards, self.seed)
        ends = np.cumsum(counts, 0)
        tasks = [(k, i, int(a), int(min(a + piece, ends[k, i]))) for k in range(self.shards) for i in range(len(plans)) for a in range(ends[k, i] - counts[k, i], ends[k, i], piece)]
        spark = self.docs.sparkSession
        frame = spark.createDataFrame(tasks or [], "shard int, i int, a long, b long").repartition(max(1, min(len(tasks), int(spark.conf.get("spark.sql.shuffle.partitions")))))
        seed_of = {(i, q): self.seed_of(i, q if q < p["passes"] else None) for i, p in enumerate(plans) for q in range(p["passes"] + 1)}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                for shard, i, a, b in zip(x["shard"], x["i"], x["a"], x["b"], strict=True):
                    p = plans[i]
                    t = np.arange(a, b)
                    at, inside = t // p["blocks"], t % p["blocks"]
                    for q in np.unique(at).tolist():
                        own = inside[at == q]
                        last = (q == p["passes"]) & (own == p["slots"] - 1)
                        yield pd.DataFrame({"shard": shard, "_number": i, "_pass": q, "_block": permuted(own, p["blocks"], seed_of[i, q]), "_words": np.where(last, p["cut"], block)})

        return frame.mapInPandas(run, "shard int, _number int, _pass int, _block long, _words long")

    def pieces(self) -> DataFrame:
        """For each document and each slot that reads a block of it: the words (from, upto) of the document taken."""
        docs = self.docs.join(F.broadcast(self.laws().select("_source", "_number")), "_source").where(F.col("size") > 0)
        blocks = F.sequence(F.expr(f"start div {self.block}"), F.expr(f"(start + size - 1) div {self.block}"))
        parts = docs.select("doc_id", "_source", "_text_key", "_number", "start", "size", F.explode(blocks).alias("_block"))
        # the slots are made by few task rows but are many: without the hint their size is taken for the rows'
        got = parts.join(self.slots().hint("merge"), ["_number", "_block"])
        begin = F.col("_block") * self.block - F.col("start")
        low, high = F.greatest(begin, F.lit(0)), F.least(begin + F.col("_words"), F.col("size"))
        return got.select("doc_id", "_source", "_text_key", "start", "shard", "_pass", low.alias("from"), high.alias("upto")).where(F.col("upto") > F.col("from"))


def mix_documents(docs: DataFrame, **law) -> DataFrame:
    """One row for each document: size, source_size, target of its source, and the words that the mix takes of it."""
    mix = Mixture(docs, **law)
    taken = mix.pieces().groupBy("_source", "start").agg(F.sum(F.col("upto") - F.col("from")).alias("taken"))
    # Documents with words have starts of their own within a source; those without words are in no block.
    rows = mix.docs.withColumn("_at", F.when(F.col("size") > 0, F.col("start")).otherwise(-1 - F.col("start")))
    found = rows.join(taken.withColumnRenamed("start", "_at"), ["_source", "_at"], "left").join(F.broadcast(mix.laws()), "_source")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


@F.pandas_udf(StringType())
def take_words(texts: pd.Series, runs: pd.Series) -> pd.Series:
    """The runs of words of a text, each as it stands in the text; runs that touch stay together, others are joined by a line end."""
    keep_nothing()
    find, out = re.compile(f"[^{SPACE_CLASS}]+").finditer, []
    for text, own in zip(texts, runs, strict=True):
        marks = [m.span() for m in find(text)]
        joined: list[list[int]] = []
        for r in own:
            if joined and joined[-1][1] == r["from"]:
                joined[-1][1] = r["upto"]
            else:
                joined.append([r["from"], r["upto"]])
        out.append(text if joined == [[0, len(marks)]] else "\n".join(text[marks[a][0] : marks[b - 1][1]] for a, b in joined))
    return pd.Series(out, dtype=object)


def _row_key() -> Column:
    return key_text(F.struct("doc_id").cast("string"))


def _dealt_to_equal_rows(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """A plan to a row: both are numbered within their group of equal rows and joined by the number, so that a group of any
    size is spread over all tasks. Rows are numbered within the input partition that they come from, plans within buckets;
    which of its equal rows gets which plan makes no difference but for columns beside id, source and text, by whose hash rows are ordered.
    """
    group = F.concat_ws("\x01", "_key", "_source", F.col("_text_key").cast("string"))
    part = Window.partitionBy("_group", "_part").orderBy(F.md5(F.to_json(F.struct("_own")).cast("binary")))
    # Written, since a row's partition need not be the same when it is computed again.
    rows = written(rows.select(group.alias("_group"), "_part", "_own"), "mix-equal").withColumn("_place", F.row_number().over(part) - 1)
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_group", "_part").agg(F.count("*").alias("_n")).select("_group", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rows = rows.join(base, ["_group", "_part"]).select("_group", (F.col("_base") + F.col("_place")).alias("_turn"), "_own")
    plans = running_offsets(plans.select(group.alias("_group"), "start", "passes"), "_group", "start", F.lit(1), "_turn")
    return rows.join(plans, ["_group", "_turn"]).select("_own", F.col("passes").alias("_passes"))


def apply_mix(docs: DataFrame, **law) -> DataFrame:
    """The mixed documents, with the columns of docs: a row for each pass over its source that reads words of it, with
    those words as text (all of it where the pass is whole); n_chars follows the text. Documents without words go.
    """
    mix = Mixture(docs, **law)
    runs = mix.pieces().groupBy("doc_id", "_source", "_text_key", "start", "_pass").agg(F.sort_array(F.collect_list(F.struct("from", "upto"))).alias("runs"))
    keys = ["_key", "_source", "_text_key"]
    plans = runs.withColumn("_key", _row_key()).groupBy(*keys, "start").agg(F.collect_list("runs").alias("passes"))
    rows_of = mix.docs.groupBy(_row_key().alias("_key"), "_source", "_text_key").agg(F.count("*").alias("_rows"))
    plans = written(plans.join(rows_of, keys), "mix-plans")
    own = docs.select(_row_key().alias("_key"), _source_key().alias("_source"), _text_key().alias("_text_key"), F.spark_partition_id().cast("string").alias("_part"), F.struct(*docs.columns).alias("_own"))
    each = own.join(plans.where("_rows = 1"), keys).select("_own", F.col("passes").alias("_passes"))
    equal = plans.where("_rows > 1")
    if not equal.isEmpty():
        each = each.unionByName(_dealt_to_equal_rows(own.join(equal.select(*keys).distinct(), keys, "left_semi"), equal))
    each = each.select("_own", F.explode("_passes").alias("_runs"))
    each = each.select("_own", take_words(F.col("_own")["text"], F.col("_runs")).alias("_text"))
    given = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return each.select(*[(given[c] if c in given else F.col("_own")[c]).alias(c) for c in docs.columns])
