"""Sharding by weighted rendezvous hashing of stable record keys; DataFrame functions only.

Every shard draws a score for every key, u = md5(key ':' shard) as a number in (0, 1), score = -ln(u) / weight,
and the lowest score takes the key. A shard that is added takes rows only into itself, and a shard with twice
the weight takes twice the keys. Nothing is shuffled to place a row.

Null keys count as the empty key and share one shard; null texts count as empty; repeated rows take slots of
their own; columns of the input other than those asked for are left alone.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexmat.llm.common import key_text, running_offsets

#: The first 13 hexadecimal digits of a digest are 52 bits, which a double holds exactly.
_DIGITS, _SPAN = 13, float(16**13)


def scores(key: Column, weights: Mapping[int, float]) -> Column:
    """Array of (score, shard), in ascending order of shard."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    shards = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(s).alias("shard")) for s, w in sorted(weights.items())])
    name = key_text(key)

    def draw(x: Column) -> Column:
        digest = F.substring(F.md5(F.concat(name, F.lit(":"), x["shard"].cast("string"))), 1, _DIGITS)
        u = (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(_SPAN)
        return F.struct((-F.log(u) / x["w"]).alias("score"), x["shard"].alias("shard"))

    return F.transform(shards, draw)


def rendezvous_shard(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key."""
    return F.array_min(scores(key, weights))["shard"]


def assign(df: DataFrame, key: str, shards: int, weights: Mapping[int, float] | None = None, ties: tuple[str, ...] = (), grown_weight: float = 1.0) -> DataFrame:
    """Adds shard int, slot long (gapless from 0 in each shard) and grown_shard int (the shard with one more shard)."""
    weights = weights or {s: 1.0 for s in range(shards)}
    new = max(weights) + 1
    drawn = df.withColumn("_drawn", scores(F.col(key), {**weights, new: grown_weight}))
    best = drawn.withColumn("_best", F.array_min(F.slice("_drawn", 1, len(weights))))
    grown = F.when(F.element_at("_drawn", -1) < F.col("_best"), F.lit(new)).otherwise(F.col("_best")["shard"])
    placed = best.select(*df.columns, F.col("_best")["shard"].alias("shard"), grown.alias("grown_shard"))
    return running_offsets(placed, "shard", key, F.lit(1), "slot", ties)


def write_shards(df: DataFrame, path: str, key: str, weights: Mapping[int, float], files_per_shard: int = 16) -> None:
    """Writes df as one folder for each shard; rows of a shard spread over several tasks and files by their key."""
    placed = df.withColumn("shard", rendezvous_shard(F.col(key), weights))
    salt = F.pmod(F.xxhash64(key_text(F.col(key))), F.lit(files_per_shard))
    placed.repartition(len(weights) * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row for each document: its size, checksum, shard, slot, and shard when there is one more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = assign(sized, "doc_id", shards, ties=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
