"""What the text operators share: the shared folder, word and line columns, running offsets."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Hashable
from sys import getsizeof
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: what separates words everywhere in this subpackage (ASCII white space only).
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = f"[^{SPACE_CLASS}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (local runs) a temporary one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="plexmat-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return made.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plexmat/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What this worker keeps from one task to the next: one operator's table, as the stages of a pipeline run in the same workers.
_KEPT: dict[Hashable, Any] = {}


def kept_in_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """The table that this worker keeps under key, made if it isn't there; any other goes."""
    if key not in _KEPT:
        _KEPT.clear()
        _give_back()  # also what stages without a table have left
        _KEPT[key] = make()
    return _KEPT[key]


def keep_nothing() -> None:
    """For operators without a table: that of the stage before goes."""
    if _KEPT:
        _KEPT.clear()
        _give_back()


def _give_back() -> None:
    """Returns free memory to the system: an executor's workers outlive the stages of a pipeline, and what one stage has freed counts until then."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        with contextlib.suppress(OSError, AttributeError):  # another C library has nothing to trim
            ctypes.CDLL(None).malloc_trim(0)


class Remembered(dict):
    """What make() says of the words met lately, up to a fixed number of bytes with the words themselves, whatever the texts.

    Two generations: when the newer one has half of the bytes it becomes the older one, and words met again come back
    from there. Words of more than KEEP_CHARS characters are made anew each time.
    """

    KEEP_CHARS = 64
    #: Fixed value: bytes of a dict for each entry, at most, beside key and value.
    ENTRY_BYTES = 100

    def __init__(self, most_bytes: int = 48 << 20):
        super().__init__()
        self.most_bytes, self.bytes = most_bytes, 0
        self.older: dict[str, Any] = {}

    def make(self, word: str) -> Any:
        raise NotImplementedError

    def size(self, value: Any) -> int:
        return getsizeof(value)

    def __missing__(self, word: str) -> Any:
        value = self.older.pop(word, None)
        if value is None:
            value = self.make(word)
        if len(word) <= self.KEEP_CHARS:
            self.remember(word, value)
        return value

    def remember(self, word: str, value: Any) -> None:
        more = getsizeof(word) + self.size(value) + self.ENTRY_BYTES
        if 2 * (self.bytes + more) > self.most_bytes:
            self.older, self.bytes = dict(self), 0
            self.clear()
        self[word] = value
        self.bytes += more


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+")
    return F.array_remove(parts, "")


def key_text(key: Column) -> Column:
    """A record key as text; a null key counts as empty text."""
    return F.coalesce(key.cast("string"), F.lit(""))


def bucket_of(key: Column, digits: int = 3) -> Column:
    """A pseudorandom bucket of a record key: the first hexadecimal digits of its md5."""
    return F.substring(F.md5(key_text(key)), 1, digits)


def running_offsets(df: DataFrame, group: str, key: str, weight: Column, out: str, ties: tuple[str, ...] = (), digits: int = 3) -> DataFrame:
    """Adds `out`: the sum of `weight` over the rows of the same group that come before, in the order (bucket of key, key, ties).

    Two levels: rows are summed within (group, bucket), and only the 16**digits bucket totals of a group are
    summed in one place, so a group with a third of all rows still spreads over every task. `group` holds no nulls.
    """
    cols = df.columns
    keyed = df.withColumn("_bucket", bucket_of(F.col(key), digits)).withColumn("_weight", weight.cast("long"))
    totals = keyed.groupBy(group, "_bucket").agg(F.sum("_weight").alias("_total"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(group, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("_local", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    return local.join(base, [group, "_bucket"]).select(*cols, (F.col("_base") + F.col("_local")).alias(out))
