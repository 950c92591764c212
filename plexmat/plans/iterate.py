"""Cutting the lineage of iterative plans, and running places over whole tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def saved(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that the session names (spark.checkpoint.dir), so that a lost executor costs no
    recomputation; where none is set, as in local runs, a temporary one is made."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, set if it isn't yet."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        conf = sc.getConf().get("spark.checkpoint.dir")
        if conf is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            conf = tempfile.mkdtemp(prefix="plexmat-")
            atexit.register(shutil.rmtree, conf, ignore_errors=True)
        sc.setCheckpointDir(conf)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the checkpoint folder: lineage ends there as with saved(), and joins know the table's size, so that Spark broadcasts what it finds small enough."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/plexmat/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, keys: list[str], bucket: Column, order: list, weight: Column | None = None, out: str = "_place") -> DataFrame:
    """Adds `out`: the sum of weight (1 without one) over the rows of the same keys that come before by (bucket, order).

    Two levels: sums of buckets are few and run in one place, rows run within their bucket; so neither a table without
    keys nor a key that most rows have comes together in one task. bucket must not decrease along the order.
    """
    weighed = df.withColumns({"_b": bucket, "_w": F.lit(1).cast("long") if weight is None else weight})
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = weighed.groupBy(*keys, "_b").agg(F.sum("_w").alias("_n")).select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = weighed.withColumn("_local", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    on = F.lit(True)
    for k in [*keys, "_b"]:
        on = on & local[k].eqNullSafe(base[k])
    return local.join(base, on).select(*[local[c] for c in df.columns], (F.col("_base") + F.col("_local")).alias(out))


#: Cells of a table that is handed to all runs at once.
SHARED_CELLS = 1 << 24


def packed(long: DataFrame, target: DataFrame) -> tuple[DataFrame, list[str]]:
    """Samples with a value as rows (sample_id, y, at, v), at being places in the sorted names of the features, which come beside; a
    table of cells takes a task some twenty times the memory. Samples that target lacks are left out."""
    names = sorted(r["feature"] for r in long.select("feature").distinct().collect())
    places = F.broadcast(long.sparkSession.createDataFrame(list(enumerate(names)), "_at int, feature string"))
    rows = long.where("value is not null").join(places, "feature").groupBy("sample_id").agg(F.collect_list("_at").alias("at"), F.collect_list("value").alias("v"))
    return rows.join(target.groupBy("sample_id").agg(F.first("y").alias("y")), "sample_id").select("sample_id", "y", "at", "v"), names


def unpacked(p: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The matrix of packed rows, samples in order, missing cells 0; y; and the samples."""
    p = p.sort_values("sample_id")
    m = np.zeros((len(p), width))
    for i, (at, v) in enumerate(zip(p["at"], p["v"], strict=True)):
        m[i, at] = v
    return m, p["y"].to_numpy(float), p["sample_id"].tolist()


def per_run(data: DataFrame, runs: DataFrame, keys: list[str], kernel: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str, width: int = 0) -> DataFrame:
    """kernel(key, data with the run's columns) for every row of runs, a task each.

    Every run reads all of data. A table of up to SHARED_CELLS cells is broadcast once, whatever the number of runs; a larger
    one is shuffled to the runs, a copy for each. width: numbers that a row has in arrays.
    """
    if data.count() * (len(data.columns) + width) > SHARED_CELLS:
        return data.join(F.broadcast(runs)).groupBy(*keys).applyInPandas(kernel, schema)
    shared = data.sparkSession.sparkContext.broadcast(data.toPandas())

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for row in x.to_dict("records"):
                own = shared.value.copy(deep=False)
                for c, v in row.items():
                    own[c] = pd.Series([v] * len(own), index=own.index)
                yield kernel(tuple(row[k] for k in keys), own)

    return runs.repartition(max(1, runs.count())).mapInPandas(go, schema)
