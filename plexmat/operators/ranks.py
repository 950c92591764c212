"""Exact order statistics of many groups at once, without bringing a group together in one task.

The values of a group between two bounds are counted in BINS equal bins (counts, least and greatest of each bin: a map-side
aggregate), a running count over the bins tells in which of them a wanted rank lies, and that bin's own least and greatest value
are the next bounds. A rank is settled when its bounds are equal. Intervals of at most FEW values are numbered at last, each
in a window of that many rows. Whatever the size or the shape of a group, no task sees more of it than one bin of FEW values
or BINS counts, and results are exact; all ranks of all groups share the same passes, and ranks in one interval its counts.

Nulls and NaN are left out. Infinite values are ordinary: they are least or greatest, bounds of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexmat.plans.iterate import written

BINS, FEW = 1024, 4096
#: Intervals up to this number are broadcast to the values, more are joined by a shuffle.
INTERVALS = 100_000


def _tagged(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with _g_ before the names of some columns, so that a join of two frames from one source can tell them apart."""
    return df.withColumnsRenamed({c: f"_g_{c}" for c in columns})


def _same(columns: list[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return on


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], Column]) -> DataFrame:
    """For each group: keys, n (its values), ranks and values, the values at the ranks (from 0) that ranks(n), an array, asks for."""
    few = FEW
    cells = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("v"))
    size = cells.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = size.withColumn("ranks", F.transform(ranks(F.col("n")), lambda r: r.cast("long")))
    goals = asked.select(*keys, "lo", "hi", F.col("n").alias("held"), F.explode(F.array_distinct("ranks")).alias("rank")).withColumn("r", F.col("rank"))
    goals = written(goals, "goals")
    asked = written(asked, "asked")
    while True:
        open_ = goals.where((F.col("lo") < F.col("hi")) & (F.col("held") > few))
        if open_.isEmpty():
            break
        goals = written(goals.where((F.col("lo") >= F.col("hi")) | (F.col("held") <= few)).unionByName(_narrowed(cells, open_, keys)), "goals")
    done = goals.where("lo >= hi").select(*keys, "rank", F.col("lo").alias("v"))
    rest = goals.where("lo < hi")
    if not rest.isEmpty():
        done = done.unionByName(_numbered(cells, rest, keys))
    found = _tagged(done.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_at")), keys)
    out = asked.join(found, _same(keys), "left")
    return out.select(*keys, "n", "ranks", F.transform("ranks", lambda r: F.element_at("_at", r)).alias("values"))


def _inside(cells: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Values with the interval (keys, lo, hi) that they are in."""
    few = intervals.limit(INTERVALS + 1).count() <= INTERVALS
    own = _tagged(intervals, keys)
    return cells.join(F.broadcast(own) if few else own, _same(keys) & F.col("v").between(F.col("lo"), F.col("hi"))).select(*keys, "lo", "hi", "v")


def _narrowed(cells: DataFrame, goals: DataFrame, keys: list[str]) -> DataFrame:
    """Goals with the bin that their rank lies in as interval. Infinite values have bins of their own."""
    at = [*keys, "lo", "hi"]
    own = _inside(cells, goals.select(*at).distinct(), keys)
    big = F.lit(1.7976931348623157e308)
    low, high = F.greatest("lo", -big), F.least("hi", big)
    # halves keep the width finite; where it vanishes the bounds are neighbours among doubles
    share = F.coalesce(F.try_divide(F.col("v") / 2 - low / 2, high / 2 - low / 2), (F.col("v") > low).cast("double"))
    infinite = F.when(F.col("v") == float("-inf"), -1).when(F.col("v") == float("inf"), BINS)
    place = F.coalesce(infinite, F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int"))
    bins = own.groupBy(*at, place.alias("bin")).agg(F.count("*").alias("held"), F.min("v").alias("low"), F.max("v").alias("high"))
    bins = bins.withColumn("upto", F.sum("held").over(Window.partitionBy(*at).orderBy("bin")))
    wanted = _tagged(goals.select(*at, "rank", "r"), at)
    met = bins.join(wanted, _same(at) & (F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("held")))
    return met.select(*keys, F.col("low").alias("lo"), F.col("high").alias("hi"), "held", "rank", (F.col("r") - F.col("upto") + F.col("held")).alias("r"))


def _numbered(cells: DataFrame, goals: DataFrame, keys: list[str]) -> DataFrame:
    """The values of goals whose intervals have few values."""
    at = [*keys, "lo", "hi"]
    own = _inside(cells, goals.select(*at).distinct(), keys)
    placed = own.withColumn("r", (F.row_number().over(Window.partitionBy(*at).orderBy("v")) - 1).cast("long"))
    return placed.join(_tagged(goals.select(*at, "rank", "r"), [*at, "r"]), _same([*at, "r"])).select(*keys, "rank", "v")


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """keys, n and quantiles (an array), interpolated between the values around (n - 1) * p, as percentile() does.

    Where no group has more than FEW values percentile() itself is used, which then holds no more in a task than the last step here does.
    """
    cells = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    largest = cells.groupBy(*keys).count().agg(F.max("count")).head()[0] or 0
    if largest <= FEW:
        return cells.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in probabilities])).alias("quantiles")).where("n > 0")
    place = lambda n, p: (n - 1) * F.lit(float(p))
    at = lambda n: F.array(*[f(place(n, p)) for p in probabilities for f in (F.floor, F.ceil)])
    found = order_statistics(df, keys, value, at)
    v = lambda i: F.col("values")[i]
    share = lambda p: place(F.col("n"), p) - F.floor(place(F.col("n"), p))
    mixed = [F.when(v(2 * i) == v(2 * i + 1), v(2 * i)).otherwise((1 - share(p)) * v(2 * i) + share(p) * v(2 * i + 1)) for i, p in enumerate(probabilities)]
    return found.select(*keys, "n", F.array(*mixed).alias("quantiles"))


def medians(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """keys and the median of each group; groups without values are not in the table."""
    return quantiles(df, keys, value, [0.5]).select(*keys, F.col("quantiles")[0].alias(out))
