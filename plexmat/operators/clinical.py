"""Clinical tables: one row for each sample, columns of mixed kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexmat.operators import ranks


def _medians(df: DataFrame, columns: list[str]) -> DataFrame:
    return F.broadcast(df.agg(*[F.median(c).alias(f"_m_{c}") for c in columns]))


def ordinal(df: DataFrame, maps: dict[str, dict[str, float]], impute: bool = False) -> DataFrame:
    """Text made numbers by a map of trimmed lower-case values; what isn't in it is missing, or the median on demand."""
    def code(c: str) -> Column:
        pairs = [F.lit(x) for k, v in maps[c].items() for x in (str(k).strip().lower(), float(v))]
        return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(F.col(c).cast("string"))))

    own = [c for c in maps if c in df.columns]
    out = df.withColumns({c: code(c) for c in own})
    if impute and own:
        out = out.join(_medians(out, own)).withColumns({c: F.coalesce(c, f"_m_{c}") for c in own}).drop(*[f"_m_{c}" for c in own])
    return out


def numeric(df: DataFrame, columns: list[str], impute: bool = True, scale: bool = False) -> DataFrame:
    """Columns cast to numbers (what is none is missing), medians for missing ones, and (v - median) / (q75 - q25) on demand."""
    out = df.withColumns({c: F.col(c).try_cast("double") for c in columns})
    cells = out.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns]))) if columns else None
    found = {r["column"]: r["quantiles"] for r in ranks.quantiles(cells, ["column"], "v", [0.25, 0.5, 0.75]).collect()} if columns else {}  # a row for each named column
    for c in columns:
        q, v = [F.lit(x).cast("double") for x in found.get(c, [None] * 3)], F.col(c)
        if impute:
            v = F.coalesce(v, q[1])
        if scale:
            v = (v - q[1]) / F.coalesce(F.nullif(q[2] - q[0], F.lit(0.0)), F.lit(1.0))
        out = out.withColumn(c, v)
    return out


def one_hot(df: DataFrame, columns: list[str]) -> DataFrame:
    """Indicators of the sorted categories (trimmed, lower case) but the first, and of missing values. Categories are few: their names become columns."""
    out = df
    for c in columns:
        text = F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit("nan"))
        names = sorted(r[0] for r in df.select(text.alias("v")).where("v is not null").distinct().collect())
        for n in names[1:]:
            out = out.withColumn(f"{c}_{n}", F.when(text == n, 1).otherwise(0))
        out = out.withColumn(f"{c}_nan", F.when(text.isNull(), 1).otherwise(0))
    return out.drop(*columns)


def preprocess(df: DataFrame, key: str = "sample_id", ordinal_maps: dict | None = None, continuous: list[str] | None = None, drop: list[str] | None = None, impute: bool = True, scale: bool = False) -> DataFrame:
    """Columns dropped, mapped, cast, filled, scaled and one-hot encoded; constant ones go, the rest are floats."""
    df = df.drop(*(drop or []))
    df = ordinal(df, ordinal_maps or {}, impute)
    kinds = dict(df.dtypes)
    numbers = [c for c in df.columns if c != key and (c in (continuous or []) or kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or kinds[c].startswith("decimal"))]
    texts = [c for c in df.columns if c != key and c not in numbers]
    out = one_hot(numeric(df, numbers, impute, scale) if numbers else df, texts)
    spread = out.agg(*[F.stddev_pop(c).alias(c) for c in out.columns if c != key]).head().asDict()
    return out.select(key, *[F.col(f"`{c}`").cast("float").alias(c) for c, v in spread.items() if v])
