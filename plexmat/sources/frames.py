"""Readers and writers: named data sets, matrices in long form, edge lists, folds; and the views over the driver's tables.

A matrix is long: (sample_id string, fpos int, feature string, value double), a missing cell being a null value.
A network is an edge list (src string, dst string, weight double) with a node table (node, npos, modality).
NaN becomes null on the way in, because SQL aggregates skip null but not NaN.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_wide(wide: DataFrame, sample: str) -> DataFrame:
    """A wide frame (one column for each feature) in long form; columns that aren't numbers are left out."""
    numeric = [f.name for f in wide.schema.fields if f.name != sample and f.dataType.typeName() in {"double", "float", "integer", "long", "short", "byte", "decimal"}]
    cells = F.array(*[F.struct(F.lit(i).alias("fpos"), F.lit(c).alias("feature"), F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias("value")) for i, c in enumerate(numeric)])
    return wide.select(F.col(sample).cast("string").alias("sample_id"), F.inline(cells))


def from_arrays(rows: DataFrame, sample: str, values: str) -> DataFrame:
    """A frame with an array column in long form; features are named by place."""
    cells = rows.select(F.col(sample).cast("string").alias("sample_id"), F.posexplode(values).alias("fpos", "value"))
    return cells.select("sample_id", "fpos", F.concat(F.lit("f"), F.lpad(F.col("fpos").cast("string"), 3, "0")).alias("feature"), F.nanvl(F.col("value").cast("double"), F.lit(None)).alias("value"))


def to_wide(long: DataFrame, features: list[str]) -> DataFrame:
    """The long form with a column for each of a (small) list of features."""
    return long.groupBy("sample_id").pivot("feature", features).agg(F.first("value"))


def row_vectors(long: DataFrame) -> DataFrame:
    """(sample_id, x array<double>) in order of fpos, for linear algebra; missing cells stay null."""
    cells = F.sort_array(F.collect_list(F.struct("fpos", "value")))
    return long.groupBy("sample_id").agg(F.transform(cells, lambda c: c["value"]).alias("x"))


def adjacency_edges(matrix: DataFrame, node: str) -> DataFrame:
    """A square adjacency frame as edges; zeros and nulls are no edges."""
    return from_wide(matrix, node).select(F.col("sample_id").alias("src"), F.col("feature").alias("dst"), F.col("value").alias("weight")).where("weight <> 0")


def edges_adjacency(edges: DataFrame, nodes: list[str]) -> DataFrame:
    """Edges as a square frame over a (small) list of nodes."""
    wide = edges.where(F.col("dst").isin(nodes)).groupBy("src").pivot("dst", nodes).agg(F.first("weight"))
    return wide.na.fill(0.0)


def read_csv(spark: SparkSession, path: str, index: bool = True) -> DataFrame:
    """A CSV with a header; the first column is the sample id, or rows get ids in file order."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    if index:
        return raw.withColumnRenamed(raw.columns[0], "sample_id").withColumn("sample_id", F.col("sample_id").cast("string"))
    # a row's id tells its partition (upper bits) and its place there; the partitions before it are few numbers
    own = raw.withColumn("_row", F.monotonically_increasing_id())
    part = F.shiftright("_row", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    place = F.col("_base") + F.col("_row") - F.shiftleft(F.col("_part"), 33)
    return own.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn("sample_id", place.cast("string")).drop("_row", "_part", "_base")


def write_matrix_csv(long: DataFrame, path: str) -> None:
    """A matrix as CSV files with a header, the sample id first, its features in order."""
    names = [r["feature"] for r in long.select("fpos", "feature").distinct().orderBy("fpos").collect()]  # the header
    to_wide(long, names).write.option("header", True).csv(path)


def write_folds(base: str, matrices: list[DataFrame], folds: DataFrame) -> None:
    """Folds (sample_id, y, fold) of some matrices in the layout that read_folds reads; fold 0 is folder fold_1.

    A sample is in the test tables of its fold and in the training tables of all others. layout says how many there are.
    """
    spark = folds.sparkSession
    own = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    key = folds.select("sample_id", "y", "fold")
    for k in own:
        test = F.col("fold") == k
        for side, rows in (("train", key.where(~test)), ("test", key.where(test))):
            for j, m in enumerate(matrices, 1):
                write_matrix_csv(m.join(rows.select("sample_id"), "sample_id", "left_semi"), f"{base}/fold_{k + 1}/X_{side}_Omics_{j}.csv")
            rows.select("sample_id", "y").write.option("header", True).csv(f"{base}/fold_{k + 1}/Y_{side}.csv")
    spark.createDataFrame([(len(own), len(matrices))], "folds int, modalities int").write.json(f"{base}/layout")


def read_frames(spark: SparkSession, folder: str, schemas: dict[str, str], kind: str = "parquet") -> dict[str, DataFrame]:
    """What write_frames wrote, each frame by its schema, so that no file is read to find one out."""
    return {name: getattr(spark.read.schema(schema).option("header", True), kind)(f"{folder}/{name}") for name, schema in schemas.items()}


def read_folds(spark: SparkSession, base: str, modalities: int, folds: int = 5) -> dict[str, DataFrame]:
    """Exported folds (base/fold_i/X_train_Omics_j.csv ...) as one frame for each table, with a fold column."""
    names = [f"{side}_{part}" for side in ("X_train", "X_test") for part in (f"Omics_{j}" for j in range(1, modalities + 1))] + ["Y_train", "Y_test"]
    fold = F.regexp_extract(F.col("_metadata.file_path"), r"fold_(\d+)/", 1).cast("int")
    return {n: spark.read.csv([f"{base}/fold_{k}/{n}.csv" for k in range(1, folds + 1)], header=True, inferSchema=True).withColumn("fold", fold) for n in names}


class Bundle:
    """A named set of lazy frames with item access and shapes."""

    def __init__(self, name: str, tables: dict[str, DataFrame]):
        self.name, self.tables = name, tables

    def __getitem__(self, key: str) -> DataFrame:
        return self.tables[key]

    @property
    def shape(self) -> dict[str, tuple[int, int]]:
        return {k: (t.count(), len(t.columns)) for k, t in self.tables.items()}


#: Data sets by name; a loader takes (spark, folder).
LOADERS: dict[str, Callable[[SparkSession, str], dict[str, DataFrame]]] = {}


def load(spark: SparkSession, name: str, folder: str) -> Bundle:
    """A data set by name, whatever its case; an unknown name is an error."""
    key = name.strip().lower()
    if key not in LOADERS:
        raise FileNotFoundError(f"no data set named {key!r}; there are {sorted(LOADERS)}")
    return Bundle(key, LOADERS[key](spark, folder))


def write_frames(frames: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Writes each frame to its own folder, as Parquet, CSV or JSON."""
    for name, df in frames.items():
        getattr(df.write.option("header", True), kind)(f"{folder}/{name}")


# ---- views over the driver's tables ---------------------------------------------------------------


def emb(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as a matrix: sample = vec_id, 64 features."""
    return from_arrays(table(spark, d, "embeddings"), "vec_id", "embedding")


def emb_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), F.col("label").cast("double").alias("y"))


def evt(spark: SparkSession, d: str) -> DataFrame:
    """Events summed to user by day; days without events are missing cells."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("sample_id"), F.to_date("ts").alias("day"), "value")
    span = e.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    grid = e.select("sample_id").distinct().join(F.broadcast(span)).select("sample_id", F.posexplode(F.sequence("lo", "hi")).alias("fpos", "day"))
    sums = e.groupBy("sample_id", "day").agg(F.sum("value").alias("value"))
    return grid.join(sums, ["sample_id", "day"], "left").select("sample_id", "fpos", F.date_format("day", "yyyyMMdd").alias("feature"), "value")


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Supplier nation to customer nation: the share of the supplier nation's revenue, as edges."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("cn"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("sn"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    by = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey).groupBy("sn", "cn").agg(F.sum("rev").alias("rev"))
    total = F.sum("rev").over(Window.partitionBy("sn"))
    named = by.withColumn("weight", F.col("rev") / total).join(n.select(F.col("n_nationkey").alias("sn"), F.col("n_name").alias("src")), "sn").join(n.select(F.col("n_nationkey").alias("cn"), F.col("n_name").alias("dst")), "cn")
    return named.select("src", "dst", "weight")


def nations(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of the trade network: their place, and their region as modality."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("node"), F.col("n_nationkey").alias("npos"), F.col("r_name").alias("modality"))


def clinical(spark: SparkSession, d: str) -> DataFrame:
    """Customers as patients: a nominal segment, a balance, a nation code, and the priority of the latest order (ordinal)."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    latest = o.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("priority"))
    return c.join(latest, c.c_custkey == latest.o_custkey, "left").select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"), "priority")


LOADERS |= {
    "embeddings": lambda s, d: {"matrix": emb(s, d), "target": emb_label(s, d)},
    "events": lambda s, d: {"matrix": evt(s, d)},
    "trade": lambda s, d: {"edges": trade(s, d), "nodes": nations(s, d)},
    "clinical": lambda s, d: {"clinical": clinical(s, d)},
}


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)
