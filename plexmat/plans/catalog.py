"""Registered queries over the driver's tables, each with its DuckDB text where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexmat.functions import special
from plexmat.operators import align, analyze, cca, clean, clinical, community, glm, learn, louvain, phenotype, profile, select, similarity
from plexmat.plans import iterate
from plexmat.sources import frames
from plexmat.sources.frames import rounded
from plexmat.streaming import profile as stream_profile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Named parts of the DuckDB texts: the views of plexmat.sources.frames, and what many queries start from.
PARTS = {
    "x": "SELECT vec_id::VARCHAR AS sample_id, generate_subscripts(embedding, 1) - 1 AS fpos, 'f' || lpad((generate_subscripts(embedding, 1) - 1)::VARCHAR, 3, '0') AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings",
    "y": "SELECT vec_id::VARCHAR AS sample_id, label::DOUBLE AS y FROM embeddings",
    "e0": "SELECT user_id::VARCHAR AS sample_id, ts::DATE AS day, value FROM events",
    "ev": "SELECT g.sample_id, g.fpos, strftime(g.day, '%Y%m%d') AS feature, s.value FROM (SELECT u.sample_id, i AS fpos, (SELECT min(day) FROM e0) + i::INTEGER AS day FROM (SELECT DISTINCT sample_id FROM e0) u, range((SELECT max(day) - min(day) + 1 FROM e0)) r(i)) g LEFT JOIN (SELECT sample_id, day, sum(value) AS value FROM e0 GROUP BY 1, 2) s ON s.sample_id = g.sample_id AND s.day = g.day::DATE",
    "nodes": "SELECT n_name AS node, n_nationkey AS npos, r_name AS modality FROM nation JOIN region ON n_regionkey = r_regionkey",
    "tr": "SELECT a.n_name AS src, b.n_name AS dst, rev / sum(rev) OVER (PARTITION BY sn) AS weight FROM (SELECT s_nationkey AS sn, c_nationkey AS cn, sum(l_extendedprice * (1 - l_discount)) AS rev FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) t JOIN nation a ON sn = a.n_nationkey JOIN nation b ON cn = b.n_nationkey",
    "clin": "SELECT c_custkey::VARCHAR AS sample_id, c_mktsegment AS segment, c_acctbal AS balance, c_nationkey AS nation, priority FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority FROM orders GROUP BY 1) o ON o_custkey = c_custkey",
    "xc": "SELECT *, value - avg(value) OVER (PARTITION BY feature) AS c FROM x",
    "g": "SELECT a.feature AS src, b.feature AS dst, a.fpos AS src_pos, b.fpos AS dst_pos, sum(a.c * b.c) AS p FROM xc a JOIN xc b USING (sample_id) GROUP BY 1, 2, 3, 4",
    "pear": "SELECT g.src, g.dst, g.src_pos, g.dst_pos, g.p / greatest(sqrt(d.p * e.p), 1e-8) AS s FROM g JOIN g d ON d.src = g.src AND d.dst = g.src JOIN g e ON e.src = g.dst AND e.dst = g.dst WHERE g.src <> g.dst",
    "xd": "SELECT a.feature AS src, b.feature AS dst, a.fpos AS src_pos, b.fpos AS dst_pos, sum(a.value * b.value) AS p FROM x a JOIN x b USING (sample_id) GROUP BY 1, 2, 3, 4",
    "cosi": "SELECT g.src, g.dst, g.src_pos, g.dst_pos, g.p / greatest(sqrt(d.p * e.p), 1e-8) AS s FROM xd g JOIN xd d ON d.src = g.src AND d.dst = g.src JOIN xd e ON e.src = g.dst AND e.dst = g.dst WHERE g.src <> g.dst",
    "dist": "SELECT g.src, g.dst, g.src_pos, g.dst_pos, greatest(d.p + e.p - 2 * g.p, 0) AS s FROM xd g JOIN xd d ON d.src = g.src AND d.dst = g.src JOIN xd e ON e.src = g.dst AND e.dst = g.dst WHERE g.src <> g.dst",
    "med": "SELECT quantile_disc(s, 0.5) AS m FROM (SELECT s FROM dist UNION ALL SELECT DISTINCT ON (feature) 0.0 FROM x)",
}
_NEEDS = {"ev": ["e0"], "xc": ["x"], "g": ["xc"], "pear": ["g"], "xd": ["x"], "cosi": ["xd"], "dist": ["xd"], "med": ["dist"]}
SUMMARY = "avg(v) AS mean, median(v) AS median, min(v) AS min, max(v) AS max, stddev_samp(v) AS std"


def sql(body: str, *parts: str) -> str:
    """body with the parts it names, and what those need, as common tables."""
    found: dict[str, str] = {}

    def add(p: str) -> None:
        for q in _NEEDS.get(p, []):
            add(q)
        found.setdefault(p, PARTS[p])

    for p in parts:
        add(p)
    head = ", ".join(f"{n} AS ({t})" for n, t in found.items())
    return (f"WITH {head} " if head else "") + body.replace("{R(", "(round(").replace(")R}", ", 6) + 0.0)")


def query(name: str, oracle: str | None = None, *parts: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = sql(oracle, *parts)
        return f

    return add


def tidy(df: DataFrame, *doubles: str) -> DataFrame:
    """df with its double columns rounded for comparison."""
    own = set(doubles) or {c for c, t in df.dtypes if t == "double"}
    return df.select(*[rounded(F.col(c)).alias(c) if c in own else F.col(c) for c in df.columns])


R = "{R("
_SUM = "SELECT {R(avg(v))R} AS mean, {R(median(v))R} AS median, {R(min(v))R} AS min, {R(max(v))R} AS max, {R(stddev_samp(v))R} AS std"

# ---- profiling ------------------------------------------------------------------------------------


@query("profile_variance", _SUM + ", count(*) FILTER (v < 0.0001) AS n_low FROM (SELECT var_samp(value) AS v FROM x GROUP BY feature)", "x")
def _(s, d):
    return tidy(profile.variance_summary(frames.emb(s, d), 1e-4))


@query("profile_zero", _SUM + ", count(*) FILTER (v > 0.5) AS n_high FROM (SELECT count(*) FILTER (value = 0) / count(*) AS v FROM ev GROUP BY feature)", "ev")
def _(s, d):
    return tidy(profile.zero_summary(frames.evt(s, d), 0.5))


@query("profile_expression", _SUM + " FROM (SELECT avg(value) AS v FROM x GROUP BY feature)", "x")
def _(s, d):
    return tidy(profile.expression_summary(frames.emb(s, d)))


@query("profile_correlation", _SUM + " FROM (SELECT max(abs(s)) AS v FROM pear GROUP BY src)", "pear")
def _(s, d):
    return tidy(profile.correlation_summary(frames.emb(s, d)))


@query("profile_missing", "SELECT {R(100.0 * count(*) FILTER (value IS NULL) / count(*))R} AS pct FROM ev", "ev")
def _(s, d):
    return tidy(profile.missing(frames.evt(s, d))["global"])


@query("profile_missing_features", "SELECT feature, {R(100.0 * count(*) FILTER (value IS NULL) / count(*))R} AS pct FROM ev GROUP BY feature ORDER BY 100.0 * count(*) FILTER (value IS NULL) / count(*) DESC, feature LIMIT 5", "ev")
def _(s, d):
    return tidy(profile.missing(frames.evt(s, d))["features"])


@query("profile_missing_samples", "SELECT sample_id, {R(100.0 * count(*) FILTER (value IS NULL) / count(*))R} AS pct FROM ev GROUP BY sample_id ORDER BY 100.0 * count(*) FILTER (value IS NULL) / count(*) DESC, sample_id LIMIT 5", "ev")
def _(s, d):
    return tidy(profile.missing(frames.evt(s, d))["samples"])


@query("profile_missing_above", "SELECT (SELECT count(*) FROM (SELECT feature FROM ev GROUP BY 1 HAVING 100.0 * count(*) FILTER (value IS NULL) / count(*) > 20)) AS n_features, (SELECT count(*) FROM (SELECT sample_id FROM ev GROUP BY 1 HAVING 100.0 * count(*) FILTER (value IS NULL) / count(*) > 20)) AS n_samples", "ev")
def _(s, d):
    return profile.missing(frames.evt(s, d))["above"]


@query("profile_report")
def _(s, d):
    return tidy(profile.report(frames.emb(s, d), correlation=True))


# ---- cleaning -------------------------------------------------------------------------------------

_CELL = "SELECT sample_id, feature, {R(%s)R} AS value FROM %s"


def cells(long: DataFrame) -> DataFrame:
    return tidy(long.select("sample_id", "feature", "value"))


@query("beta_to_m", _CELL % ("log2(b / (1 - b))", "(SELECT *, CASE WHEN value IS NOT NULL THEN least(greatest(value, 1e-6), 1 - 1e-6) END AS b FROM x)"), "x")
def _(s, d):
    return cells(clean.beta_to_m(frames.emb(s, d)))


for _m, _f in (("mean", "avg(value)"), ("median", "median(value)")):
    query(f"impute_{_m}", _CELL % ("coalesce(value, fill)", f"ev JOIN (SELECT feature, {_f} AS fill FROM ev GROUP BY 1) USING (feature)"), "ev")(lambda s, d, m=_m: cells(clean.impute_simple(frames.evt(s, d), m)))
query("impute_zero", _CELL % ("coalesce(value, 0)", "ev"), "ev")(lambda s, d: cells(clean.impute_simple(frames.evt(s, d), "zero")))


@query(
    "impute_knn",
    "SELECT sample_id, feature, {R(coalesce(value, knn, mean))R} AS value FROM ev LEFT JOIN (SELECT sample_id, feature, avg(given) AS knn FROM (SELECT m.sample_id, m.feature, h.value AS given, row_number() OVER (PARTITION BY m.sample_id, m.feature ORDER BY round(q.dist, 9), q.donor) AS r FROM ev m JOIN (SELECT a.sample_id, b.sample_id AS donor, sqrt((SELECT count(DISTINCT feature) FROM ev)::DOUBLE / count(*) * sum((a.value - b.value) ** 2)) AS dist FROM ev a JOIN ev b ON a.feature = b.feature AND a.sample_id <> b.sample_id WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2) q ON q.sample_id = m.sample_id JOIN ev h ON h.sample_id = q.donor AND h.feature = m.feature AND h.value IS NOT NULL WHERE m.value IS NULL) WHERE r <= 5 GROUP BY 1, 2) k USING (sample_id, feature) JOIN (SELECT feature, avg(value) AS mean FROM ev GROUP BY 1) USING (feature)",
    "ev",
)
def _(s, d):
    return cells(clean.impute_knn(frames.evt(s, d), 5))


@query("normalize_standard", _CELL % ("(value - a) / coalesce(nullif(b, 0), 1)", "x JOIN (SELECT feature, avg(value) AS a, stddev_pop(value) AS b FROM x GROUP BY 1) USING (feature)"), "x")
def _(s, d):
    return cells(clean.normalize(frames.emb(s, d), "standard"))


@query("normalize_minmax", _CELL % ("(value - a) / coalesce(nullif(b, 0), 1)", "x JOIN (SELECT feature, min(value) AS a, max(value) - min(value) AS b FROM x GROUP BY 1) USING (feature)"), "x")
def _(s, d):
    return cells(clean.normalize(frames.emb(s, d), "minmax"))


@query("normalize_log2", _CELL % ("log2(abs(value) + 1)", "ev"), "ev")
def _(s, d):
    return cells(clean.normalize(frames.evt(s, d).withColumn("value", F.abs("value")), "log2"))


@query("scale_sample", _CELL % ("(value - a) / coalesce(nullif(b, 0), 1)", "x JOIN (SELECT feature, avg(value) AS a, stddev_samp(value) AS b FROM x GROUP BY 1) USING (feature)"), "x")
def _(s, d):
    return cells(clean.scale_sample(frames.emb(s, d)))


@query("clean_inf", _CELL % ("coalesce(value, m)", "ev JOIN (SELECT feature, median(value) AS m FROM ev GROUP BY 1) USING (feature) WHERE feature IN (SELECT feature FROM (SELECT feature, coalesce(value, m) AS v FROM ev JOIN (SELECT feature, median(value) AS m FROM ev GROUP BY 1) USING (feature)) GROUP BY 1 HAVING stddev_pop(v) > 0)"), "ev")
def _(s, d):
    return cells(clean.clean_inf(frames.evt(s, d)))


@query("clean_internal", _CELL % ("coalesce(value, m)", "ev JOIN (SELECT feature, median(value) AS m FROM ev GROUP BY 1 HAVING count(*) FILTER (value IS NULL) / count(*) <= 0.1 AND stddev_pop(value) > 0) USING (feature)"), "ev")
def _(s, d):
    return cells(clean.clean_internal(frames.evt(s, d), 0.1))


@query("sparse_filter", "SELECT sample_id, feature, {R(value)R} AS value FROM k WHERE sample_id IN (SELECT sample_id FROM k GROUP BY 1 HAVING count(value) >= floor(count(*) * 0.9))".replace("FROM k ", "FROM (SELECT * FROM ev WHERE feature IN (SELECT feature FROM ev GROUP BY 1 HAVING count(value) >= floor(count(*) * 0.9))) k "), "ev")
def _(s, d):
    return cells(clean.sparse_filter(frames.evt(s, d), 0.1))


@query("variation_filter", _CELL % ("value", "x WHERE feature IN (SELECT feature FROM c WHERE cv > (SELECT quantile_cont(cv, 0.5) FROM c))".replace("FROM c)", "FROM (SELECT feature, abs(stddev_samp(value) / CASE WHEN avg(value) = 0 THEN 1 ELSE avg(value) END) AS cv FROM x GROUP BY 1) c2)").replace("FROM c WHERE", "FROM (SELECT feature, abs(stddev_samp(value) / CASE WHEN avg(value) = 0 THEN 1 ELSE avg(value) END) AS cv FROM x GROUP BY 1) c WHERE")), "x")
def _(s, d):
    return cells(clean.variation_filter(frames.emb(s, d)))


@query("regress_out", _CELL % ("value - (i + b * y)", "x JOIN y USING (sample_id) JOIN (SELECT feature, regr_slope(value, y) AS b, regr_intercept(value, y) AS i FROM x JOIN y USING (sample_id) GROUP BY 1) USING (feature)"), "x", "y")
def _(s, d):
    return cells(clean.regress_out(frames.emb(s, d), frames.emb_label(s, d), ["y"]))


@query("clean_names", "SELECT DISTINCT CASE WHEN regexp_matches(n, '^[A-Za-z]') THEN n ELSE 'X' || n END AS name FROM (SELECT regexp_replace(p_name, '[^0-9A-Za-z_]', '.', 'g') AS n FROM part)")
def _(s, d):
    return clean.clean_names(frames.table(s, d, "part").select(F.col("p_name").alias("name")), "name").distinct()


@query("average_samples", "SELECT substr(sample_id, 1, 1) AS sample_id, feature, {R(avg(value))R} AS value FROM x GROUP BY 1, 2", "x")
def _(s, d):
    return cells(clean.average_samples(frames.emb(s, d), 1))


@query("binarize", "SELECT sample_id, (y > (SELECT median(y) FROM y))::INTEGER AS label FROM y", "y")
def _(s, d):
    return clean.binarize(frames.emb_label(s, d), "y", "label").select("sample_id", "label")


# ---- clinical tables ------------------------------------------------------------------------------


@query("clinical_ordinal", "SELECT sample_id, {R(coalesce(p, (SELECT median(p) FROM o)))R} AS priority FROM o".replace("FROM o)", "FROM (SELECT %s AS p FROM clin))").replace("FROM o", "FROM (SELECT sample_id, %s AS p FROM clin)") % (("CASE lower(trim(priority)) WHEN '1-urgent' THEN 1::DOUBLE WHEN '2-high' THEN 2 WHEN '3-medium' THEN 3 WHEN '4-not specified' THEN 4 END",) * 2), "clin")
def _(s, d):
    return tidy(clinical.ordinal(frames.clinical(s, d), {"priority": {"1-urgent": 1, "2-high": 2, "3-medium": 3, "4-not specified": 4}}, impute=True).select("sample_id", "priority"))


@query("clinical_robust_scale", "SELECT sample_id, {R((balance - m) / coalesce(nullif(b - a, 0), 1))R} AS balance FROM clin, (SELECT median(balance) AS m, quantile_cont(balance, 0.25) AS a, quantile_cont(balance, 0.75) AS b FROM clin)", "clin")
def _(s, d):
    return tidy(clinical.numeric(frames.clinical(s, d), ["balance"], scale=True).select("sample_id", "balance"))


@query("clinical_one_hot", "SELECT sample_id, " + ", ".join(f"(CASE WHEN lower(trim(segment)) = '{x}' THEN 1 ELSE 0 END) AS \"segment_{x}\"" for x in ("building", "furniture", "household", "machinery")) + ", (CASE WHEN segment IS NULL THEN 1 ELSE 0 END) AS segment_nan FROM clin", "clin")
def _(s, d):
    return clinical.one_hot(frames.clinical(s, d).select("sample_id", "segment"), ["segment"])


@query("clinical_assemble")
def _(s, d):
    return clinical.preprocess(frames.clinical(s, d), ordinal_maps={"priority": {"1-urgent": 1, "2-high": 2, "3-medium": 3, "4-not specified": 4}}, continuous=["balance"], drop=["absent"], scale=True)


# ---- similarity and networks ----------------------------------------------------------------------

_PAIR = "SELECT src, dst, {R(%s)R} AS s FROM %s"


def pairs(df: DataFrame, name: str = "s") -> DataFrame:
    return tidy(df.select("src", "dst", name))


query("pearson_matrix", _PAIR % ("s", "pear"), "pear")(lambda s, d: pairs(similarity.pearson(frames.emb(s, d))))
query("cosine_matrix", _PAIR % ("s", "cosi"), "cosi")(lambda s, d: pairs(similarity.cosine(frames.emb(s, d))))
query("signed_map", _PAIR % ("(s + 1) / 2", "pear"), "pear")(lambda s, d: pairs(similarity.signed(similarity.pearson(frames.emb(s, d)))))
query("soft_threshold_matrix", _PAIR % ("pow(abs(s), 6)", "pear"), "pear")(lambda s, d: pairs(similarity.soft_threshold(similarity.pearson(frames.emb(s, d)))))
query("gaussian_matrix", _PAIR % ("exp(-s / (m + 1e-8))", "dist, med"), "med")(lambda s, d: pairs(similarity.gaussian(frames.emb(s, d), eps=1e-8, factor=1.0)))
query("rbf_matrix", _PAIR % ("exp(-s / (2 * m))", "dist, med"), "med")(lambda s, d: pairs(similarity.gaussian(frames.emb(s, d))))
PARTS |= {
    "xr": "SELECT sample_id, fpos, feature, rk - avg(rk) OVER (PARTITION BY feature) AS c FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value, sample_id)::DOUBLE AS rk FROM x)",
    "gr": PARTS["g"].replace("xc", "xr"),
    "spear": PARTS["pear"].replace("FROM g JOIN g d", "FROM gr g JOIN gr d").replace("JOIN g e", "JOIN gr e"),
}
_NEEDS |= {"xr": ["x"], "gr": ["xr"], "spear": ["gr"]}
query("spearman_matrix", _PAIR % ("s", "spear"), "spear")(lambda s, d: pairs(similarity.spearman(frames.emb(s, d))))

_KNN = "(SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s, 9) DESC, dst_pos) AS r FROM %s) WHERE r <= %d"
_NORM = "SELECT src, dst, {R(s / sum(abs(s)) OVER (PARTITION BY src))R} AS weight FROM (%s)"
_LOOPS = " UNION ALL SELECT DISTINCT feature, feature, 1.0 FROM x"
_COS_KNN = f"SELECT src, dst, s FROM {_KNN % ('cosi', 15)}"
_COR = "(SELECT src, dst, src_pos, dst_pos, (s + 1) / 2 AS s FROM pear)"
_MUTUAL = "SELECT a.src, a.dst, a.s FROM ({0}) a JOIN ({0}) b ON a.src = b.dst AND a.dst = b.src"


def net(df: DataFrame) -> DataFrame:
    return tidy(df.select("src", "dst", "weight"))


query("similarity_network", _NORM % _COS_KNN, "cosi")(lambda s, d: net(similarity.similarity_network(frames.emb(s, d))))
query("similarity_network_mutual", _NORM % _MUTUAL.format(_COS_KNN), "cosi")(lambda s, d: net(similarity.similarity_network(frames.emb(s, d), mutual_only=True)))
query("similarity_network_gaussian", _NORM % f"SELECT src, dst, s FROM {_KNN % ('(SELECT src, dst, src_pos, dst_pos, exp(-s / (m + 1e-8)) AS s FROM dist, med)', 15)}", "med")(lambda s, d: net(similarity.similarity_network(frames.emb(s, d), metric="gaussian")))
query("similarity_network_global", "SELECT src, dst, {R(s)R} AS weight FROM cosi WHERE s >= (SELECT s FROM cosi ORDER BY s DESC LIMIT 1 OFFSET 15 * 64)", "cosi")(lambda s, d: net(similarity.similarity_network(frames.emb(s, d), per_node=False, normalize=False)))
query("similarity_network_compat", "SELECT src, dst, {R(s)R} AS weight FROM cosi WHERE s >= (SELECT s FROM (SELECT s FROM cosi UNION ALL SELECT DISTINCT ON (feature) 1.0 FROM x) ORDER BY s LIMIT 1 OFFSET 15 * 64 - 1)", "cosi")(lambda s, d: net(similarity.similarity_network(frames.emb(s, d), per_node=False, normalize=False, compat=True)))
query("correlation_network", _NORM % f"SELECT src, dst, s FROM {_KNN % (_COR, 15)}", "pear")(lambda s, d: net(similarity.correlation_network(frames.emb(s, d))))
query("correlation_network_unsigned_loops", _NORM % (f"SELECT src, dst, s FROM {_KNN % ('(SELECT src, dst, src_pos, dst_pos, abs(s) AS s FROM pear)', 10)}" + _LOOPS), "pear")(lambda s, d: net(similarity.correlation_network(frames.emb(s, d), k=10, signed_map=False, self_loops=True)))
query("correlation_network_spearman", _NORM % f"SELECT src, dst, s FROM {_KNN % ('(SELECT src, dst, src_pos, dst_pos, (s + 1) / 2 AS s FROM spear)', 15)}", "spear")(lambda s, d: net(similarity.correlation_network(frames.emb(s, d), method="spearman")))
query("correlation_network_threshold", "SELECT src, dst, {R((s + 1) / 2)R} AS weight FROM pear WHERE (s + 1) / 2 >= 0.53", "pear")(lambda s, d: net(similarity.correlation_network(frames.emb(s, d), k=None, per_node=False, threshold=0.53, normalize=False)))
query("correlation_network_full", _NORM % f"SELECT src, dst, s FROM {_COR}", "pear")(lambda s, d: net(similarity.correlation_network(frames.emb(s, d), k=None)))
query("threshold_network", _NORM % f"SELECT src, dst, s FROM {_KNN % ('(SELECT src, dst, src_pos, dst_pos, pow(abs(s), 2) AS s FROM pear)', 15)}", "pear")(lambda s, d: net(similarity.threshold_network(frames.emb(s, d), b=2.0)))
query("gaussian_knn_network", _NORM % (f"SELECT src, dst, s FROM {_KNN % ('(SELECT src, dst, src_pos, dst_pos, exp(-s / (2 * m)) AS s FROM dist, med)', 15)}" + _LOOPS), "med")(lambda s, d: net(similarity.gaussian_knn_network(frames.emb(s, d))))

# ---- pruning and analytics over the trade network -------------------------------------------------

T = 0.04
query("prune_network", "SELECT src, dst, {R(weight)R} AS weight FROM tr WHERE weight >= 0.04", "tr")(lambda s, d: net(clean.prune(frames.trade(s, d), T)))
_LOWER = "(SELECT least(i, j) AS i, greatest(i, j) AS j, arg_max(weight, (i > j)::INTEGER) AS weight FROM (SELECT a.npos AS i, b.npos AS j, weight FROM tr JOIN nodes a ON src = a.node JOIN nodes b ON dst = b.node) GROUP BY 1, 2)"
query("undirected_network", f"SELECT a.node AS src, b.node AS dst, {R}weight)R}} AS weight FROM {_LOWER} u JOIN nodes a ON u.i = a.npos JOIN nodes b ON u.j = b.npos", "tr", "nodes")(lambda s, d: net(clean.undirected(frames.trade(s, d), "lower", frames.nations(s, d))))
query("prune_network_quantile", f"SELECT a.node AS src, b.node AS dst, {R}weight)R}} AS weight FROM {_LOWER} u JOIN nodes a ON u.i = a.npos JOIN nodes b ON u.j = b.npos WHERE weight >= (SELECT quantile_cont(weight, 0.5) FROM {_LOWER})", "tr", "nodes")(lambda s, d: net(clean.prune_quantile(clean.undirected(frames.trade(s, d), "lower", frames.nations(s, d)), 0.5)))
_KEPT = "SELECT src, dst, {R(weight)R} AS weight FROM (SELECT * FROM tr WHERE weight > 0.04) e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)"
_COLS = "(SELECT node, (coalesce(q, 0) - coalesce(s, 0) ** 2 / 25) / 24 AS variance, 1 - coalesce(c, 0) / 25 AS zeros FROM nodes LEFT JOIN (SELECT dst, sum(weight) AS s, sum(weight ** 2) AS q, count(*) AS c FROM tr WHERE weight > 0.04 GROUP BY 1) ON dst = node)"
query("drop_low_variance_nodes", _KEPT.replace("FROM k", f"FROM {_COLS} WHERE variance > 0.0004"), "tr", "nodes")(lambda s, d: net(clean.drop_low_variance(frames.trade(s, d).where("weight > 0.04"), frames.nations(s, d), 0.0004)))
query("drop_high_zero_nodes", _KEPT.replace("FROM k", f"FROM {_COLS} WHERE zeros < 0.6"), "tr", "nodes")(lambda s, d: net(clean.drop_high_zero(frames.trade(s, d).where("weight > 0.04"), frames.nations(s, d), 0.6)))

PARTS |= {
    "hi": "SELECT src, dst FROM tr WHERE weight > 0.04",
    "dg": "SELECT node, npos, modality, coalesce(k, 0) AS degree FROM nodes LEFT JOIN (SELECT src, count(*) AS k FROM hi GROUP BY 1) ON src = node",
}
_NEEDS |= {"hi": ["tr"], "dg": ["nodes", "hi"]}


def _trade(f: Callable) -> Callable:
    return lambda s, d: tidy(f(frames.trade(s, d), frames.nations(s, d)))


query("net_basic", "SELECT count(*) AS nodes, {R(sum(degree) / 2)R} AS edges, {R(sum(degree) / 2 / (count(*) * (count(*) - 1) / 2))R} AS density, {R(avg(degree))R} AS avg_degree, max(degree) AS max_degree, count(*) FILTER (degree = 0) AS isolated FROM dg", "dg")(_trade(lambda e, n: analyze.basic(e, n, T)))
query("net_degrees", "SELECT degree, count(*) AS n, {R(100.0 * count(*) / sum(count(*)) OVER ())R} AS pct FROM dg GROUP BY degree", "dg")(_trade(lambda e, n: analyze.degree_distribution(e, n, T)))
query("net_trade_hubs", "SELECT row_number() OVER (ORDER BY degree DESC, npos) AS rank, node, modality, degree FROM dg ORDER BY degree DESC, npos LIMIT 10", "dg")(_trade(lambda e, n: analyze.hubs(e, n, T)))
query("net_clustering", "SELECT node, {R(CASE WHEN k >= 2 THEN coalesce(links, 0) / (k * (k - 1)) ELSE 0 END)R} AS coefficient FROM (SELECT node, coalesce(k, 0) AS k FROM nodes LEFT JOIN (SELECT src, count(*) AS k FROM hi WHERE src <> dst GROUP BY 1) ON src = node) LEFT JOIN (SELECT a.src AS v, count(*) AS links FROM hi a JOIN hi b ON a.src = b.src AND a.dst <> b.dst JOIN hi c ON c.src = a.dst AND c.dst = b.dst WHERE a.src <> a.dst AND b.src <> b.dst AND c.src <> c.dst GROUP BY 1) ON v = node", "nodes", "hi")(_trade(lambda e, n: analyze.clustering(e, n, T)))
query("net_cross_modality", "SELECT m1, m2, {R(c)R} AS edges, {R(p)R} AS possible, {R(c / p)R} AS density FROM (SELECT a.modality AS m1, b.modality AS m2, (coalesce(n, 0) * CASE WHEN a.modality = b.modality THEN 0.5 ELSE 1 END)::DOUBLE AS c, CASE WHEN a.modality = b.modality THEN a.k * (a.k - 1) / 2 ELSE a.k * b.k END::DOUBLE AS p FROM (SELECT modality, count(*) AS k FROM nodes GROUP BY 1) a JOIN (SELECT modality, count(*) AS k FROM nodes GROUP BY 1) b ON a.modality <= b.modality LEFT JOIN (SELECT s.modality AS x1, t.modality AS x2, count(*) AS n FROM hi JOIN nodes s ON src = s.node JOIN nodes t ON dst = t.node GROUP BY 1, 2) ON x1 = a.modality AND x2 = b.modality)", "nodes", "hi")(_trade(lambda e, n: analyze.cross_modality(e, n, T)))
PARTS |= {"up": "SELECT src, dst, a.npos AS i, b.npos AS j, weight FROM tr JOIN nodes a ON src = a.node JOIN nodes b ON dst = b.node WHERE a.npos < b.npos"}
_NEEDS |= {"up": ["tr", "nodes"]}
_PCT = ", ".join(f"{R}quantile_cont(weight, {p / 100}))R}} AS p{p}" for p in (25, 50, 75, 90, 95, 99)) + ", " + ", ".join(f"count(*) FILTER (weight > {t}) AS above_{str(t).replace('.', '_')}" for t in (0.001, 0.1, 0.3, 0.5, 0.7, 0.8, 0.9))
query("net_edge_weights", f"SELECT count(*) AS n, {R}avg(weight))R}} AS mean, {R}stddev_pop(weight))R}} AS std, {R}median(weight))R}} AS median, {R}min(weight))R}} AS min, {R}max(weight))R}} AS max, {_PCT} FROM up WHERE weight > 0", "up")(_trade(analyze.edge_weights))
query("net_strongest_edges", "SELECT src, dst, {R(weight)R} AS weight FROM up ORDER BY round(weight, 9) DESC, i, j LIMIT 50", "up")(_trade(analyze.strongest_edges))
_CC = "WITH RECURSIVE {0}, two AS (SELECT a.npos AS a, b.npos AS b FROM (SELECT src, dst FROM tr WHERE weight > 0.05 UNION SELECT dst, src FROM tr WHERE weight > 0.05) JOIN nodes a ON src = a.node JOIN nodes b ON dst = b.node), reach AS (SELECT npos AS a, npos AS r FROM nodes UNION SELECT two.b, reach.r FROM reach JOIN two USING (a)), lab AS (SELECT a, min(r) AS label FROM reach GROUP BY 1)"
_CC = _CC.format(", ".join(f"{p} AS ({PARTS[p]})" for p in ("tr", "nodes")))
QUERIES["net_components"] = _trade(lambda e, n: analyze.components(e, n, 0.05))
ORACLES["net_components"] = _CC + " SELECT node, dense_rank() OVER (ORDER BY label) - 1 AS component FROM lab JOIN nodes ON a = npos"
QUERIES["net_topology_quality"] = _trade(lambda e, n: analyze.topology_quality(e, n, 0.05))
ORACLES["net_topology_quality"] = _CC + " SELECT round(0.5::DOUBLE * (SELECT count(DISTINCT src) FROM tr WHERE weight > 0.05) / 25 + 0.5::DOUBLE * max(k) / 25, 6) + 0.0 AS quality FROM (SELECT count(*) AS k FROM lab GROUP BY label)"
query("net_node_table", "SELECT row_number() OVER (ORDER BY k DESC, npos) AS index, nodes.node, modality, k AS degree FROM nodes JOIN (SELECT node, count(*) AS k FROM (SELECT unnest([a, b]) AS node FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM tr WHERE abs(weight) >= 0.05 AND src <> dst)) GROUP BY 1) u USING (node)", "tr", "nodes")(_trade(lambda e, n: analyze.node_table(e, n, 0.05)))
query("net_modality_by_name", "SELECT feature AS node, CASE WHEN fpos < 32 THEN 'low' ELSE 'Unknown' END AS modality FROM (SELECT DISTINCT feature, fpos FROM x)", "x")(
    lambda s, d: analyze.with_modality(similarity.features_of(frames.emb(s, d)).select(F.col("feature").alias("node"), "fpos"), similarity.features_of(frames.emb(s, d)).where("fpos < 32").select(F.col("feature").alias("node"), F.lit("low").alias("modality"))).select("node", "modality")
)
_LAP = "(SELECT src, dst, weight / sqrt(a.d * b.d) AS w FROM (SELECT src, dst, s AS weight FROM (%s)) e JOIN (SELECT src AS n, sum(s) AS d FROM (%s) GROUP BY 1) a ON a.n = src JOIN (SELECT src AS n, sum(s) AS d FROM (%s) GROUP BY 1) b ON b.n = dst)" % ((_COS_KNN,) * 3)
_FULLCOR = f"SELECT src, dst, s FROM {_COR}"
query("net_smoothing", "SELECT x.sample_id, x.feature, {R(value + coalesce(a, 0))R} AS value FROM x LEFT JOIN (SELECT sample_id, dst AS feature, sum(value * w) AS a FROM x JOIN %s ON feature = src GROUP BY 1, 2) USING (sample_id, feature)" % _LAP.replace(_COS_KNN, _FULLCOR), "pear")(
    lambda s, d: cells(analyze.smoothed(frames.emb(s, d), similarity.correlation_network(frames.emb(s, d), k=None, normalize=False)))
)
query("net_profile_correlation", "SELECT a.node AS src, b.node AS dst, {R(coalesce((25 * coalesce(p, 0) - coalesce(sa, 0) * coalesce(sb, 0)) / nullif(sqrt((25 * coalesce(qa, 0) - coalesce(sa, 0) ** 2) * (25 * coalesce(qb, 0) - coalesce(sb, 0) ** 2)), 0), 0))R} AS s FROM nodes a JOIN nodes b ON a.node <> b.node LEFT JOIN (SELECT dst AS d1, sum(weight) AS sa, sum(weight ** 2) AS qa FROM tr WHERE weight > 0.04 GROUP BY 1) ON d1 = a.node LEFT JOIN (SELECT dst AS d2, sum(weight) AS sb, sum(weight ** 2) AS qb FROM tr WHERE weight > 0.04 GROUP BY 1) ON d2 = b.node LEFT JOIN (SELECT t.dst AS d3, u.dst AS d4, sum(t.weight * u.weight) AS p FROM tr t JOIN tr u USING (src) WHERE t.weight > 0.04 AND u.weight > 0.04 GROUP BY 1, 2) ON d3 = a.node AND d4 = b.node", "tr", "nodes")(
    lambda s, d: pairs(similarity.profile_correlation(frames.trade(s, d).where("weight > 0.04"), frames.nations(s, d)))
)

PARTS |= {"ce": f"SELECT src, dst, src_pos, s / sum(abs(s)) OVER (PARTITION BY src) AS weight FROM (SELECT * FROM {_KNN % ('(SELECT src, dst, src_pos, dst_pos, abs(s) AS s FROM pear)', 15)})"}
_NEEDS |= {"ce": ["pear"]}


@query("net_hubs", "SELECT row_number() OVER (ORDER BY k DESC, fpos) AS rank, feature AS node, 'b' || (fpos // 16)::VARCHAR AS modality, k AS degree FROM (SELECT feature, fpos, coalesce(k, 0) AS k FROM (SELECT DISTINCT feature, fpos FROM x) LEFT JOIN (SELECT dst, count(*) AS k FROM ce GROUP BY 1) ON dst = feature) ORDER BY k DESC, fpos LIMIT 10", "ce")
def _(s, d):
    x = frames.emb(s, d)
    e = similarity.correlation_network(x, signed_map=False)
    nodes = similarity.features_of(x).select(F.col("feature").alias("node"), F.col("fpos").alias("npos"), F.concat(F.lit("b"), F.expr("(fpos div 16)").cast("string")).alias("modality"))
    return analyze.hubs(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), nodes, 0.0)


# ---- selection ------------------------------------------------------------------------------------

_TOP = "SELECT fpos, feature, {R(score)R} AS score FROM (%s) ORDER BY round(score, 9) DESC, fpos LIMIT %d"
_RY = "SELECT fpos, feature, n, ab / CASE WHEN aa * bb > 1e-24 THEN sqrt(aa * bb) END AS r FROM (SELECT fpos, feature, count(*) AS n, sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb FROM (SELECT fpos, feature, value - avg(value) OVER (PARTITION BY feature) AS a, y - avg(y) OVER (PARTITION BY feature) AS b FROM x JOIN y USING (sample_id)) GROUP BY 1, 2)"
PARTS |= {"ry": _RY}
_NEEDS |= {"ry": ["x", "y"]}
query("select_variance", _TOP % ("SELECT fpos, feature, var_pop(value) AS score FROM x GROUP BY 1, 2", 20), "x")(lambda s, d: tidy(select.variance_top(frames.emb(s, d), 20)))
query("select_mad", _TOP % ("SELECT fpos, feature, median(abs(value - m)) AS score FROM x JOIN (SELECT feature, median(value) AS m FROM x GROUP BY 1) USING (feature) GROUP BY 1, 2", 20), "x")(lambda s, d: tidy(select.mad_top(frames.emb(s, d), 20)))
query("select_correlation", _TOP % ("SELECT fpos, feature, coalesce(abs(r), 0) AS score FROM ry", 20), "ry")(lambda s, d: tidy(select.correlation_top(frames.emb(s, d), frames.emb_label(s, d), 20)))
query("select_correlation_unsupervised", _TOP % ("SELECT src_pos AS fpos, src AS feature, avg(abs(s)) AS score FROM pear GROUP BY 1, 2", 20), "pear")(lambda s, d: tidy(select.correlation_top(frames.emb(s, d), None, 20)))
query(
    "select_laplacian",
    "SELECT fpos, feature, {R(score)R} AS score FROM (SELECT fpos, feature, (den - num) / (den + 1e-8) AS score FROM (SELECT fpos, feature, sum(d * c * c) AS den FROM c GROUP BY 1, 2) JOIN (SELECT a.fpos, sum(a.c * b.c) AS num FROM c a JOIN w ON a.sample_id = w.a JOIN c b ON b.sample_id = w.b AND b.fpos = a.fpos GROUP BY 1) USING (fpos)) ORDER BY round(score, 9), fpos LIMIT 20",
    "x",
)(lambda s, d: tidy(select.laplacian_top(frames.emb(s, d), 20)))
ORACLES["select_laplacian"] = ORACLES["select_laplacian"].replace(") SELECT fpos, feature, (round", "), z AS (SELECT sample_id, fpos, feature, (value - avg(value) OVER p) / coalesce(nullif(stddev_pop(value) OVER p, 0), 1) AS z FROM x WINDOW p AS (PARTITION BY feature)), v AS (SELECT sample_id, list(z ORDER BY fpos) AS v FROM z GROUP BY 1), kn AS (SELECT a, b FROM (SELECT p.sample_id AS a, q.sample_id AS b, row_number() OVER (PARTITION BY p.sample_id ORDER BY round(list_cosine_similarity(p.v, q.v), 9) DESC, q.sample_id) AS r FROM v p JOIN v q ON p.sample_id <> q.sample_id) WHERE r <= 5), w AS (SELECT a, b FROM kn UNION SELECT b, a FROM kn), dd AS (SELECT a AS sample_id, count(*)::DOUBLE AS d FROM w GROUP BY 1), c AS (SELECT sample_id, fpos, feature, d, z - sum(d * z) OVER p / sum(d) OVER p AS c FROM z JOIN dd USING (sample_id) WINDOW p AS (PARTITION BY feature)) SELECT fpos, feature, (round", 1)
query("anova_f", "SELECT feature, {R(between / d1 / (within / d2))R} AS f, d1, d2 FROM (SELECT feature, sum(n * (m - gm) ** 2) AS between, sum(n * v) AS within, (count(*) - 1)::DOUBLE AS d1, (sum(n) - count(*))::DOUBLE AS d2 FROM (SELECT feature, y, count(*) AS n, avg(value) AS m, var_pop(value) AS v, sum(sum(value)) OVER (PARTITION BY feature) / sum(count(*)) OVER (PARTITION BY feature) AS gm FROM x JOIN y USING (sample_id) GROUP BY 1, 2) GROUP BY 1)", "x", "y")(lambda s, d: tidy(select.anova(frames.emb(s, d), frames.emb_label(s, d)).select("feature", "f", "d1", "d2")))
query("regression_f", "SELECT feature, {R(r * r / (1 - r * r) * (n - 2))R} AS f FROM ry", "ry")(lambda s, d: tidy(select.regression_f(frames.emb(s, d), frames.emb_label(s, d)).select("feature", "f")))
query("select_f_classification")(lambda s, d: tidy(select.f_top(frames.emb(s, d), frames.emb_label(s, d), 20).select("fpos", "feature", "f", "p", "q", "significant")))
query("select_f_regression")(lambda s, d: tidy(select.f_top(frames.emb(s, d), frames.emb_label(s, d), 20, task="regression").select("fpos", "feature", "f", "p", "q", "significant")))
query("select_pca")(lambda s, d: tidy(select.pca_top(frames.emb(s, d), 20)))
_GLM = ", gx AS (SELECT value AS x, (y >= 5)::INTEGER AS y FROM x JOIN y USING (sample_id) WHERE feature = 'f000'), w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"
for _i in range(8):
    _GLM += f", s{_i} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(v) + 1e-8 AS h11, sum(v * x) AS h12, sum(v * x * x) + 1e-8 AS h22, sum(y - p) AS g1, sum(x * (y - p)) AS g2 FROM (SELECT *, p * (1 - p) + 1e-12 AS v FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS p FROM gx, w{_i}))), w{_i + 1} AS (SELECT a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS a, b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b FROM s{_i})"
query("binomial_glm", "SELECT unnest(['(intercept)', 'f000']) AS term, unnest([{R(a)R}, {R(b)R}]) AS coefficient FROM w8", "x", "y")(
    lambda s, d: tidy(glm.binomial(frames.emb(s, d).where("feature = 'f000'").join(frames.emb_label(s, d), "sample_id").select(F.col("value").alias("f000"), (F.col("y") >= 5).cast("double").alias("y")), ["f000"], intercept=True).select("term", "coefficient"))
)
ORACLES["binomial_glm"] = ORACLES["binomial_glm"].replace(" SELECT unnest(", _GLM + " SELECT unnest(", 1)
query("select_forest")(lambda s, d: tidy(select.forest_top(frames.emb(s, d), frames.emb_label(s, d), 20)))
query("select_in_both", "SELECT feature FROM (SELECT feature FROM (SELECT fpos, feature, var_pop(value) AS score FROM x GROUP BY 1, 2) ORDER BY round(score, 9) DESC, fpos LIMIT 32) INTERSECT SELECT feature FROM (SELECT fpos, feature, coalesce(abs(r), 0) AS score FROM ry ORDER BY round(score, 9) DESC, fpos LIMIT 32)", "ry")(lambda s, d: select.in_both(select.variance_top(frames.emb(s, d), 32), select.correlation_top(frames.emb(s, d), frames.emb_label(s, d), 32)))
query("pearson_pvalues")(lambda s, d: tidy(select.pearson_with(frames.emb(s, d), frames.emb_label(s, d)).select("feature", "r", special.pearson_pvalue("r", F.col("n").cast("double")).alias("p"))))

# ---- partitions, cuts and ranks over the undirected trade network ---------------------------------


def trade_undirected(s: SparkSession, d: str) -> DataFrame:
    return clean.undirected(frames.trade(s, d), "mean")


def by_region(s: SparkSession, d: str) -> DataFrame:
    return frames.nations(s, d).select("node", F.col("modality").alias("community"))


PARTS |= {
    "und": "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, avg(weight) AS weight FROM tr GROUP BY 1, 2",
    "sy": "SELECT src, dst, weight FROM und UNION ALL SELECT dst, src, weight FROM und WHERE src <> dst",
    "sc": "SELECT sy.*, a.modality AS c1, b.modality AS c2 FROM sy JOIN nodes a ON src = a.node JOIN nodes b ON dst = b.node",
}
_NEEDS |= {"und": ["tr"], "sy": ["und"], "sc": ["sy", "nodes"]}
query("modularity", "SELECT {R(sum(i / m - (t / m) ** 2))R} AS modularity FROM (SELECT c1, sum(weight) AS t, sum(weight) FILTER (c1 = c2) AS i, sum(sum(weight)) OVER () AS m FROM sc GROUP BY c1)", "sc")(lambda s, d: tidy(community.modularity(trade_undirected(s, d), by_region(s, d))))
query("contract", "SELECT c1 AS src, c2 AS dst, {R(sum(weight))R} AS weight FROM sc GROUP BY 1, 2", "sc")(lambda s, d: net(community.contract(trade_undirected(s, d), by_region(s, d))))
query("conductance", "SELECT {R(sum(weight) FILTER (c1 = 'ASIA' AND c2 <> 'ASIA') / least(sum(w) FILTER (c1 = 'ASIA'), sum(w) FILTER (c1 <> 'ASIA')))R} AS conductance FROM (SELECT *, CASE WHEN src = dst THEN 2 * weight ELSE weight END AS w FROM sc)", "sc")(lambda s, d: tidy(community.conductance(trade_undirected(s, d), by_region(s, d).where("community = 'ASIA'").select("node"))))
_PR = ", v AS (SELECT node, CASE WHEN node IN ('NATION_7', 'NATION_13') THEN 0.5 ELSE 0 END::DOUBLE AS v FROM nodes), st AS (SELECT src, sum(weight) AS t FROM sy GROUP BY 1), p AS (SELECT sy.src, dst, weight / t AS p FROM sy JOIN st USING (src)), r0 AS (SELECT node, 1.0 / 25 AS score FROM nodes)"
for _i in range(10):
    _PR += f", r{_i + 1} AS (SELECT node, 0.9 * coalesce(g, 0) + 0.1 * v AS score FROM v LEFT JOIN (SELECT dst, sum(p * score) AS g FROM p JOIN r{_i} ON src = node GROUP BY 1) ON dst = node)"
query("pagerank", "SELECT node, {R(score)R} AS score FROM r10", "sy", "nodes")(lambda s, d: tidy(community.pagerank(trade_undirected(s, d), s.createDataFrame([("NATION_7", 1.0), ("NATION_13", 1.0)], "node string, weight double"), fixed=10)))
ORACLES["pagerank"] = ORACLES["pagerank"].replace(" SELECT node, (round(score", _PR + " SELECT node, (round(score")
query(
    "sweep_cuts",
    "SELECT place, node, {R(cut)R} AS cut, {R(volume)R} AS volume, CASE WHEN least(volume, total - volume) > 1e-12 * total THEN {R(cut / least(volume, total - volume))R} END AS conductance FROM (SELECT place, node, sum(k - coalesce(loop, 0) - 2 * coalesce(inner_w, 0)) OVER o AS cut, sum(k) OVER o AS volume, (SELECT sum(weight) FROM sy) AS total FROM ord LEFT JOIN (SELECT a.node, sum(weight) AS inner_w FROM sy JOIN ord a ON sy.src = a.node JOIN ord b ON sy.dst = b.node WHERE b.place < a.place GROUP BY 1) USING (node) LEFT JOIN (SELECT src AS node, weight AS loop FROM sy WHERE src = dst) USING (node) WINDOW o AS (ORDER BY place))",
    "sy",
    "nodes",
)(lambda s, d: tidy(community.sweep_cuts(trade_undirected(s, d), community.pagerank(trade_undirected(s, d), s.createDataFrame([("NATION_7", 1.0), ("NATION_13", 1.0)], "node string, weight double"), fixed=10))))
ORACLES["sweep_cuts"] = ORACLES["sweep_cuts"].replace(" SELECT place, node, (round(cut", _PR + ", ord AS (SELECT node, t AS k, row_number() OVER (ORDER BY score / t DESC, node DESC) AS place FROM r10 JOIN st ON src = node WHERE score > 0) SELECT place, node, (round(cut")
query("pagerank_converged")(lambda s, d: tidy(community.pagerank(trade_undirected(s, d), s.createDataFrame([("NATION_7", 1.0)], "node string, weight double"))))
_KZ = ", k0 AS (SELECT node, 1.0::DOUBLE AS score FROM nodes)"
for _i in range(5):
    _KZ += f", k{_i + 1} AS (SELECT nodes.node, 1 + 0.1 * coalesce(g, 0) AS score FROM nodes LEFT JOIN (SELECT dst, sum(weight * score) AS g FROM sy JOIN k{_i} ON src = node GROUP BY 1) ON dst = nodes.node)"
query("katz", "SELECT node, {R(score / sqrt(sum(score * score) OVER ()))R} AS score FROM k5", "sy", "nodes")(lambda s, d: tidy(community.katz(trade_undirected(s, d), rounds=5)))
ORACLES["katz"] = ORACLES["katz"].replace(" SELECT node, (round(score", _KZ + " SELECT node, (round(score")
query("eigenvector")(lambda s, d: tidy(community.eigenvector(trade_undirected(s, d), rounds=20)))


def emb_net(s: SparkSession, d: str) -> DataFrame:
    """The undirected network of the 5 strongest correlations of each embedding feature."""
    return clean.undirected(similarity.correlation_network(frames.emb(s, d), k=5, signed_map=False, normalize=False), "max")


query("louvain")(lambda s, d: community.louvain(emb_net(s, d), [0, 1, 2]))
_WISH = """, ks AS (SELECT src AS node, sum(weight) AS k FROM sy GROUP BY 1), m AS (SELECT sum(weight) AS m2 FROM sy),
o AS (SELECT sy.src AS node, dst, a.k, round(weight - a.k * b.k / m2, 12) AS offer FROM sy JOIN ks a ON sy.src = a.node JOIN ks b ON dst = b.node, m WHERE sy.src <> dst),
w AS (SELECT node, dst AS t, k, offer AS net, md5(node || ':0:0.0') AS turn FROM o QUALIFY row_number() OVER (PARTITION BY node ORDER BY offer DESC, dst DESC) = 1),
wish AS (SELECT * FROM w, m WHERE net > 1e-10 * m2 / 2),
lost AS (SELECT u.node, sum(weight) AS lost FROM sy JOIN wish u ON sy.src = u.node JOIN wish v ON dst = v.node WHERE sy.src <> dst AND v.turn < u.turn AND (v.node = u.t OR v.t = u.node) GROUP BY 1)
"""
query(
    "louvain_first_round",
    "SELECT node, t AS \"to\", {R(net * 2 / m2)R} AS gain, {R(sure * 2 / m2)R} AS sure, sure > 1e-10 * m2 / 2 AS goes FROM (SELECT *, net - coalesce(lost, 0) - k * coalesce(sum(k) OVER (PARTITION BY t ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / m2 AS sure FROM wish LEFT JOIN lost USING (node))",
    "sy",
)(lambda s, d: tidy(louvain.first_round(trade_undirected(s, d))))
ORACLES["louvain_first_round"] = ORACLES["louvain_first_round"].replace(' SELECT node, t AS "to"', _WISH + ' SELECT node, t AS "to"')
query("louvain_quality")(lambda s, d: tidy(community.modularity(emb_net(s, d), community.louvain(emb_net(s, d)))))
query("louvain_history")(lambda s, d: community.louvain_history(emb_net(s, d)))
query("correlated_louvain")(lambda s, d: tidy(community.correlated_louvain(emb_net(s, d), frames.emb(s, d), frames.emb_label(s, d), [0.2, 0.8])))
query("top_communities")(lambda s, d: tidy(community.top_communities(community.correlated_louvain(emb_net(s, d), frames.emb(s, d), frames.emb_label(s, d)), 3)))
query("combined_quality")(lambda s, d: tidy(community.combined_quality(emb_net(s, d), community.correlated_louvain(emb_net(s, d), frames.emb(s, d), frames.emb_label(s, d)))))
query("correlated_pagerank")(lambda s, d: tidy(community.correlated_pagerank(emb_net(s, d), frames.emb(s, d), frames.emb_label(s, d), ["f000", "f001", "f002"])))
query("hybrid_louvain")(lambda s, d: tidy(community.hybrid(emb_net(s, d), frames.emb(s, d), frames.emb_label(s, d))))
query("hybrid_best_subgraph")(lambda s, d: net(community.best_subgraph(emb_net(s, d), community.hybrid(emb_net(s, d), frames.emb(s, d), frames.emb_label(s, d)))))

# ---- phenotype ------------------------------------------------------------------------------------


def blocks_of(s: SparkSession, d: str) -> DataFrame:
    """Four sets of 16 embedding features."""
    return similarity.features_of(frames.emb(s, d)).select(F.expr("(fpos div 16)").cast("long").alias("set_id"), "feature")


query("phenotype_correlation")(lambda s, d: tidy(phenotype.omics_correlation(frames.emb(s, d), frames.emb_label(s, d))))
query("phenotype_sets")(lambda s, d: tidy(phenotype.set_correlations(frames.emb(s, d), frames.emb_label(s, d), blocks_of(s, d), standardize=False)))
query("phenotype_cluster")(lambda s, d: tidy(phenotype.cluster_correlation(frames.emb(s, d), frames.emb_label(s, d), ["f000", "f001", "f002"])))
query("phenotype_compare_sets")(lambda s, d: tidy(phenotype.compare_sets(frames.emb(s, d), frames.emb_label(s, d), blocks_of(s, d), blocks_of(s, d).where("set_id < 2"))))

# ---- canonical correlation ------------------------------------------------------------------------


def with_modality(s: SparkSession, d: str) -> DataFrame:
    return frames.emb(s, d).withColumn("modality", F.concat(F.lit("b"), F.expr("(fpos div 16)").cast("string")))


def as_weights(s: SparkSession, d: str) -> DataFrame:
    """Embedding values above 0.2 read as weights of a subsample (the vector)."""
    return frames.emb(s, d).where("abs(value) > 0.2").select("fpos", F.col("sample_id").alias("subsample"), F.col("value").alias("w"))


def two_classes(s: SparkSession, d: str) -> DataFrame:
    return frames.emb_label(s, d).select("sample_id", (F.col("y") >= 5).cast("double").alias("y"))


query("abar", "SELECT a, b, {R(s / max(s) OVER ())R} AS s FROM (SELECT p.fpos::INTEGER AS a, q.fpos::INTEGER AS b, sum(abs(p.value) * abs(q.value)) AS s FROM x p JOIN x q USING (sample_id) WHERE p.fpos <> q.fpos AND abs(p.value) > 0.2 AND abs(q.value) > 0.2 GROUP BY 1, 2)", "x")(lambda s, d: tidy(cca.similarity(as_weights(s, d))))
query("modules")(lambda s, d: cca.modules(cca.similarity(as_weights(s, d))))
query("soft_threshold", _CELL % ("sign(value) * greatest(0, abs(value) - 0.1)", "x"), "x")(lambda s, d: cells(frames.emb(s, d).withColumn("value", F.signum("value") * F.greatest(F.lit(0.0), F.abs("value") - 0.1))))
query("is_binary", "SELECT count(DISTINCT b) = 2 AND min(b) = 0 AND max(b) = 1 AS is_binary FROM (SELECT (y >= 5)::DOUBLE AS b FROM y)", "y")(lambda s, d: cca.is_binary(two_classes(s, d)))
PARTS |= {"sco": "SELECT (y >= 5)::DOUBLE AS y, round(value, 2) + 0.5 AS score FROM x JOIN y USING (sample_id) WHERE fpos = 0"}
_NEEDS |= {"sco": ["x", "y"]}
query(
    "binary_metrics",
    "SELECT {R(avg(((score >= 0.5) = (y = 1))::INTEGER))R} AS accuracy, {R(count(*) FILTER (score >= 0.5 AND y = 1) / count(*) FILTER (score >= 0.5))R} AS precision, {R(count(*) FILTER (score >= 0.5 AND y = 1) / count(*) FILTER (y = 1))R} AS recall, {R(2 * count(*) FILTER (score >= 0.5 AND y = 1) / (count(*) FILTER (score >= 0.5) + count(*) FILTER (y = 1)))R} AS f1, (SELECT {R((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)))R} FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM sco)) AS auc FROM sco",
    "sco",
)(lambda s, d: tidy(cca.binary_metrics(frames.emb(s, d).where("fpos = 0").join(two_classes(s, d), "sample_id").select("y", (F.round("value", 2) + 0.5).alias("score")))))
query("cv_folds", "SELECT sample_id, (ntile(5) OVER (ORDER BY md5(sample_id || ':0'), sample_id) - 1)::INTEGER AS fold FROM y", "y")(lambda s, d: cca.folds(frames.emb_label(s, d).select("sample_id"), 5))
query("stratified_folds", "SELECT sample_id, y, ((row_number() OVER (PARTITION BY y ORDER BY md5(sample_id || ':0'), sample_id) - 1) % 5)::INTEGER AS fold FROM y", "y")(lambda s, d: learn.stratified(frames.emb_label(s, d), 5))
query("holdout_split", "SELECT sample_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(sample_id || ':0'), sample_id) <= round(0.3 * count(*) OVER (PARTITION BY y)) AS test FROM y", "y")(lambda s, d: learn.holdout(frames.emb_label(s, d), 0.3))
query("cca_weights")(lambda s, d: tidy(cca.robust_weights(with_modality(s, d), frames.emb_label(s, d), [0.3] * 4, subsamples=100)))
query("cca_weights_binary")(lambda s, d: tidy(cca.robust_weights(with_modality(s, d), two_classes(s, d), [0.3] * 4, subsamples=100, binary=True)))
query("cca_tuning")(lambda s, d: tidy(cca.tune(with_modality(s, d), frames.emb_label(s, d), [[p] * 4 for p in (0.1, 0.2, 0.3, 0.4, 0.5)], k=5)))
query("cca_auto_network")(lambda s, d: tidy(cca.auto_network(with_modality(s, d), frames.emb_label(s, d), tuning=2, k=5, subsamples=100)["pruned"]))

# ---- learning -------------------------------------------------------------------------------------

_CLIN = "SELECT vec_id::VARCHAR AS sample_id, label::DOUBLE AS y, (label % 2)::DOUBLE AS b FROM embeddings"
PARTS |= {
    "cl": _CLIN,
    "rb": _RY.replace("value - avg", "value - avg").replace("y - avg(y)", "b - avg(b)").replace("AS b FROM x JOIN y", "AS b FROM x JOIN cl"),
}
_NEEDS |= {"cl": [], "rb": ["x", "cl"]}


def clin_vars(s: SparkSession, d: str) -> DataFrame:
    return frames.emb_label(s, d).select("sample_id", "y", (F.col("y") % 2).alias("b"))


_FZ = "atanh(greatest(least(coalesce(r, 0), 0.999999), -0.999999))"
query("clinical_node_features", f"SELECT feature, 'y' AS variable, {R}{_FZ})R}} AS z FROM ry UNION ALL SELECT feature, 'b', {R}{_FZ})R}} FROM rb", "ry", "rb")(lambda s, d: tidy(learn.clinical_features(frames.emb(s, d), clin_vars(s, d), ["y", "b"])))
query("adaptive_node_features", f"SELECT feature, variable, {R}(z - avg(z) OVER p) / stddev_samp(z) OVER p)R}} AS z FROM (SELECT feature, 'y' AS variable, {_FZ} AS z FROM ry UNION ALL SELECT feature, 'b', {_FZ} FROM rb) WINDOW p AS (PARTITION BY variable)", "ry", "rb")(lambda s, d: tidy(learn.adaptive_features(frames.emb(s, d), clin_vars(s, d), ["y", "b"], clin_vars(s, d).select("sample_id"))))
query("abs_pearson_node_features", "SELECT feature, 'y' AS variable, {R(coalesce(abs(r), 0))R} AS score FROM ry", "ry")(lambda s, d: tidy(learn.abs_pearson_features(frames.emb(s, d), clin_vars(s, d), ["y"], clin_vars(s, d).select("sample_id"))))
query("statistical_node_features", "SELECT feature, {R(any_value(m))R} AS mean, {R(sign(avg(((value - m) / s) ** 3)) * ln(1 + abs(avg(((value - m) / s) ** 3))))R} AS skew, {R(median(abs(value - md)))R} AS mad FROM x JOIN (SELECT feature, avg(value) AS m, stddev_pop(value) AS s, median(value) AS md FROM x GROUP BY 1) USING (feature) GROUP BY 1", "x")(lambda s, d: tidy(learn.statistical_features(frames.emb(s, d), frames.emb_label(s, d))))
query("node_labels", f"SELECT feature, {R}(z - avg(z) OVER ()) / stddev_samp(z) OVER ())R}} AS label FROM (SELECT feature, {_FZ} AS z FROM ry)", "ry")(lambda s, d: tidy(learn.node_labels(frames.emb(s, d), frames.emb_label(s, d))))
query("both_directions", "SELECT src, dst, {R(weight)R} AS weight FROM sy WHERE src <> dst", "sy")(lambda s, d: net(learn.both_directions(trade_undirected(s, d))))
query("normalized_edges", "SELECT e.src, e.dst, {R(weight / sqrt(a.d * b.d))R} AS weight FROM (SELECT src, dst, weight FROM sy WHERE src <> dst UNION ALL SELECT n, n, m FROM (SELECT DISTINCT src AS n FROM sy WHERE src <> dst), (SELECT avg(weight) AS m FROM sy WHERE src <> dst)) e JOIN (SELECT dst AS n, count(*) + 1 AS d FROM sy WHERE src <> dst GROUP BY 1) a ON a.n = e.src JOIN (SELECT dst AS n, count(*) + 1 AS d FROM sy WHERE src <> dst GROUP BY 1) b ON b.n = e.dst", "sy")(lambda s, d: net(learn.normalized_edges(trade_undirected(s, d))))


def reduced(s: SparkSession, d: str) -> DataFrame:
    """The first two vectors read as two components of the features."""
    return frames.emb(s, d).where("sample_id in ('0', '1')").select("feature", F.col("sample_id").cast("int").alias("component"), "value")


PARTS |= {"fw": "SELECT feature, 2 * (rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2 - 1) / (count(*) OVER () - 1) - 1 AS w FROM (SELECT feature, round(avg(u), 9) AS m FROM (SELECT feature, (value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p) AS u FROM x WHERE sample_id IN ('0', '1') WINDOW p AS (PARTITION BY sample_id)) GROUP BY 1)"}
_NEEDS |= {"fw": ["x"]}
query("feature_weights", "SELECT feature, {R(w)R} AS w FROM fw", "fw")(lambda s, d: tidy(learn.feature_weights(reduced(s, d))))
query("fuse_embeddings", _CELL % ("value * (0.5 + 0.5 * 2 * w)", "x JOIN fw USING (feature)"), "fw")(lambda s, d: cells(learn.fuse(frames.emb(s, d), learn.feature_weights(reduced(s, d)))))


def fixed_scores(s: SparkSession, d: str) -> DataFrame:
    """Class scores for three classes from the first three features: no model, but a table to compute metrics of."""
    own = frames.emb(s, d).where("fpos < 3").join(frames.emb_label(s, d), "sample_id")
    return own.select(F.lit(0).alias("fold"), "sample_id", (F.col("y") % 3).alias("y"), F.col("fpos").cast("double").alias("class"), F.round("value", 2).alias("score"))


PARTS |= {
    "fs": "SELECT sample_id, y % 3 AS y, fpos::DOUBLE AS class, round(value, 2) AS score FROM x JOIN y USING (sample_id) WHERE fpos < 3",
    "best": "SELECT sample_id, y, arg_max(class, (score, -class)) AS guess FROM fs GROUP BY 1, 2",
    "per": "SELECT c, n, hit, coalesce(said, 0) AS said FROM (SELECT y AS c, count(*) AS n, count(*) FILTER (guess = y) AS hit FROM best GROUP BY 1) LEFT JOIN (SELECT guess AS c, count(*) AS said FROM best GROUP BY 1) USING (c)",
    "area": "SELECT class, (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auc, sum(tp / seen) FILTER (pos) / count(*) FILTER (pos) AS ap FROM (SELECT class, y = class AS pos, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2 AS r, sum((y = class)::INTEGER) OVER (PARTITION BY class ORDER BY score DESC) AS tp, count(*) OVER (PARTITION BY class ORDER BY score DESC) AS seen FROM fs) GROUP BY 1",
}
_NEEDS |= {"fs": ["x", "y"], "best": ["fs"], "per": ["best"], "area": ["fs"]}
query("classification_metrics", "SELECT 0 AS fold, {R(sum(hit) / sum(n))R} AS accuracy, {R(avg(2 * hit / (n + said)))R} AS f1_macro, {R(sum(2 * hit / (n + said) * n) / sum(n))R} AS f1_weighted, {R(avg(hit / n))R} AS recall_macro, {R(avg(hit / said))R} AS precision_macro, (SELECT {R(avg(auc))R} FROM area) AS auc, (SELECT {R(avg(ap))R} FROM area) AS aupr FROM per", "per", "area")(lambda s, d: tidy(learn.metrics(fixed_scores(s, d), ["fold"])))


def node_inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = frames.emb(s, d)
    return emb_net(s, d), learn.clinical_features(x, clin_vars(s, d), ["y", "b"]), learn.node_labels(x, frames.emb_label(s, d))


for _m in ("GCN", "GAT", "SAGE", "GIN"):
    query(f"embed_{_m.lower()}")(lambda s, d, m=_m: learn.embed_nodes(*node_inputs(s, d), kind=m))
query("embed_tuning")(lambda s, d: tidy(learn.tune_embedding(*node_inputs(s, d))))
query("subject_representation_pca")(lambda s, d: cells(learn.represent(frames.emb(s, d), learn.embed_nodes(*node_inputs(s, d)), "PCA")))
query("subject_representation_ae")(lambda s, d: cells(learn.represent(frames.emb(s, d), learn.embed_nodes(*node_inputs(s, d)), "AE")))
query("outcome_prediction")(lambda s, d: tidy(learn.evaluate(emb_net(s, d), frames.emb(s, d), frames.emb_label(s, d), clin_vars(s, d), ["b"], k=5)["runs"]))
query("outcome_holdout")(lambda s, d: tidy(learn.evaluate(emb_net(s, d), frames.emb(s, d), frames.emb_label(s, d), clin_vars(s, d), ["b"], share=0.3, repeats=3)["summary"]))
query("outcome_tuning")(lambda s, d: tidy(learn.tune_outcome(emb_net(s, d), frames.emb(s, d), two_classes(s, d), trials=3, k=3)["runs"]))
query("representation_tuning")(lambda s, d: tidy(learn.tune_representation(frames.emb(s, d), learn.embed_nodes(*node_inputs(s, d)), frames.emb_label(s, d))))
query("discriminant_weights")(lambda s, d: tidy(cca.discriminant_weights(frames.emb(s, d), two_classes(s, d))))
query("baseline_logistic")(lambda s, d: tidy(learn.baseline(frames.emb(s, d), frames.emb_label(s, d), "lr")))
query("baseline_tree")(lambda s, d: tidy(learn.baseline(frames.emb(s, d), frames.emb_label(s, d), "dt")))
query("baseline_forest")(lambda s, d: tidy(learn.baseline(frames.emb(s, d), frames.emb_label(s, d), "rf")))
query("baseline_boosting")(lambda s, d: tidy(learn.baseline(frames.emb(s, d), two_classes(s, d), "gbt")))
query("baseline_perceptron")(lambda s, d: tidy(learn.baseline(frames.emb(s, d), frames.emb_label(s, d), "mlp")))
query("baseline_vectors")(lambda s, d: tidy(learn.baseline(frames.emb(s, d), two_classes(s, d), "svm")))
def _scratch(s: SparkSession, name: str) -> str:
    return f"{iterate.checkpoint_dir(s)}/plexmat/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT sample_id, fpos::INTEGER AS fpos, feature, {R(value)R} AS value FROM x", "x")
def _(s, d):
    """The matrix of embeddings written as index-first CSV and read back."""
    path = _scratch(s, "csv")
    frames.write_matrix_csv(frames.emb(s, d), path)
    return tidy(frames.from_wide(frames.read_csv(s, path), "sample_id"), "value")


@query(
    "folds_round_trip",
    "SELECT fold::INTEGER AS fold, part, count(*) AS n, {R(sum(y))R} AS y, {R(sum(total))R} AS total FROM (SELECT f + 1 AS fold, CASE WHEN f = own THEN 'test' ELSE 'train' END AS part, y, total FROM (SELECT sample_id, y, (row_number() OVER (PARTITION BY y ORDER BY md5(sample_id || ':0'), sample_id) - 1) % 3 AS own FROM y) JOIN (SELECT sample_id, sum(value) AS total FROM x GROUP BY 1) USING (sample_id), range(3) r(f)) GROUP BY 1, 2",
    "x",
    "y",
)
def _(s, d):
    """Stratified folds written in their folders and read back: rows, classes and values of each table."""
    base = _scratch(s, "folds")
    frames.write_folds(base, [frames.emb(s, d)], learn.stratified(frames.emb_label(s, d), 3))
    back = frames.read_folds(s, base, 1, 3)
    out = None
    for part in ("train", "test"):
        x = back[f"X_{part}_Omics_1"]
        total = sum((F.col(c) for c in x.columns if c not in ("sample_id", "fold")), F.lit(0.0))
        both = x.select("fold", "sample_id", total.alias("total")).join(back[f"Y_{part}"], ["fold", "sample_id"])
        own = both.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("total").alias("total")).select("fold", F.lit(part).alias("part"), "n", F.col("y").cast("double").alias("y"), "total")
        out = own if out is None else out.unionByName(own)
    return tidy(out)


@query("bundle_round_trip", "SELECT src, dst, {R(weight)R} AS weight, modality FROM tr JOIN nodes ON src = node", "tr", "nodes")
def _(s, d):
    """A bundle loaded by name, written table by table and read back by its schemas."""
    found = frames.load(s, " Trade ", d)
    folder = _scratch(s, "bundle")
    frames.write_frames(found.tables, folder, "json")
    back = frames.read_frames(s, folder, {k: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema) for k, t in found.tables.items()}, "json")
    return tidy(back["edges"].join(back["nodes"].select(F.col("node").alias("src"), "modality"), "src").select("src", "dst", "weight", "modality"))


query("network_search")(lambda s, d: tidy(learn.network_search(frames.emb(s, d), frames.emb_label(s, d), [{"method": "correlation", "k": 5}, {"method": "similarity", "k": 5}])))

# ---- alignment ------------------------------------------------------------------------------------

query("align_inner", "SELECT sample_id, feature, {R(value)R} AS value, y FROM x JOIN y USING (sample_id)", "x", "y")(lambda s, d: tidy(align.inner(frames.emb(s, d), frames.emb_label(s, d)).select("sample_id", "feature", "value", "y"), "value"))
query("align_left", "SELECT sample_id, priority, y FROM clin LEFT JOIN y USING (sample_id)", "clin", "y")(lambda s, d: align.left(frames.clinical(s, d).select("sample_id", "priority"), frames.emb_label(s, d)))
query("missing_features", "SELECT DISTINCT feature FROM x WHERE feature NOT IN (SELECT feature FROM ev)", "x", "ev")(lambda s, d: align.missing(frames.emb(s, d), frames.evt(s, d)))
query("bind_modalities", "SELECT sample_id, 'e' AS modality, feature, {R(value)R} AS value FROM x UNION ALL SELECT sample_id, 'v', feature, {R(value)R} FROM ev", "x", "ev")(lambda s, d: tidy(align.bind(e=frames.emb(s, d), v=frames.evt(s, d))))
query("wide_matrix", "SELECT sample_id, " + ", ".join(f"{R}max(value) FILTER (fpos = {i}))R}} AS f{i:03d}" for i in range(64)) + " FROM x GROUP BY 1", "x")(lambda s, d: tidy(frames.to_wide(frames.emb(s, d), [f"f{i:03d}" for i in range(64)])))
query("variance_histogram", "SELECT b AS bin, {R(lo + b * (hi - lo) / 10)R} AS low, n FROM (SELECT least(floor((v - lo) / ((hi - lo) / 10)), 9)::INTEGER AS b, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n FROM (SELECT v, min(v) OVER () AS lo, max(v) OVER () AS hi FROM (SELECT var_samp(value) AS v FROM x GROUP BY feature)) GROUP BY 1)", "x")(lambda s, d: tidy(profile.variance_histogram(frames.emb(s, d))))
query("variance_by_feature", "SELECT feature, {R(var_samp(value))R} AS variance FROM x GROUP BY 1", "x")(lambda s, d: tidy(frames.emb(s, d).groupBy("feature").agg(F.var_samp("value").alias("variance"))))
query("stream_profile", "SELECT event_type, count(value) AS n, {R(avg(value))R} AS mean, {R(var_samp(value))R} AS variance FROM events GROUP BY 1")(lambda s, d: tidy(stream_profile.merged(stream_profile.windowed(frames.table(s, d, "events")))))
query("align_all", "SELECT sample_id FROM x INTERSECT SELECT sample_id FROM ev INTERSECT SELECT sample_id FROM clin", "x", "ev", "clin")(lambda s, d: align.common(frames.emb(s, d), frames.evt(s, d), frames.clinical(s, d)))
query("map_sample_keys", "SELECT user_id::VARCHAR AS sample_id, event_type AS name, count(*) AS n FROM events JOIN (SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events WHERE event_type IS NOT NULL GROUP BY 1) USING (user_id) GROUP BY 1, 2".replace("event_type AS name, count(*)", "m AS name, count(*)").replace("AS event_type FROM events WHERE", "AS m FROM events WHERE"))(
    lambda s, d: align.map_keys(frames.table(s, d, "events").select("user_id", "ts"), frames.table(s, d, "events").select("user_id", F.col("event_type").alias("name"), "ts", "event_id"), "user_id", "name", ["ts", "event_id"]).groupBy(F.col("user_id").cast("string").alias("sample_id"), "name").agg(F.count("*").alias("n"))
)
query("network_on_matrix", "SELECT src, dst, {R(weight)R} AS weight FROM tr WHERE src IN (SELECT n_name FROM nation WHERE n_regionkey < 3) AND dst IN (SELECT n_name FROM nation WHERE n_regionkey < 3)", "tr")(
    lambda s, d: net(align.network_and_matrix(frames.trade(s, d), frames.table(s, d, "nation").where("n_regionkey < 3").select(F.col("n_name").alias("feature")))[0])
)
query("labels", "SELECT sample_id, y FROM y", "y")(lambda s, d: align.labels_of(s, frames.emb_label(s, d)))

# ---- SQL of what needs more than one statement's worth: reports, tails, first components, rounds of ranks ----------


def _oracle(name: str, text: str, *parts: str) -> None:
    ORACLES[name] = sql(text, *parts)


_STATS = ("mean", "median", "min", "max", "std")
_LONG = " UNION ALL ".join("SELECT '%s_" + m + "' AS metric, " + f + "::DOUBLE AS value FROM %s" for m, f in zip(_STATS, ("avg(v)", "median(v)", "min(v)", "max(v)", "stddev_samp(v)"), strict=True))
_PER = {"variance": ("pv", "count(*) FILTER (v < 0.0001)"), "zero": ("pz", "count(*) FILTER (v > 0.5)"), "mean": ("pm", "max(0)"), "correlation": ("pc", "max(0)")}
PARTS |= {
    "pv": "SELECT var_samp(value) AS v FROM x GROUP BY feature",
    "pz": "SELECT count(*) FILTER (value = 0) / count(*) AS v FROM x GROUP BY feature",
    "pm": "SELECT avg(value) AS v FROM x GROUP BY feature",
    "pc": "SELECT max(abs(s)) AS v FROM pear GROUP BY src",
    "rep": " UNION ALL ".join([_LONG % tuple(w for _ in _STATS for w in (n, t)) + f" UNION ALL SELECT '{n}_flagged', {f}::DOUBLE FROM {t}" for n, (t, f) in _PER.items()]) + " UNION ALL SELECT 'missing_pct', 100.0 * count(*) FILTER (value IS NULL) / count(*) FROM x",
}
_NEEDS |= {"pv": ["x"], "pz": ["x"], "pm": ["x"], "pc": ["pear"], "rep": ["pv", "pz", "pm", "pc"]}
_oracle("profile_report", "SELECT metric, {R(value)R} AS value FROM rep UNION ALL SELECT 'advice', CASE WHEN max(value) FILTER (metric = 'missing_pct') > 30 THEN 1 WHEN max(value) FILTER (metric = 'mean_min') >= 0 AND max(value) FILTER (metric = 'mean_max') <= 1 THEN 2 WHEN max(value) FILTER (metric = 'zero_flagged') > 0 THEN 3 ELSE 0 END::DOUBLE FROM rep", "rep")

_CODE = "CASE lower(trim(priority)) WHEN '1-urgent' THEN 1::DOUBLE WHEN '2-high' THEN 2 WHEN '3-medium' THEN 3 WHEN '4-not specified' THEN 4 END"
PARTS |= {"clo": f"SELECT sample_id, segment, balance::DOUBLE AS balance, nation::DOUBLE AS nation, coalesce(code, median(code) OVER ()) AS priority FROM (SELECT *, {_CODE} AS code FROM clin)"}
_NEEDS |= {"clo": ["clin"]}
_SCALED = "(({0} - median({0}) OVER ()) / coalesce(nullif(quantile_cont({0}, 0.75) OVER () - quantile_cont({0}, 0.25) OVER (), 0), 1))::FLOAT AS {0}"
_oracle("clinical_assemble", "SELECT sample_id, " + ", ".join(_SCALED.format(c) for c in ("balance", "nation", "priority")) + ", " + ", ".join(f"(CASE WHEN lower(trim(segment)) = '{x}' THEN 1 ELSE 0 END)::FLOAT AS \"segment_{x}\"" for x in ("building", "furniture", "household", "machinery")) + " FROM clo", "clo")


def betainc(x: str, a: str, b: str, steps: int = 4000) -> str:
    """The regularised incomplete beta function as SQL: Simpson's rule over the angle whose squared sine is the variable."""
    inside = f"exp((2 * ({a}) - 1) * ln(greatest(sin(h * i), 1e-300)) + (2 * ({b}) - 1) * ln(greatest(cos(h * i), 1e-300)) + lgamma(({a}) + ({b})) - lgamma({a}) - lgamma({b}))"
    return f"(SELECT 2 * sum(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {inside}) * any_value(h) / 3 FROM (SELECT i, asin(sqrt(least(greatest({x}, 0), 1))) / {steps} AS h FROM range({steps + 1}) t(i)))"


_oracle("pearson_pvalues", "SELECT feature, {R(r)R} AS r, {R(" + betainc("1 - r * r", "(n - 2) / 2.0", "0.5") + ")R} AS p FROM ry", "ry")
PARTS |= {
    "fc": "SELECT fpos, feature, between / d1 / (within / d2) AS f, d1, d2 FROM (SELECT fpos, feature, sum(n * (m - gm) ** 2) AS between, sum(n * v) AS within, (count(*) - 1)::DOUBLE AS d1, (sum(n) - count(*))::DOUBLE AS d2 FROM (SELECT fpos, feature, y, count(*) AS n, avg(value) AS m, var_pop(value) AS v, sum(sum(value)) OVER (PARTITION BY feature) / sum(count(*)) OVER (PARTITION BY feature) AS gm FROM x JOIN y USING (sample_id) GROUP BY 1, 2, 3) GROUP BY 1, 2)",
    "fr": "SELECT fpos, feature, r * r / (1 - r * r) * (n - 2) AS f, 1.0::DOUBLE AS d1, (n - 2)::DOUBLE AS d2 FROM ry",
}
_NEEDS |= {"fc": ["x", "y"], "fr": ["ry"]}
for _n, _t in (("classification", "fc"), ("regression", "fr")):
    _p = f"SELECT *, {betainc('d2 / (d2 + d1 * f)', 'd2 / 2', 'd1 / 2')} AS p FROM {_t}"
    _q = f"SELECT *, least(1.0, min(p * m / k) OVER (ORDER BY k DESC)) AS q FROM (SELECT *, row_number() OVER (ORDER BY p, fpos) AS k, count(*) OVER () AS m FROM ({_p}))"
    _oracle(f"select_f_{_n}", "SELECT fpos, feature, {R(f)R} AS f, {R(p)R} AS p, {R(q)R} AS q, q < 0.05 AS significant FROM (" + _q + ") ORDER BY q < 0.05 DESC, round(f, 6) DESC, fpos LIMIT 20", _t)


def first_components(sets: str, scale: bool, doublings: int = 18) -> list[tuple[str, str]]:
    """Named parts for `comp` (set_id, size, n, r): |r| of the first component of each set of features with y.

    The leading direction is a column of a high power of the set's covariance, which is squared again and again.
    """
    unit = "/ coalesce(nullif(stddev_pop(value) OVER p, 0), 1)" if scale else ""
    parts = [("sets", sets), ("cc", f"SELECT set_id, sample_id, feature, y, (value - avg(value) OVER p) {unit} AS c FROM x JOIN sets USING (feature) JOIN y USING (sample_id) WINDOW p AS (PARTITION BY set_id, feature)")]
    scaled = "SELECT set_id, i, j, v / sum(v) FILTER (i = j) OVER (PARTITION BY set_id) AS v FROM ({})"
    parts.append(("m0", scaled.format("SELECT a.set_id, a.feature AS i, b.feature AS j, sum(a.c * b.c) AS v FROM cc a JOIN cc b USING (set_id, sample_id) GROUP BY 1, 2, 3")))
    parts += [(f"m{k + 1}", scaled.format(f"SELECT a.set_id, a.i, b.j, sum(a.v * b.v) AS v FROM m{k} a JOIN m{k} b ON a.set_id = b.set_id AND a.j = b.i GROUP BY 1, 2, 3")) for k in range(doublings)]
    parts.append(("lead", f"SELECT m.set_id, m.i AS feature, m.v FROM m{doublings} m JOIN (SELECT set_id, arg_max(i, v) AS j FROM m{doublings} WHERE i = j GROUP BY 1) USING (set_id, j)"))
    parts.append(("comp", "SELECT set_id, any_value(size) AS size, count(*) AS n, abs(corr(pc, y)) AS r FROM (SELECT set_id, sample_id, any_value(y) AS y, count(*) AS size, sum(c * v) AS pc FROM cc JOIN lead USING (set_id, feature) GROUP BY 1, 2) GROUP BY 1"))
    return parts


def _with_components(name: str, body: str, sets: str, scale: bool = False, doublings: int = 18, before: tuple[str, ...] = (), more: str = "") -> None:
    head = sql("", "x", "y", *before)[len("WITH ") :].strip()
    own = ", ".join(f"{n} AS MATERIALIZED ({t})" for n, t in first_components(sets, scale, doublings))
    ORACLES[name] = f"WITH {head}, {own}{more} " + body.replace("{R(", "(round(").replace(")R}", ", 6) + 0.0)")


_TAIL = "{R(" + betainc("1 - r * r", "(n - 2) / 2.0", "0.5") + ")R} AS p"
_BLOCKS = "SELECT DISTINCT (fpos // 16)::BIGINT AS set_id, feature FROM x"
_with_components("phenotype_correlation", "SELECT {R(r)R} AS r, " + _TAIL + " FROM comp", "SELECT DISTINCT 0::BIGINT AS set_id, feature FROM x", True)
_with_components("phenotype_sets", "SELECT set_id, size, {R(r)R} AS r, " + _TAIL + " FROM comp", _BLOCKS)
_with_components("phenotype_cluster", "SELECT size, {R(r)R} AS r, " + _TAIL + " FROM comp", "SELECT DISTINCT 0::BIGINT AS set_id, feature FROM x WHERE feature IN ('f000', 'f001', 'f002')")
_RANKED = "(SELECT row_number() OVER (ORDER BY size DESC, set_id) AS rank, size AS size{0}, {{R(r)R}} AS r{0} FROM comp{1})"
_with_components("phenotype_compare_sets", "SELECT * FROM " + _RANKED.format(1, "") + " JOIN " + _RANKED.format(2, " WHERE set_id < 2") + " USING (rank)", _BLOCKS)


def by_block(s: SparkSession, d: str) -> DataFrame:
    """The four blocks of features as communities, each with the correlation of its first component."""
    sets = blocks_of(s, d)
    rho = phenotype.set_correlations(frames.emb(s, d), frames.emb_label(s, d), sets).select("set_id", F.col("r").alias("rho"))
    return sets.join(rho, "set_id").select(F.col("feature").alias("node"), F.col("set_id").alias("community"), "rho")


query("top_communities_of_blocks")(lambda s, d: tidy(community.top_communities(by_block(s, d), 2), "rho"))
_with_components("top_communities_of_blocks", "SELECT set_id AS community, size, {R(r)R} AS rho, (SELECT list(feature ORDER BY feature) FROM sets WHERE sets.set_id = comp.set_id) AS nodes FROM comp ORDER BY r DESC, set_id LIMIT 2", _BLOCKS, True)
PARTS |= {
    "k5": f"SELECT src, dst, s FROM {_KNN % ('(SELECT src, dst, src_pos, dst_pos, abs(s) AS s FROM pear)', 5)}",
    "en": "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(s) AS weight FROM k5 GROUP BY 1, 2",
    "es": "SELECT src, dst, weight FROM en UNION ALL SELECT dst, src, weight FROM en WHERE src <> dst",
}
_NEEDS |= {"k5": ["pear"], "en": ["k5"], "es": ["en"]}
query("combined_quality_of_blocks")(lambda s, d: tidy(community.combined_quality(emb_net(s, d), by_block(s, d))))
_with_components(
    "combined_quality_of_blocks",
    "SELECT {R(0.2 * (SELECT sum(i / m - (t / m) ** 2) FROM (SELECT a.set_id, sum(weight) AS t, coalesce(sum(weight) FILTER (a.set_id = b.set_id), 0) AS i, sum(sum(weight)) OVER () AS m FROM es JOIN sets a ON a.feature = src JOIN sets b ON b.feature = dst GROUP BY 1)) + 0.8 * (SELECT avg(r) FROM comp))R} AS quality",
    _BLOCKS,
    True,
    before=("es",),
)
query("network_of_features")(lambda s, d: net(emb_net(s, d)))
_oracle("network_of_features", "SELECT src, dst, {R(weight)R} AS weight FROM en", "en")

_EV = ", v0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS score FROM nodes)"
for _i in range(20):
    _EV += f", v{_i + 1} AS MATERIALIZED (SELECT node, score / sqrt(sum(score * score) OVER ()) AS score FROM (SELECT nodes.node, any_value(v{_i}.score) + coalesce(sum(weight * w.score), 0) AS score FROM nodes JOIN v{_i} ON v{_i}.node = nodes.node LEFT JOIN sy ON dst = nodes.node LEFT JOIN v{_i} w ON w.node = sy.src GROUP BY 1))"
ORACLES["eigenvector"] = sql("", "sy", "nodes").strip() + _EV + " SELECT node, round(score, 6) + 0.0 AS score FROM v20"
_RANKS = 60
_PC = ", v AS (SELECT node, (node = 'NATION_7')::INTEGER::DOUBLE AS v FROM nodes), st AS (SELECT src, sum(weight) AS t FROM sy GROUP BY 1), p AS MATERIALIZED (SELECT sy.src, dst, weight / t AS p FROM sy JOIN st USING (src)), r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / 25 AS score, 1e9::DOUBLE AS move FROM nodes)"
for _i in range(_RANKS):
    _PC += f", r{_i + 1} AS MATERIALIZED (SELECT node, new AS score, sum(abs(new - old)) OVER () AS move FROM (SELECT v.node, r{_i}.score AS old, 0.9 * coalesce(g, 0) + 0.1 * v AS new FROM v JOIN r{_i} ON r{_i}.node = v.node LEFT JOIN (SELECT dst, sum(p * score) AS g FROM p JOIN r{_i} ON src = node GROUP BY 1) ON dst = v.node))"
# rounds are looked at every fifth time; the first that has come to rest is the result
_PC += ", looks AS (" + " UNION ALL ".join(f"SELECT {_i} AS i, * FROM r{_i}" for _i in range(5, _RANKS + 1, 5)) + ")"
ORACLES["pagerank_converged"] = sql("", "sy", "nodes").strip() + _PC + " SELECT node, round(score, 6) + 0.0 AS score FROM looks WHERE i = (SELECT min(i) FROM looks WHERE move < 25e-6)"
