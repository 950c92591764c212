"""Matrix and network operators on small literal cases, and invariants of the kernels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plexmat.functions import autodiff as ad
from plexmat.functions import special
from plexmat.operators import align, analyze, cca, clean, clinical, community, learn, phenotype, profile, select, similarity
from plexmat.plans import iterate
from plexmat.sources import frames

INF = float("inf")


def matrix(spark, **columns):
    names = list(columns)
    rows = [(f"s{i}", *[None if v is None else float(v) for v in r]) for i, r in enumerate(zip(*columns.values(), strict=True))]
    return frames.from_wide(spark.createDataFrame(rows, "sample_id string, " + ", ".join(f"{n} double" for n in names)), "sample_id")


def columns(long) -> dict:
    out: dict = {}
    for r in sorted(long.collect(), key=lambda r: (r["feature"], r["sample_id"])):
        out.setdefault(r["feature"], []).append(r["value"])
    return out


def target(spark, values):
    return spark.createDataFrame([(f"s{i}", float(v)) for i, v in enumerate(values)], "sample_id string, y double")


def test_profiles(spark):
    x = matrix(spark, A=[1, 3, 5], B=[2, 4, 6])
    assert profile.variance_summary(x, 5).head().asDict() == {"mean": 4, "median": 4, "min": 4, "max": 4, "std": 0, "n_low": 2}
    z = profile.zero_summary(matrix(spark, X=[0, 1, 2, 0], Y=[1] * 4, Z=[0] * 4), 0.5).head()
    assert (z["mean"], z["median"], z["min"], z["max"], z["std"], z["n_high"]) == (0.5, 0.5, 0, 1, 0.5, 1)
    m = profile.expression_summary(matrix(spark, P=[10, 20, 30], Q=[1, 1, 1], R=[0, 5, 0])).head()
    assert m["max"] == 20 and m["min"] == 1 and m["median"] == pytest.approx(5 / 3)
    c = profile.correlation_summary(matrix(spark, U=[1, 2, 3], V=[3, 2, 1], W=[1, 0, 1])).head()
    assert c["max"] == pytest.approx(1) and c["min"] == pytest.approx(0)
    assert profile.missing(matrix(spark, x=[1, None], y=[None, None]))["global"].head()["pct"] == 75


def test_cleaning(spark):
    assert set(columns(clean.sparse_filter(matrix(spark, dense=[1, 2, 3, 4], sparse=[None, None, None, 1]), 0.2))) == {"dense"}
    b = columns(clean.beta_to_m(matrix(spark, B1=[0.1, 0.5, 0.9], B2=[0, 1, 0.5])))
    assert b["B1"] == pytest.approx([-3.169925, 0, 3.169925], abs=1e-6) and None not in b["B2"]
    x = matrix(spark, C1=[1, 2, None, 4], C2=[10, None, 30, 40], C3=[5] * 4)
    assert columns(clean.impute_simple(x, "mean"))["C1"][2] == pytest.approx(7 / 3)
    assert columns(clean.impute_simple(x, "median"))["C2"][1] == 30
    assert columns(clean.impute_simple(x, "zero"))["C1"][2] == 0
    assert all(None not in v for v in columns(clean.impute_knn(x, 2)).values())
    with pytest.raises(ValueError):
        clean.impute_simple(x, "other")
    with pytest.raises(ValueError):
        clean.normalize(x, "other")
    y = columns(clean.clean_inf(matrix(spark, x=[1, INF, 3, -INF], y=[None, 2, None, 4], z=[5] * 4)))
    assert set(y) == {"x", "y"} and all(v is not None and abs(v) < INF for c in y.values() for v in c)
    assert set(columns(clean.clean_internal(matrix(spark, dense=[1, 2, 3, 4], sparse=[None, None, None, 1], const=[1] * 4), 0.5))) == {"dense"}
    s = columns(clean.normalize(matrix(spark, A=[1, 3, 5], K=[2, 2, 2]), "standard"))
    assert sum(s["A"]) == pytest.approx(0) and s["K"] == [0, 0, 0]


def test_clinical(spark):
    df = spark.createDataFrame([("a", "low", 1.0, "x"), ("b", "High ", 2.0, "y"), ("c", "low", 3.0, None), ("d", "medium", 4.0, "x")], "sample_id string, grade string, score double, site string")
    out = clinical.preprocess(df, ordinal_maps={"grade": {"low": 0, "medium": 1, "high": 2}}, drop=["none"])
    assert {"grade", "score", "site_y", "site_nan"} == set(out.columns) - {"sample_id"}
    assert [r["grade"] for r in out.orderBy("sample_id").collect()] == [0, 2, 0, 1]


def test_selection(spark):
    x = matrix(spark, high=[1, 10, 100, 1000], low=[1, 1.1, 1, 1.1], zero=[5] * 4)
    assert [r["feature"] for r in select.variance_top(x, 2).collect()] == ["high", "low"]
    y = target(spark, [1, 2, 3, 4])
    assert select.correlation_top(x, y, 1).head()["feature"] == "high"
    with pytest.raises(ValueError):
        select.f_top(x, y, 1, task="other")
    # with 2 and n degrees of freedom the tail is (1 + 2 f / n) ** (-n / 2)
    assert special.f_tail(4.0, 2, 10) == pytest.approx(1.8**-5)
    t = np.linspace(0.5 * math.sqrt(18 / 0.75), 400, 2_000_001)  # Student's density with 18 degrees, integrated
    density = math.gamma(9.5) / (math.sqrt(18 * math.pi) * math.gamma(9)) * (1 + t * t / 18) ** -9.5
    assert special.pearson_tail(0.5, 20) == pytest.approx(2 * np.trapezoid(density, t), abs=1e-6)


def test_networks_invariants(spark):
    rng = np.random.default_rng(0)
    x = matrix(spark, **{f"n{i}": rng.random(12).tolist() for i in range(6)})
    for build in similarity.BUILDERS.values():
        sums: dict = {}
        for r in build(x, k=3).collect():
            assert r["weight"] >= 0
            sums[r["src"]] = sums.get(r["src"], 0) + r["weight"]
        assert all(abs(v - 1) < 1e-5 for v in sums.values())
        with pytest.raises(TypeError):
            build([1, 2])
    with pytest.raises(ValueError):
        similarity.correlation_network(x, k=None, threshold=0.5)


def net(spark, *edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src string, dst string, weight double")


def test_network_filters_and_statistics(spark):
    one = [("n1", "n2", 0.8), ("n1", "n3", 0.2), ("n2", "n3", 0.5), ("n2", "n4", 0.1), ("n3", "n4", 0.9)]
    e = net(spark, *one, *[(b, a, w) for a, b, w in one])
    nodes = spark.createDataFrame([(f"n{i}", i, "m") for i in range(1, 5)], "node string, npos int, modality string")
    b = analyze.basic(e, nodes, 0.3).head()
    assert (b["nodes"], b["edges"], b["max_degree"]) == (4, 3, 2)
    assert sum(r["pct"] for r in analyze.degree_distribution(e, nodes, 0.3).collect()) == pytest.approx(100)
    w = [r["weight"] for r in analyze.strongest_edges(e, nodes, 3).collect()]
    assert w == [0.9, 0.8, 0.5]
    assert analyze.components(e, nodes, 0.85).select("component").distinct().count() == 3
    assert clean.prune(net(spark, ("a", "b", 0.2), ("a", "a", 1)), 0.5).count() == 1
    assert clean.prune_quantile(clean.undirected(e), 0.5).count() == 3
    c = {r["node"]: r["coefficient"] for r in analyze.clustering(e, nodes, 0.0).collect()}
    assert c["n1"] == 1 and c["n2"] == pytest.approx(2 / 3)


def test_communities(spark):
    one = [(f"a{i}", f"a{j}", 1) for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}", 1) for i in range(5) for j in range(i)] + [("a0", "b0", 0.1)]
    e = net(spark, *one)
    parts = {r["node"]: r["community"] for r in community.louvain(e).collect()}
    assert len({parts[f"a{i}"] for i in range(5)}) == 1 and parts["a0"] != parts["b0"]
    p = spark.createDataFrame(list(parts.items()), "node string, community long")
    q = community.modularity(e, p).head()["modularity"]
    assert 0.4 < q < 0.5
    assert community.conductance(e, p.where(F.col("community") == parts["a0"])).head()["conductance"] == pytest.approx(0.1 / 20.1)
    rank = community.pagerank(e, spark.createDataFrame([("a1", 1.0)], "node string, weight double"))
    score = {r["node"]: r["score"] for r in rank.collect()}
    assert sum(score.values()) == pytest.approx(1, abs=1e-6) and score["a1"] > score["b1"]
    kernel = community.pagerank_kernel(community.dense(e.toPandas(), sorted(parts)), np.eye(10)[1], 0.10)
    assert [score[n] for n in sorted(parts)] == pytest.approx(kernel.tolist(), abs=1e-4)
    with pytest.raises(ValueError):
        community.correlated_louvain(e, None, None, 2.0)
    with pytest.raises(ValueError):
        community.correlated_pagerank(e, None, None, [])


def test_phenotype(spark):
    r = phenotype.omics_correlation(matrix(spark, g1=[1, 2, 3, 4], g2=[2, 4, 6, 8]), target(spark, [10, 20, 30, 40])).head()
    assert r["r"] == pytest.approx(1)
    with pytest.raises(ValueError):
        phenotype.omics_correlation(matrix(spark, g1=[1, 2], g2=[1, 3]), target(spark, []))
    assert phenotype.cluster_correlation(matrix(spark, a=[1, 2, 3]), target(spark, [1, 2, 3]), ["a"]).head()["r"] is None
    assert phenotype.cluster_correlation(matrix(spark, a=[1, 1, 1], b=[2, 2, 2]), target(spark, [1, 2, 3]), ["a", "b"]).head()["r"] is None


def test_canonical_correlation(spark):
    v = np.array([3.0, -2.0, 0.5, 0.1])
    lam = cca.threshold_for(v, 1.2)
    s = cca.soft(v, lam)
    assert np.abs(s / cca.l2n(s)).sum() == pytest.approx(1.2, abs=1e-3) and cca.l2n(np.zeros(3)) == 0.05
    assert cca.recycled_sum(np.array([1.0, 2.0]), np.array([1.0])) == 3 and cca.recycled_sum(np.array([]), v) == 0
    rng = np.random.default_rng(4)
    shared = rng.normal(size=60)
    xs = [np.column_stack([shared + 0.1 * rng.normal(size=60), rng.normal(size=(60, 5))]) for _ in range(2)]
    ws = cca.canonical_weights(xs, [0.5, 0.5], shared)
    assert all(np.abs(w).argmax() == 0 for w in ws)
    with pytest.raises(ValueError):
        cca.canonical_weights(xs, [0.0, 0.5])
    weights = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.5), (2, 1, 1.0), (3, 1, 1.0)], "fpos int, subsample int, w double")
    sim = cca.similarity(weights)
    assert {(r["a"], r["b"]): r["s"] for r in sim.collect()} == {(0, 1): 0.5, (1, 0): 0.5, (2, 3): 1.0, (3, 2): 1.0}
    mods = {}
    for r in cca.modules(sim).collect():
        mods.setdefault(r["module"], set()).add(r["fpos"])
    assert sorted(map(sorted, mods.values())) == [[0, 1], [2, 3]]


def test_gradients():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(6, 3)), rng.normal(size=6)
    src, dst = np.array([0, 1, 2, 3, 4, 5, 0]), np.array([1, 2, 3, 4, 5, 0, 0])
    w = rng.random(7)
    for kind in ("GCN", "GAT", "SAGE", "GIN"):
        g = learn.GraphNet(kind, 3, 4, 3, 0.0, "elu", heads=2)
        loss = lambda g=g: ad.mse(g.head(g.embed(x, src, dst, w)), y[:, None])
        out = loss()
        out.backward()
        for p in g.params:
            at = np.unravel_index(p.value.size // 2, p.value.shape)
            given, keep, h = p.grad[at], p.value[at], 1e-6
            p.value[at] = keep + h
            up = float(loss().value)
            p.value[at] = keep - h
            down = float(loss().value)
            p.value[at] = keep
            assert given == pytest.approx((up - down) / (2 * h), abs=1e-5)
    with pytest.raises(ValueError):
        learn.GraphNet("other", 3, 4)
    with pytest.raises(ValueError):
        ad.activation("other")


def test_representation_and_outcome(spark):
    rng = np.random.default_rng(1)
    y = np.arange(40) % 2
    x = matrix(spark, **{f"n{i}": (rng.normal(size=40) + (2 * y if i < 3 else 0)).tolist() for i in range(6)})
    e = net(spark, *[(f"n{i}", f"n{j}", 0.5) for i in range(6) for j in range(i)])
    emb = spark.createDataFrame([(f"n{i}", rng.normal(size=4).tolist()) for i in range(6)], "feature string, embedding array<double>")
    out = learn.represent(x, emb, "PCA")
    assert out.count() == x.count() and out.columns == ["sample_id", "fpos", "feature", "value"]
    with pytest.raises(ValueError):
        learn.reduce_embeddings(emb, method="other")
    scores = learn.predict(e, x, target(spark, y.tolist()), epochs=40, k=2)
    m = learn.metrics(scores, ["fold"]).agg(F.avg("accuracy")).head()[0]
    assert scores.count() == 80 and m > 0.7
    assert not math.isnan(learn.summary(learn.metrics(scores, ["fold"]), ["fold"]).where("metric = 'auc'").head()["average"])


def test_loaders(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        frames.load(spark, "nowhere", "/root/testdata/sf0.001")
    assert frames.load(spark, " Embeddings ", "/root/testdata/sf0.001").shape["target"] == (500, 2)
    (tmp_path / "a.csv").write_text("id,f,g\ns1,1.5,\ns2,2,3\n")
    raw = frames.read_csv(spark, str(tmp_path / "a.csv"))
    assert raw.columns[0] == "sample_id" and columns(frames.from_wide(raw, "sample_id")) == {"f": [1.5, 2.0], "g": [None, 3.0]}
    assert frames.read_csv(spark, str(tmp_path / "a.csv"), index=False).count() == 2


def test_blocks_of_features_equal_one_block(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = matrix(spark, **{f"f{i:02d}": rng.normal(size=30).round(3).tolist() if i != 7 else [1.0] * 30 for i in range(37)})
    key = lambda df: sorted((r["src"], r["dst"], round(r["weight"], 9)) for r in df.collect())
    calls = [
        lambda: similarity.similarity_network(x, k=4),
        lambda: similarity.correlation_network(x, k=4),
        lambda: similarity.correlation_network(x, k=4, signed_map=False, method="spearman", mutual_only=True),
        lambda: similarity.threshold_network(x, b=2.0, k=3),
        lambda: similarity.correlation_network(x, k=None),
    ]
    whole = [key(c()) for c in calls]
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "CELLS", 480)
    monkeypatch.setattr(similarity, "NARROW", 16)
    assert [key(c()) for c in calls] == whole
    monkeypatch.setattr(similarity, "NARROW", 20)  # wider than all samples leave room for: they are cut into parts
    monkeypatch.setattr(similarity, "MERGED", 2)
    assert [key(c()) for c in calls[:1]] == whole[:1]


def test_thresholds_against_bisection():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 40):
        for size in (1.0, 1.3, 2.0, 5.0):
            v = rng.normal(size=n)
            if n > 3:
                v[:2] = 3.0  # ties at the top
            d = cca.threshold_for(v, size)
            norm = lambda t, v=v: np.abs(cca.soft(v, t)).sum() / max(np.linalg.norm(cca.soft(v, t)), 1e-12)
            if d == 0:
                assert norm(0.0) <= size + 1e-9
            elif size**2 >= (np.abs(v) >= np.abs(v).max() - 1e-12).sum():
                assert norm(d) == pytest.approx(size, abs=1e-6)


def test_running_places(spark):
    df = spark.createDataFrame([(k, i) for k in (0, 1, None) for i in range(40)], "k int, i int")
    got = iterate.placed(df, ["k"], F.floor(F.col("i") / 7), ["i"]).collect()
    assert len(got) == 120 and all(r["_place"] == r["i"] for r in got)
    assert sorted(r["_place"] for r in iterate.placed(df, [], F.floor(F.col("i") / 7), ["i", "k"]).collect()) == list(range(120))


def test_runs_share_or_shuffle_the_same_table(spark, monkeypatch):
    data = spark.createDataFrame([(i, float(i)) for i in range(10)], "i int, v double")
    runs = spark.createDataFrame([(0, [1.0]), (1, [2.0, 3.0])], "run int, p array<double>")
    kernel = lambda key, p: pd.DataFrame({"run": [key[0]], "s": [p["v"].sum() * sum(p["p"].iloc[0])]})
    shared = sorted(map(tuple, iterate.per_run(data, runs, ["run"], kernel, "run int, s double").collect()))
    monkeypatch.setattr(iterate, "SHARED_CELLS", 1)
    assert shared == sorted(map(tuple, iterate.per_run(data, runs, ["run"], kernel, "run int, s double").collect())) == [(0, 45.0), (1, 225.0)]


def test_alignment(spark):
    a, b, c = (spark.createDataFrame([(i,) for i in ids], "sample_id string") for ids in (["1", "2", "3", None], ["2", "3", "3"], ["3", "2", None]))
    assert sorted(r[0] for r in align.common(a, b, c).collect()) == ["2", "3"]
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "key string, v int")
    names = spark.createDataFrame([("a", "late", 2), ("a", "first", 1), ("b", None, 1), ("c", "other", 1)], "key string, name string, o int")
    assert [(r["key"], r["name"]) for r in align.map_keys(rows, names, "key", "name", ["o"]).collect()] == [("a", "first")]
    e, x = net(spark, ("p", "q", 1.0), ("q", "r", 1.0)), matrix(spark, p=[1, 2], q=[3, 4], s=[5, 6])
    edges, kept = align.network_and_matrix(e, x)
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [("p", "q")] and set(columns(kept)) == {"p", "q"}
    with pytest.raises(ValueError):
        align.network_and_matrix(e, x, strict=True)
    assert {r["sample_id"]: r["y"] for r in align.labels_of(spark, {"s": 1, "t": 0}).collect()} == {"s": 1.0, "t": 0.0}


def test_evaluation_and_search(spark):
    rng = np.random.default_rng(7)
    y = np.arange(48) % 2
    x = matrix(spark, **{f"n{i}": (rng.normal(size=48) + (2 * y if i < 3 else 0)).tolist() for i in range(6)})
    e, t = net(spark, *[(f"n{i}", f"n{j}", 0.5) for i in range(6) for j in range(i)]), target(spark, y.tolist())
    got = learn.evaluate(e, x, t, share=0.25, repeats=3, epochs=30)
    assert got["scores"].count() == 3 * 12 * 2 and got["runs"].count() == 3 and got["runs"].where("best").count() == 1
    assert {r["metric"] for r in got["summary"].collect()} >= {"accuracy", "f1_macro", "auc", "aupr"}
    tuned = learn.tune_outcome(e, x, t, k=2, inner=2, settings=[{"epochs": 1, "rate": 1e-6}, {"epochs": 40}])
    assert [r["trial"] for r in tuned["chosen"].collect()] == [1, 1] and tuned["runs"].count() == 2
    with pytest.raises(ValueError):
        learn.predict(e, x, t, unknown=1)
    settings = [{"method": "correlation", "k": 2}, {"method": "correlation", "k": 2, "threshold": "bad", "other": 1}]
    found = learn.network_search(x, t, settings)
    assert [r["config"] for r in found.collect()] == [0]
    edges, best = learn.best_network(x, settings, found)
    assert edges.count() == 12 and best == settings[0]
    with pytest.raises(RuntimeError):
        learn.network_search(x, t, settings[1:])
    assert len(learn.parameter_grid(["gaussian", "similarity", "correlation", "threshold"])) == 400 + 100 + 50 + 650
    emb = spark.createDataFrame([(f"n{i}", rng.normal(size=4).tolist()) for i in range(6)], "feature string, embedding array<double>")
    tried = learn.tune_representation(x, emb, t, trials=3, epochs=5).collect()
    assert len(tried) == 3 and all(0 <= r["score"] <= 1 for r in tried)
    w = cca.discriminant_weights(x, t, subsamples=5).collect()
    assert w and all(r["w"] > 0 for r in w)
