"""Parallel Louvain against the exact kernel, whole rounds against modularity itself, and odd networks."""

from __future__ import annotations

import itertools
import random

import pytest

from plexmat.operators import community, louvain

EDGES = "src string, dst string, weight double"


def planted(groups: int, size: int, inside: float, outside: float, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    nodes = [f"g{g}n{i:02d}" for g in range(groups) for i in range(size)]
    return [(a, b, round(rng.uniform(0.5, 1.5), 3)) for a, b in itertools.combinations(nodes, 2) if rng.random() < (inside if a[:2] == b[:2] else outside)]


def modularity_of(edges: list[tuple], part: dict) -> float:
    m2 = sum(w if a == b else 2 * w for a, b, w in edges)
    inside = sum((w if a == b else 2 * w) for a, b, w in edges if part[a] == part[b])
    tot: dict = {}
    for a, b, w in edges:
        tot[part[a]] = tot.get(part[a], 0) + w
        if a != b:
            tot[part[b]] = tot.get(part[b], 0) + w
    return inside / m2 - sum((t / m2) ** 2 for t in tot.values())


def test_planted_groups_are_found_as_well_as_by_the_kernel(spark):
    edges = planted(6, 12, 0.6, 0.05, 3)
    frame = spark.createDataFrame(edges, EDGES)
    found = community.louvain(frame, [0, 1]).collect()
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    exact, _ = community.louvain_kernel(community.dense(frame.toPandas(), nodes), 0)
    best = modularity_of(edges, dict(zip(nodes, exact.tolist(), strict=True)))
    for seed in (0, 1):
        part = {r["node"]: r["community"] for r in found if r["seed"] == seed}
        assert sorted(part) == nodes and set(part.values()) == set(range(len(set(part.values()))))
        assert modularity_of(edges, part) > 0.99 * best


@pytest.mark.parametrize("many", [False, True])
def test_a_round_gains_at_least_what_is_sure(spark, many):
    edges = [*planted(4, 8, 0.5, 0.2, 5), ("g0n00", "g0n00", 3.0)]
    e, state = louvain.start(spark.createDataFrame(edges, EDGES), [0])
    m2 = e.agg({"weight": "sum"}).head()[0]
    part = {n: n for a, b, _ in edges for n in (a, b)}
    for r in range(3):
        want = louvain.written(louvain.wishes(e, state, m2, 0.0, str(r)), "w")
        go = louvain.accepted(e, want, m2, 0.0, many).collect()
        assert go if r == 0 else True
        for x in want.collect():  # each wish is the best single move there is
            alone = modularity_of(edges, {**part, x["node"]: x["to"]}) - modularity_of(edges, part)
            every = max(modularity_of(edges, {**part, x["node"]: c}) - modularity_of(edges, part) for c in set(part.values()))
            assert alone == pytest.approx(x["net"] * 2 / m2, abs=1e-9) and alone == pytest.approx(every, abs=1e-9)
        new = {**part, **{x["node"]: x["to"] for x in go}}
        assert modularity_of(edges, new) - modularity_of(edges, part) >= sum(x["sure"] for x in go) * 2 / m2 - 1e-9
        part = new
        k = {x["node"]: x["k"] for x in state.collect()}
        state = spark.createDataFrame([(0, n, c, k[n]) for n, c in part.items()], "seed int, node string, community string, k double")


def test_odd_networks(spark):
    none = spark.createDataFrame([], EDGES)
    assert community.louvain(none).count() == 0 and community.louvain_history(none).count() == 0
    loop = community.louvain(spark.createDataFrame([("a", "a", 2.0)], EDGES)).collect()
    assert [(r["node"], r["community"]) for r in loop] == [("a", 0)]
    pair = community.louvain(spark.createDataFrame([("a", "b", 1.0), ("a", "b", 1.0), ("c", "d", 1.0)], EDGES)).collect()
    part = {r["node"]: r["community"] for r in pair}
    assert part["a"] == part["b"] != part["c"] == part["d"]
    assert louvain.first_round(none).count() == 0
