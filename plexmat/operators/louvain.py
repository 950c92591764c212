"""Louvain on edge lists: every node looks at once, and moves that are sure to pay together are made together.

A round joins the edges to the communities of their ends, sums them by (node, community) and takes each node's best
community by `max_by`. The nodes that want to move are ordered by a hash of the round. Were they to move one after another in that order,
a node's gain could only fall by what earlier ones do: neighbours that leave the community it goes to or join the one it leaves (edges),
and strength that joins the one or leaves the other (running sums). A node moves if its gain is above that loss, so what is accepted raises
modularity move by move, the first of the order always among it, however many nodes move and whether or not they are neighbours. When a level
has come to rest its communities become nodes (`contract`), edges inside them loops.

Several runs (seeds) go through the same jobs, told apart by a column. Nothing but a few numbers a round reaches the driver. Tables of a round are
written to the checkpoint folder, so joins know their sizes. Isolated nodes (without edges) are not in the table. Sums of weights in another order may
decide ties differently, beyond the 12th digit that is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexmat.plans.iterate import placed, written

#: Candidates of a round from which running sums go over buckets instead of whole communities.
MANY = 1 << 20


def _order(node: str, salt: str) -> Column:
    return F.md5(F.concat_ws(":", node, F.col("seed").cast("string"), F.lit(salt)).cast("binary"))


def start(edges: DataFrame, seeds: list[int]) -> tuple[DataFrame, DataFrame]:
    """Edges of every run in both directions, loops once (seed, src, dst, weight), and each node as a community of its own (seed, node, community, k)."""
    runs = F.explode(F.lit(seeds).cast("array<int>")).alias("seed")
    ways = edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    e = edges.select("src", "dst", "weight").unionByName(ways).groupBy("src", "dst").agg(F.sum("weight").alias("weight")).select(runs, "src", "dst", "weight")
    return e, alone(e)


def alone(e: DataFrame) -> DataFrame:
    return e.groupBy("seed", F.col("src").alias("node")).agg(F.sum("weight").alias("k")).select("seed", "node", F.col("node").alias("community"), "k")


def wishes(e: DataFrame, state: DataFrame, m2: float, least: float, salt: str = "") -> DataFrame:
    """Nodes with a better community: (seed, node, community, to, k, net, turn); net is the gain in modularity times m2 / 2."""
    at = state.join(state.groupBy("seed", "community").agg(F.sum("k").alias("tot")), ["seed", "community"])
    there = at.select("seed", F.col("node").alias("dst"), F.col("community").alias("c"), "tot")
    links = e.where("src <> dst").join(there, ["seed", "dst"]).groupBy("seed", F.col("src").alias("node"), "c").agg(F.sum("weight").alias("w"), F.max("tot").alias("tot"))
    here = at.select("seed", "node", "community", "k", F.col("tot").alias("own_tot"))
    # what a community offers does not depend on the one that is left
    offer = F.round(F.col("w") - F.col("k") * F.col("tot") / m2, 12)
    other = F.col("c") != F.col("community")
    best = links.join(here, ["seed", "node"]).groupBy("seed", "node", "community", "k", "own_tot").agg(F.sum(F.when(~other, F.col("w"))).alias("w0"), F.max(F.when(other, F.struct(offer.alias("offer"), "c"))).alias("best"))
    net = F.col("best")["offer"] - F.coalesce("w0", F.lit(0.0)) + F.col("k") * (F.col("own_tot") - F.col("k")) / m2
    return best.where("best is not null").select("seed", "node", "community", F.col("best")["c"].alias("to"), "k", net.alias("net"), _order("node", salt).alias("turn")).where(F.col("net") > least)


def _before(want: DataFrame, key: str, out: str, many: bool) -> DataFrame:
    """Adds the strength of the nodes with the same key whose turn is earlier."""
    if many:
        return placed(want, ["seed", key], F.substring("turn", 1, 3), [F.col("turn")], F.col("k"), out)
    earlier = Window.partitionBy("seed", key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return want.withColumn(out, F.coalesce(F.sum("k").over(earlier), F.lit(0.0)))


def accepted(e: DataFrame, want: DataFrame, m2: float, least: float, many: bool = False) -> DataFrame:
    """Of the wishes those that pay whatever earlier ones do: (seed, node, to, sure), sure being the least gain in net."""
    mine = want.select("seed", F.col("node").alias("src"), F.col("community").alias("a"), F.col("to").alias("b"), "turn")
    theirs = want.select("seed", F.col("node").alias("dst"), F.col("community").alias("a2"), F.col("to").alias("b2"), F.col("turn").alias("turn2"))
    near = e.where("src <> dst").join(mine, ["seed", "src"]).join(theirs, ["seed", "dst"]).where("turn2 < turn and (a2 = b or b2 = a)")
    loss = near.groupBy("seed", F.col("src").alias("node")).agg(F.sum("weight").alias("lost"))
    ranked = _before(_before(want, "to", "joined", many), "community", "left", many)
    sure = F.col("net") - F.coalesce("lost", F.lit(0.0)) - F.col("k") * (F.col("joined") + F.col("left")) / m2
    return ranked.join(loss, ["seed", "node"], "left").select("seed", "node", "to", sure.alias("sure")).where(F.col("sure") > least)


def contract(e: DataFrame, state: DataFrame) -> DataFrame:
    """The network of communities; what lies inside one is a loop of twice its weight."""
    c = state.select("seed", "node", "community")
    both = e.join(c.select("seed", F.col("node").alias("src"), F.col("community").alias("s")), ["seed", "src"]).join(c.select("seed", F.col("node").alias("dst"), F.col("community").alias("d")), ["seed", "dst"])
    return both.groupBy("seed", F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("weight").alias("weight"))


def parallel(edges: DataFrame, seeds: list[int], max_rounds: int = 100, min_delta: float = 1e-10, tol: float = 1e-3, max_levels: int = 50) -> tuple[DataFrame, list[dict]]:
    """(seed, node, community) with communities named by one of their nodes, and what each level did.

    A level ends when a round gains less than tol of modularity (over all seeds) or max_rounds have run, the whole when a
    level moves nothing. min_delta is the least gain of a single move.
    """
    e, state = start(edges, seeds)
    e = written(e, "edges")
    state = written(state, "nodes")
    names = state.select("seed", "node", F.col("node").alias("top"))
    m2 = (e.where(F.col("seed") == seeds[0]).agg(F.sum("weight")).head()[0] or 0.0) if seeds else 0.0
    least, history = min_delta * m2 / 2, []
    for level in range(max_levels if m2 > 0 else 0):
        moves = {s: 0 for s in seeds}
        size = {r["seed"]: r["n"] for r in state.groupBy("seed").agg(F.count("*").alias("n")).collect()}
        for r in range(max_rounds):
            want = written(wishes(e, state, m2, least, f"{level}.{r}"), "wishes")
            n = want.count()
            if not n:
                break
            go = accepted(e, want, m2, least, n > MANY)
            moved = state.join(go, ["seed", "node"], "left")
            state = written(moved.select("seed", "node", F.coalesce("to", "community").alias("community"), "k", "sure"), "nodes")
            done = state.groupBy("seed").agg(F.count("sure").alias("n"), F.sum("sure").alias("gain")).collect()
            state = state.drop("sure")
            for x in done:
                moves[x["seed"]] += x["n"]
            if sum(x["gain"] or 0.0 for x in done) * 2 / m2 < tol:
                break
        left = {x["seed"]: x["n"] for x in state.groupBy("seed").agg(F.count_distinct("community").alias("n")).collect()}
        history += [{"seed": s, "level": level, "nodes_at_level": size.get(s, 0), "moves": moves[s], "communities": left.get(s, 0)} for s in seeds]
        if not any(moves.values()):
            break
        names = written(names.join(state.select("seed", F.col("node").alias("top"), "community"), ["seed", "top"]).select("seed", "node", F.col("community").alias("top")), "names")
        if all(left[s] == 1 for s in left):
            break
        e = written(contract(e, state), "edges")
        state = written(alone(e), "nodes")
    return names.withColumnRenamed("top", "community"), history


def numbered(found: DataFrame) -> DataFrame:
    """Communities by number instead of name: (seed, node, community long), 0 to the number of communities less one in each run."""
    own = found.select("seed", "community").distinct().withColumn("_h", F.md5(F.col("community").cast("binary")))
    place = placed(own, ["seed"], F.substring("_h", 1, 3), [F.col("_h"), F.col("community")], out="_n").select("seed", "community", "_n")
    return found.join(place, ["seed", "community"]).select("seed", "node", F.col("_n").alias("community"))


def first_round(edges: DataFrame, seed: int = 0, min_delta: float = 1e-10) -> DataFrame:
    """What the nodes of a network, each alone, wish and are granted: (node, to, gain, sure, goes), in modularity."""
    e, _ = start(edges, [seed])
    e = written(e, "louvain-edges")  # what the edges come from may be far larger than they are
    state = alone(e)
    m2 = e.agg(F.sum("weight")).head()[0] or 0.0
    if not m2 > 0:
        return state.select("node", F.col("community").alias("to"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("sure"), F.lit(False).alias("goes")).where(F.lit(False))
    want = written(wishes(e, state, m2, min_delta * m2 / 2, "0.0"), "wishes")
    go = accepted(e, want, m2, float("-inf")).select("seed", "node", "sure")
    per = 2 / m2
    return want.join(go, ["seed", "node"]).select("node", "to", (F.col("net") * per).alias("gain"), (F.col("sure") * per).alias("sure"), (F.col("sure") > min_delta * m2 / 2).alias("goes"))
