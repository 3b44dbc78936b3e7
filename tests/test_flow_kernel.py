import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoflux.operators import flow as fl
from genoflux.operators.flow_kernel import Convex, in_series, solve_network, solve_networks, spread

#: A published small problem: 6 nodes, supply of 10 at node 1, demand at node 6; its least cost is 70.
SAMPLE = [(1, 2, 0, 4, 1), (1, 3, 0, 8, 5), (2, 3, 0, 5, 0), (3, 5, 0, 10, 1), (5, 4, 0, 8, 0), (5, 6, 0, 8, 9), (4, 2, 0, 8, 1), (4, 6, 0, 8, 1)]


def proof(nodes, arcs, supply, flow, price):
    """The cost, if flows keep bounds and supplies and prices prove them."""
    net = [0] * nodes
    for (t, h, low, cap, cost), f in zip(arcs, flow):
        assert low <= f <= cap
        reduced = cost + price[t] - price[h]
        assert (f == cap or reduced >= 0) and (f == low or reduced <= 0)
        net[t] += f
        net[h] -= f
    assert net == [supply.get(v, 0) for v in range(nodes)]
    return sum(a[4] * f for a, f in zip(arcs, flow))


def random_network(rng):
    """Chains and rings between a few forks, arcs both ways and several between two nodes, dead ends, loops."""
    forks = rng.randint(0, 5)
    nodes, arcs = max(forks, 1), []

    def bundle(u, v):
        for _ in range(rng.randint(1, 4)):
            low = rng.choice([0, 0, 0, 1])
            arcs.append((*rng.choice([(u, v), (u, v), (v, u)]), 0 if rng.random() < 0.8 else low, low + rng.randint(0, 6), rng.randint(-9, 9)))

    for _ in range(rng.randint(1, 8)):
        u, v = rng.randrange(nodes), rng.randrange(nodes)
        for _ in range(rng.randint(0, 4)):
            bundle(u, nodes)
            u, nodes = nodes, nodes + 1
        if rng.random() < 0.8:
            bundle(u, v)
    supply = {}
    if rng.random() < 0.5 and nodes > 1:
        u, v = rng.sample(range(nodes), 2)
        supply = {u: 2, v: -2}
    return nodes, arcs, supply


def test_random_networks():
    rng, solved = random.Random(1), 0
    for _ in range(3000):
        nodes, arcs, supply = random_network(rng)
        try:
            want = proof(nodes, arcs, supply, *fl.min_cost_flow(nodes, arcs, supply))
        except ValueError:
            with pytest.raises(ValueError):
                solve_network(nodes, arcs, supply, fl.min_cost_flow)
            continue
        assert proof(nodes, arcs, supply, *solve_network(nodes, arcs, supply, fl.min_cost_flow)) == want
        solved += 1
    assert solved > 800


def test_convex_costs():
    f = Convex.of([(5, 2), (-1, 3), (0, 1)], -2)
    assert f.pieces() == [(-2, 1, -1), (1, 2, 0), (2, 4, 5)] and f.least() == 1 and f.slopes(1) == (-1, 0) and f.slopes(0) == (-1, -1)
    assert f.flipped().pieces() == [(-4, -2, -5), (-2, -1, 0), (-1, 2, 1)]
    assert in_series([f, f.flipped()]).pieces() == [(-2, -1, -1), (-1, 1, 0), (1, 2, 1)]
    with pytest.raises(ValueError):
        in_series([f, Convex(9, 10, 0, {})])
    assert sum(spread(7, [(0, 3), (-1 << 60, 2), (1, 1 << 60)])) == 7


def test_sample_problem(spark):
    arcs = spark.createDataFrame([("s", i, *a) for i, a in enumerate(SAMPLE)], "net string, arc_id long, tail long, head long, low long, cap long, cost long")
    supply = spark.createDataFrame([("s", 1, 10), ("s", 6, -10)], "net string, node long, excess long")
    for at_once in (0, 200_000):
        s = fl.solve(arcs, supply, at_once).cache()
        assert fl.objective(s).first()[0] == 70 and fl.violations(s).count() == 0
        assert {(r.node, r.net) for r in fl.imbalance(s).where("net <> 0").collect()} == {(1, -10), (6, 10)}


def test_long_chain_with_links(spark):
    """A million arcs: convex costs of 50,000 edges in a row, a closing arc, links over some of them, both images."""
    n, lines = 50_000, 8
    edges = spark.range(n).select(
        F.col("id").alias("arc_id"), (F.col("id") + 1).alias("from"), (F.col("id") + 2).alias("to"), (F.pmod(F.xxhash64("id"), F.lit(7)) * 10 + F.when(F.floor(F.col("id") / 500) % 9 == 4, 60).otherwise(20)).alias("hits"), F.lit(100).alias("len"), F.lit(0.4).alias("lam")
    )
    links = spark.range(n // 500).where("id % 9 = 4").select((F.col("id") + n).alias("arc_id"), (F.col("id") * 500 + 501).alias("from"), (F.col("id") * 500 + 1).alias("to"), F.lit(0).cast("long").alias("hits"), F.lit(0).alias("len"), F.lit(0.0).alias("lam"))
    closing = spark.range(1).select(F.lit(2 * n).cast("long").alias("arc_id"), F.lit(n + 1).cast("long").alias("from"), F.lit(1).cast("long").alias("to"), F.lit(0).cast("long").alias("hits"), F.lit(-1).alias("len"), F.lit(0.0).alias("lam"))
    arcs = fl.network_arcs(edges.unionByName(links).unionByName(closing), n + 1, lines=lines).cache()
    began = time.time()
    assert arcs.count() > 1_000_000
    s = fl.solve(arcs).cache()
    assert s.count() == arcs.count() and fl.violations(s).count() == 0 and fl.imbalance(s).where("net <> 0").count() == 0
    got = {r.arc_id: r.flow for r in fl.solved_copies(s).collect()}
    assert got[2 * n] == 2 and all(got[n + i] > 0 for i in range(n // 500) if i % 9 == 4) and time.time() - began < 300


def test_many_networks_at_once():
    """Networks that are bundled together have the flows and prices that each has by itself, whatever stands beside it."""
    rng, each = random.Random(2), []
    while len(each) < 300:
        nodes, arcs, supply = random_network(rng)
        try:
            each.append((nodes, arcs, supply, *solve_network(nodes, arcs, supply, fl.min_cost_flow)))
        except ValueError:
            continue
    first = np.cumsum([0, *(len(x[1]) for x in each)])
    columns = tuple(np.array([a[c] for x in each for a in x[1]], np.int64) for c in range(5))
    flows, prices = solve_networks([x[0] for x in each], first, columns, [x[2] for x in each], fl.min_cost_flow)
    assert flows == [f for x in each for f in x[3]] and [dict(enumerate(p)) for p in prices] == [x[4] for x in each]
    assert any(not x[1] for x in each) and all(proof(n, a, s, flows[i:j], dict(enumerate(p))) is not None for (n, a, s, *_), i, j, p in zip(each, first, first[1:], prices))
