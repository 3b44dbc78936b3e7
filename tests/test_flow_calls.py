import random

import pytest
from pyspark.sql import functions as F

from genoflux.operators import calls as ca
from genoflux.operators import flow as fl
from genoflux.operators import report as rp
from genoflux.operators import similar as si


def check(nodes, arcs, flows, price, supply):
    net = dict(supply)
    for (t, h, lo, c, w), f in zip(arcs, flows):
        assert lo <= f <= c
        net[t] = net.get(t, 0) - f
        net[h] = net.get(h, 0) + f
        reduced = w + price[t] - price[h]
        assert not (reduced < 0 and f < c) and not (reduced > 0 and f > lo)
    assert not any(net.values())


def test_random_flows_are_feasible_and_optimal():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(2, 8)
        arcs = [(rng.randrange(n), rng.randrange(n), 0, rng.randint(0, 6), rng.randint(-9, 20)) for _ in range(rng.randint(1, 25))]
        check(n, arcs, *fl.min_cost_flow(n, arcs), {})


def test_supply_and_lower_bounds():
    arcs = [(0, 1, 1, 4, 2), (0, 2, 0, 8, 2), (1, 2, 0, 5, 1), (1, 3, 0, 10, 5), (2, 3, 0, 9, 1)]
    flows, price = fl.min_cost_flow(4, arcs, {0: 10, 3: -10})
    check(4, arcs, flows, price, {0: 10, 3: -10})
    with pytest.raises(ValueError):
        fl.min_cost_flow(2, [(0, 1, 0, 1, 0)], {0: 5, 1: -5})


def test_solve_and_verify(spark):
    rng = random.Random(6)
    rows = [(f"n{k % 3}", k, rng.randrange(6), rng.randrange(6), 0, rng.randint(1, 5), rng.randint(-5, 9)) for k in range(60)]
    d = fl.solve(spark.createDataFrame(rows, "net string, arc_id long, tail long, head long, low long, cap long, cost long"))
    assert d.count() == 60 and fl.violations(d).count() == 0
    each = d.withColumn("tail", F.concat("net", "tail")).withColumn("head", F.concat("net", "head"))
    assert fl.imbalance(each).where("net <> 0").count() == 0


def test_cost_rows(spark):
    a = spark.createDataFrame([(1, 5, 6, 10, 100, 0.08)], "arc_id long, from long, to long, hits long, len long, lam double")
    got = [tuple(r) for r in fl.cost_segments(a).orderBy("seq").select("dir", "low", "cap", "slope").collect()]
    want = [("fwd", 3, 4, 1123), ("fwd", 0, 1, 1768), ("fwd", 0, 1, 2176), ("fwd", 0, 1, 2458), ("fwd", 0, 1, 2664), ("fwd", 0, 1, 2822), ("fwd", 0, 1, 2946), ("fwd", 0, 1, 3046), ("fwd", 0, 1, 3129), ("fwd", 0, 2, 3229), ("fwd", 0, 99, 3461)]
    assert got[:11] == want
    assert got[11:] == [("rev", 0, 1, 54), ("rev", 0, 1, 2931), ("rev", 0, 1, 27967)]


def test_extraction():
    path = [(1, 0), (501, 1), (801, 2), (1201, 3), (1301, 4)]
    length = {0: 500, 1: 300, 2: 400, 3: 100, 4: 600}
    diff = {0: 0, 1: 2, 2: 1, 3: 0, 4: -1}
    got = ca.extract_runs(path, length, length, diff)
    assert [(g[0], g[1], g[2], g[3], g[5]) for g in got] == [(501, 1200, 1, 700, 700), (1301, 1900, -1, 600, 600), (501, 800, 1, 300, 0)]
    path, length, diff = [(1, 0), (201, 1), (401, 0), (601, 2)], {0: 200, 1: 200, 2: 300}, {0: 2, 1: 1, 2: 0}
    got = ca.extract_runs(path, length, length, diff)
    assert [(g[0], g[1], g[2], g[3], g[5]) for g in got] == [(1, 600, 1, 600, 400)]


def test_smoothing(spark):
    rows = [("chr1", 1000, 2999, 2), ("chr1", 2500, 3499, 1), ("chr1", 3600, 5599, 2), ("chr1", 5700, 6699, -1), ("chr1", 9000, 9400, -2)]
    got = ca.smooth([r[1:] for r in rows], 5)
    assert [g[:2] for g in got] == [(1000, 5599), (5700, 6699), (9000, 9400)]
    assert abs(got[0][2] - 2.221645747265) < 1e-9 and got[1][2] == -1
    d = spark.createDataFrame(rows, "chr string, start long, end long, call long")
    assert [tuple(r)[:3] for r in ca.smooth_calls(d).collect()] == [("chr1", 1000, 5599)]


def test_apportion_and_stats(spark):
    d = spark.createDataFrame([("c", p, 0, 7) for p in (1, 2, 3)], "contig string, pos long, edge_id long, flow long")
    assert [r.share for r in rp.apportion(d, ["contig"]).orderBy("pos").collect()] == [3, 2, 2]
    v = spark.createDataFrame([("g", x) for x in (2, 3, 5)], "g string, x long")
    assert rp.nscore(v, "g", "x", F.lit(10), 50).first()["nscore"] == 3


def test_stretches():
    a = "ACGT" * 50
    b = list(a)
    b[0] = "T"
    b[150] = "-"
    assert si.stretches(a, "".join(b)) == [(1, 149)]
    b[60] = b[61] = "N"
    assert si.stretches(a, "".join(b)) == []
    assert si.stretches("ACGT", "ACGT") == []


def test_self_loops(spark):
    a = spark.createDataFrame([(1, 5, 5, 30, 100), (2, 5, 6, 30, 100), (3, 6, 6, 0, 100), (4, -7, -7, 9, 0), (5, 8, 8, 25, 100)], "arc_id long, from long, to long, hits long, len long")
    assert sorted(tuple(r) for r in fl.self_loops(a, 10.0).collect()) == [(1, 6), (3, 2), (4, 2), (5, 6)]
    assert {r.flow for r in fl.self_loops(a, 0.0).collect()} == {2}


def test_many_nets_in_few_calls(spark):
    """A call for each of many small nets costs more than to solve them; nets and supplies of a call stay apart."""
    rows = [(f"n{k}", a, *x) for k in range(300) for a, x in enumerate([(1, 2, 0, 5, k % 3), (1, 2, 0, 5, 1), (2, 1, 0, 9, 0)])]
    arcs = spark.createDataFrame(rows, "net string, arc_id long, tail long, head long, low long, cap long, cost long")
    supply = spark.createDataFrame([(f"n{k}", v, x) for k in range(0, 300, 2) for v, x in ((1, k % 7), (2, -(k % 7)))], "net string, node long, excess long")
    solved = fl.solve(arcs, supply)
    assert "block" in solved._jdf.queryExecution().analyzed().toString()
    got = {(r.net, r.arc_id): r.flow for r in solved.collect()}
    for k in range(300):
        x = k % 7 if k % 2 == 0 else 0
        least = min(k % 3 * y + (x - y) for y in range(max(0, x - 5), min(5, x) + 1))
        assert sum(got[f"n{k}", a] * c for a, c in ((0, k % 3), (1, 1))) == least and got[f"n{k}", 0] + got[f"n{k}", 1] - got[f"n{k}", 2] == x
    assert len(got) == 900 and fl.violations(solved).count() == 0


def test_class_tied_to_itself_turned_round():
    from genoflux.operators import graph as gr

    turned = [(2, 10, 29, "+"), (2, 50, 69, "-")]
    assert gr.refine(turned) == [(0, 10, 29, "+"), (0, 50, 69, "-")]
    either = [(0, 10, 29, "+"), (0, 50, 69, "+")]
    assert gr.refine([*turned, (3, 10, 29, "+"), (3, 50, 69, "+")]) == either
    # found in one of two classes before they are joined
    more = [(5, 110, 129, "+"), (5, 150, 169, "-"), (6, 110, 129, "+"), (6, 150, 169, "+"), (7, 10, 29, "+"), (7, 110, 129, "-")]
    assert gr.refine([*turned, *more]) == [*either, (0, 110, 129, "+"), (0, 150, 169, "+")]
