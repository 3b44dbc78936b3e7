"""Copy counts as a minimum-cost circulation: convex costs, doubled network, solver and verifiers."""

from __future__ import annotations

import heapq
import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoflux.shipping import ship

from .components import SHARES, components
from .flow_kernel import solve_networks

#: Cost of no flow at all.
NEVER = 999_999_999
#: Capacity of the last segment, and how far beyond its start its slope is taken.
LAST_CAP, LAST_SPAN = 99, 10
#: Capacity of arcs that cost one for each unit, and of the arcs of nodes.
FREE_CAP = 99_999


def half_up(x: Column) -> Column:
    return (x + 0.5).cast("bigint")


def nearly_ceil(x: Column) -> Column:
    return (x + 0.9999).cast("bigint")


def cost_at(x: Column, k: Column, lam: Column) -> Column:
    """Negative log-likelihood of x copies, up to a constant."""
    return F.when(x == 0, F.lit(float(NEVER))).otherwise(-k * F.ln(x) + lam * x)


def cost_segments(arcs: DataFrame, baseflow: int = 2, lines: int = 10, allow_none: int = 20, free_length: int = 0) -> DataFrame:
    """(arc_id, from, to, seq, dir, low, cap, slope): convex cost of each arc (hits, len, lam) as unit segments around its best flow.

    Forward: a first segment that the flow must fill up to the best count, unit segments, one of two, one of LAST_CAP. Back: units down
    to one copy, one of at most ten, and, with allow_none, the step to (nearly) none. seq orders an arc's segments. Arcs up to free_length
    long, or without expected depth, cost one per unit up to FREE_CAP. The closing arc, of negative length and without hits, must carry baseflow at no cost.
    """
    d = arcs.withColumn("l", F.col("lam") * F.col("len") / baseflow).withColumn("k", F.col("hits").cast("double"))
    closing = (F.col("len") < 0) & (F.col("k") == 0)
    free = (F.col("len") <= free_length) | (F.col("l") <= 0)
    whole = lambda x: F.lit(x).cast("bigint")
    one = F.when(closing, F.struct(whole(baseflow).alias("low"), whole(baseflow).alias("cap"), whole(0).alias("slope"))).otherwise(F.struct(whole(0).alias("low"), whole(FREE_CAP).alias("cap"), whole(1).alias("slope")))
    free_arcs = d.where(closing | free).select("arc_id", "from", "to", whole(0).alias("seq"), F.lit("fwd").alias("dir"), one.alias("x")).select("arc_id", "from", "to", "seq", "dir", "x.*")
    d = d.where(~closing & ~free)
    best = F.try_divide(F.col("k"), F.col("l")) + 0.0001
    up, down = nearly_ceil(best), best.cast("bigint")
    f = lambda x: cost_at(x, F.col("k"), F.col("l"))
    d = d.withColumn("s", F.when(f(up) > f(down), down).otherwise(up))
    slope = lambda a, z: (1000 * (f(z) - f(a)) / (z - a)).cast("bigint")
    seg = lambda seq, dir_, low, cap, value: F.struct(
        seq.cast("bigint").alias("seq"), F.lit(dir_).alias("dir"), low.cast("bigint").alias("low"), cap.cast("bigint").alias("cap"), value.alias("slope")
    )
    s = F.col("s")
    forward = F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), lambda i: seg(
        i, "fwd", F.when(i == 0, s).otherwise(0), F.when(i == 0, s + 1).when(i == lines - 1, 2).otherwise(1),
        slope(s + i, s + i + F.when((i == lines - 1) & (i > 0), 2).otherwise(1)),
    ))
    end = s + lines + (1 if lines > 1 else 0)
    last = F.array(seg(F.lit(lines), "fwd", F.lit(0), F.lit(LAST_CAP), slope(end, end + LAST_SPAN)))
    # unit steps back from s, of which the last of `lines` takes two if it can
    at = lambda i: s - i
    step = lambda i: F.when((i == lines - 1) & (at(i) > 2), 2).otherwise(1)
    back = F.transform(F.filter(F.sequence(F.lit(0), F.lit(lines - 1)), lambda i: at(i) > 1), lambda i: seg(i + 1000, "rev", F.lit(0), step(i), -slope(at(i) - step(i), at(i))))
    low = F.when(s > lines + 1, s - lines - 1).otherwise(F.least(s, F.lit(1)))  # where the unit steps stop
    jump = F.least(low - 1, F.lit(10))
    jumped = F.filter(F.array(seg(F.lit(2000), "rev", F.lit(0), jump, -slope(low - F.greatest(jump, F.lit(1)), low))), lambda x: x["cap"] > 0)
    stop = F.when(low > 1, low - jump).otherwise(low)
    none = F.filter(F.array(seg(F.lit(3000), "rev", F.lit(0), stop, -slope(F.lit(1.0 / (allow_none + 1)), stop.cast("double")))), lambda x: (x["cap"] > 0) & F.lit(bool(allow_none)))
    out = d.select("arc_id", "from", "to", F.explode(F.concat(forward, last, back, jumped, none)).alias("x")).select("arc_id", "from", "to", "x.*")
    return out.unionByName(free_arcs)


def self_loops(arcs: DataFrame, arrival: float) -> DataFrame:
    """(arc_id, flow) of the arcs (hits, len) from a node to itself: twice the count that their hits tell, one at least.

    arrival: bases for each read, so that len / arrival hits are one copy; none expected: one copy.
    """
    some = (F.col("len") != 0) & (F.lit(arrival) != 0)
    copies = F.when(some, half_up(F.col("hits") / (F.col("len") / F.lit(float(arrival))))).otherwise(F.lit(0))
    return arcs.where(F.col("from") == F.col("to")).select("arc_id", (2 * F.greatest(copies, F.lit(1))).cast("bigint").alias("flow"))


def doubled(arcs: DataFrame, nodes: int) -> DataFrame:
    """(arc_id, image, tail, head): skew-symmetric network over nodes 1..n, in which each arc has two images.

    Node v is the arc 2v -> 2v-1, -v the arc -2v -> -2v+1, all shifted by 2n+1. An arc (u, v) enters the
    near side of v from the far side of u; its other image is the arc (-v, -u). Arcs from a
    node to itself are doubled like others; to solve them in closed form take them out before (self_loops).
    """
    off = 2 * nodes + 1
    far = lambda u: F.when(u > 0, 2 * u - 1).otherwise(2 * u + 1)
    u, v = F.col("from"), F.col("to")
    images = F.array(
        F.struct(F.lit(1).alias("image"), (far(u) + off).alias("tail"), (2 * v + off).alias("head")),
        F.struct(F.lit(2).alias("image"), (far(-v) + off).alias("tail"), (-2 * u + off).alias("head")),
    )
    return arcs.select("arc_id", F.explode(images).alias("x")).select("arc_id", "x.*")


def node_arcs(of: DataFrame, nodes: int) -> DataFrame:
    """(..., node, tail, head, low, cap, cost): the arcs of nodes (node, ...) in the doubled network over nodes 1..n."""
    off = 2 * nodes + 1
    v = F.col("node")
    both = F.array(F.struct((2 * v + off).alias("tail"), (2 * v - 1 + off).alias("head")), F.struct((-2 * v + off).alias("tail"), (-2 * v + 1 + off).alias("head")))
    whole = lambda x, n: F.lit(x).cast("bigint").alias(n)
    return of.select("*", F.explode(both).alias("_x")).select(*of.columns, "_x.*", whole(0, "low"), whole(FREE_CAP, "cap"), whole(0, "cost"))


#: Arcs that SHARES calls of the solver get together.
BLOCK = 200_000
#: In the ids of a network's arcs: images of an arc, numbers of its segments (from 1000 on those back), and where arcs of nodes begin.
_SEGMENTS, _BACK, _NODES = 4096, 1000, 1 << 61


def network_arcs(arcs: DataFrame, nodes: int, **costs) -> DataFrame:
    """(net, arc_id, tail, head, low, cap, cost): the circulation whose cheapest flow tells the copies of arcs (arc_id, from, to, hits, len, lam) over
    nodes 1..n: the segments of their convex costs (options as cost_segments has them) in both images, and the arcs of the nodes.

    A column `net` of arcs, if there is one, tells networks apart (nodes: of the largest); loops are left to self_loops.
    """
    name = F.col("net") if "net" in arcs.columns else F.lit("")
    d = arcs.where(F.col("from") != F.col("to")).withColumn("net", name.cast("string"))
    seg = cost_segments(d.drop("net"), **costs).select("arc_id", "seq", "dir", "low", "cap", F.col("slope").alias("cost"))
    images = doubled(d, nodes).join(d.select("arc_id", "net"), "arc_id")
    j = seg.join(images, "arc_id")
    back = F.col("dir") == "rev"
    number = ((F.col("arc_id") * _SEGMENTS + F.col("seq")) * 2 + F.col("image") - 1).cast("bigint")
    j = j.select("net", number.alias("arc_id"), F.when(back, F.col("head")).otherwise(F.col("tail")).alias("tail"), F.when(back, F.col("tail")).otherwise(F.col("head")).alias("head"), "low", "cap", "cost")
    met = d.select("net", F.explode(F.array(F.abs("from"), F.abs("to"))).alias("node")).distinct()
    own = node_arcs(met, nodes)
    side = F.when(F.col("tail") > 2 * nodes + 1, 0).otherwise(1)
    return j.unionByName(own.select("net", (_NODES + F.col("node") * 2 + side).alias("arc_id"), "tail", "head", "low", "cap", "cost"))


def solved_copies(solved: DataFrame) -> DataFrame:
    """(arc_id, flow): copies of each arc in a solution of its network: half of what both images' segments carry, less what those back do."""
    seq = F.expr(f"(arc_id div 2) % {_SEGMENTS}")
    d = solved.where(F.col("arc_id") < _NODES).select(F.expr(f"arc_id div {2 * _SEGMENTS}").alias("arc_id"), F.when(seq >= _BACK, -1).otherwise(1).alias("sign"), "flow")
    return net_flow(d)


def attach_flow(arcs: DataFrame, solved: DataFrame) -> DataFrame:
    """arcs (i, from, fake, to, ...) of a graph with the flow of their first part in a solution (from, to, flow), whose signs tell how the arc
    leaves its node, and `ok`: whether the solution has the arc, and between the same nodes."""
    part = solved.select(F.abs("from").alias("_from"), F.abs("to").alias("fake"), "flow").where("_from <> fake")
    d = arcs.join(part, "fake", "left").withColumn("ok", F.coalesce(F.col("_from") == F.col("from"), F.lit(False)))
    return d.drop("_from")


def net_flow(images: DataFrame) -> DataFrame:
    """(arc_id, flow): half the sum of an arc's flow over its two images (arc_id, sign, flow)."""
    return images.groupBy("arc_id").agg((F.sum(F.col("sign") * F.col("flow")) / 2).alias("flow"))


def min_cost_flow(
    nodes: int, arcs: list[tuple[int, int, int, int, int]], supply: dict[int, int] | None = None, start: tuple[list[int], dict[int, int]] | None = None
) -> tuple[list[int], dict[int, int]]:
    """Flows of arcs (tail, head, low, cap, cost) at least cost with given supplies, and node prices that prove it.

    Primal-dual (Ahuja, Magnanti and Orlin, Network Flows, chapter 9): arcs whose cost under the prices is negative are filled, those of
    positive cost are emptied to their lower bound, and what that unbalances is sent back along shortest paths: after each search
    as much as arcs of no cost under the new prices let through. start: flows and prices of a problem that differs in its costs, from
    which less is to be done. Raises ValueError if the supplies can't be met.
    """
    n = nodes + 1
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    excess = [0] * n
    price = [(start[1].get(v, 0) if start else 0) for v in range(n)]
    for v, s in (supply or {}).items():
        excess[v] += s
    for i, (t, h, low, c, w) in enumerate(arcs):
        if low > c:
            raise ValueError("an arc's lower bound exceeds its capacity")
        reduced = w + price[t] - price[h]
        f = c if reduced < 0 else min(c, max(low, start[0][i])) if reduced == 0 and start else low
        excess[t] -= f
        excess[h] += f
        for a, b, room, unit in ((t, h, c - f, w), (h, t, f - low, -w)):
            out[a].append(len(to))
            to.append(b)
            cap.append(room)
            cost.append(unit)
    if sum(excess):
        raise ValueError("supplies don't add up")
    while any(e > 0 for e in excess):
        dist = [math.inf] * n
        heap = []
        for v in range(n):
            if excess[v] > 0:
                dist[v] = 0
                heap.append((0, v))
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            for a in out[v]:
                if cap[a] > 0:
                    e = d + cost[a] + price[v] - price[to[a]]
                    if e < dist[to[a]]:
                        dist[to[a]] = e
                        heapq.heappush(heap, (e, to[a]))
        reached = [dist[v] for v in range(n) if excess[v] < 0 and dist[v] < math.inf]
        if not reached:
            raise ValueError("no flow meets the supplies")
        top = max(reached)
        for v in range(n):
            price[v] += int(min(dist[v], top))
        _push(n, to, cap, cost, out, price, excess)
    flows = [arcs[i][2] + cap[2 * i + 1] for i in range(len(arcs))]
    return flows, dict(enumerate(price))


def _push(n: int, to: list[int], cap: list[int], cost: list[int], out: list[list[int]], price: list[int], excess: list[int]) -> None:
    """Send excess along residual arcs of no cost under the prices until none gets through: blocking flows by levels (Dinic)."""
    while True:
        level = [-1] * n
        queue = deque(v for v in range(n) if excess[v] > 0)
        for v in queue:
            level[v] = 0
        met = False
        while queue:
            v = queue.popleft()
            for a in out[v]:
                u = to[a]
                if cap[a] > 0 and level[u] < 0 and cost[a] + price[v] == price[u]:
                    level[u] = level[v] + 1
                    met |= excess[u] < 0
                    queue.append(u)
        if not met:
            return
        at = [0] * n
        for source in range(n):
            while excess[source] > 0 and level[source] == 0:
                path, v = [], source
                while excess[v] >= 0:
                    while at[v] < len(out[v]):
                        a = out[v][at[v]]
                        if cap[a] > 0 and level[to[a]] == level[v] + 1 and cost[a] + price[v] == price[to[a]]:
                            break
                        at[v] += 1
                    if at[v] < len(out[v]):
                        path.append(out[v][at[v]])
                        v = to[path[-1]]
                    elif path:
                        v = to[path.pop() ^ 1]
                        at[v] += 1
                    else:
                        break
                if not path:
                    break
                amount = min([excess[source], -excess[v], *(cap[a] for a in path)])
                for a in path:
                    cap[a] -= amount
                    cap[a ^ 1] += amount
                excess[source] -= amount
                excess[v] += amount


def _numbered(net: np.ndarray, tail: np.ndarray, head: np.ndarray, is_arc: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Numbers from 0 in each net of the nodes in tail, and in head of arcs; how many each net has; and where its nodes begin among all, with the end of all."""
    at, node = np.r_[net, net[is_arc]], np.r_[tail, head[is_arc]]
    order = np.lexsort((node, at))
    a, v = at[order], node[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (v[1:] != v[:-1])
    first = np.searchsorted(a[new], np.arange(int(net[-1]) + 2 if len(net) else 1))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1 - first[a]
    return number[: len(tail)], number[len(tail) :], np.diff(first).tolist(), first


def solve(arcs: DataFrame, supply: DataFrame | None = None, at_once: int = 200_000) -> DataFrame:
    """arcs (net, arc_id, tail, head, low, cap, cost) with flow and the prices of both ends.

    supply: (net, node, excess); without it each net is a circulation. Nets of over `at_once` arcs are split into connected components first, so that
    a task gets a net or a component; there chains become single arcs of summed convex cost, and the forks between them are solved. If
    arcs have flow, tail_price and head_price, from an earlier solution with other costs, the solver starts from there.
    """
    again = "flow" in arcs.columns
    known = ["flow", "tail_price", "head_price"] if again else []
    both = arcs.select(F.col("net").cast("string").alias("net"), *(F.col(c).cast("bigint").alias(c) for c in ("arc_id", "tail", "head", "low", "cap", "cost", *known)))
    if supply is not None:
        none = [F.lit(0).cast("bigint").alias(c) for c in ("cap", "cost", *known)]
        cols = ["net", F.lit(-1).cast("bigint").alias("arc_id"), F.col("node").alias("tail"), F.lit(0).cast("bigint").alias("head"), F.col("excess").alias("low"), *none]
        both = both.unionByName(supply.select(*cols))
    sizes = arcs.groupBy("net").count()
    n, most = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    large = [r["net"] for r in sizes.where(F.col("count") > at_once).select("net").collect()] if at_once and most > at_once else []  # as many as nets of that size
    if large or not at_once:
        node = lambda c: F.xxhash64("net", c)
        joined = arcs.where(F.col("net").isin(large)) if at_once else arcs
        found = components(joined.select(node("tail").alias("a"), node("head").alias("b")))
        both = both.withColumn("_node", node("tail")).join(found.select(F.col("node").alias("_node"), "component"), "_node", "left").drop("_node")
        both = both.withColumn("component", F.coalesce("component", F.lit(0).cast("bigint")))
    else:
        both = both.withColumn("component", F.lit(0).cast("bigint"))

    def run(table: pa.Table) -> pa.Table:
        # many small nets come in one call: a call for each costs more than to solve it
        name = table.column("net").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        columns = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("net", "block")}
        order = np.lexsort((columns["arc_id"], columns["component"], name))
        name, columns = name[order], {c: x[order] for c, x in columns.items()}
        new = np.ones(len(order), bool)
        new[1:] = (name[1:] != name[:-1]) | (columns["component"][1:] != columns["component"][:-1])
        net = np.cumsum(new) - 1
        is_arc = columns["arc_id"] >= 0  # supplies come first
        tails, heads, number, first = _numbered(net, columns["tail"], columns["head"], is_arc)
        own = net[is_arc]
        tail, head, low, cap, cost = tails[is_arc], heads, *(columns[c][is_arc] for c in ("low", "cap", "cost"))
        begin = np.searchsorted(own, np.arange(len(first)))
        given: list[dict[int, int]] = [{} for _ in first[1:]]
        for n, v, x in zip(net[~is_arc].tolist(), tails[~is_arc].tolist(), columns["low"][~is_arc].tolist()):
            given[n][v] = x
        if again:
            flows, prices = [], []
            old, p, q = (columns[c][is_arc].tolist() for c in known)
            rows = list(zip(*(c.tolist() for c in (tail, head, low, cap, cost))))
            for n, (i, j) in enumerate(zip(begin, begin[1:])):
                start = {v: x for v, x in [*zip(tail[i:j].tolist(), p[i:j]), *zip(head[i:j].tolist(), q[i:j])]}
                flow, price = min_cost_flow(number[n], rows[i:j], given[n], (old[i:j], start))
                flows += flow
                prices.append([price[v] for v in range(number[n])])
        else:
            flows, prices = solve_networks(number, begin, (tail, head, low, cap, cost), given, min_cost_flow)
        price = np.array([x for each in prices for x in each], np.int64)
        out = {c: columns[c][is_arc] for c in ("arc_id", "tail", "head", "low", "cap", "cost")}
        out |= {"flow": np.array(flows, np.int64), "tail_price": price[first[own] + tail], "head_price": price[first[own] + head]}
        return pa.table({"net": table.column("net").take(pa.array(order[is_arc])), **{c: pa.array(x) for c, x in out.items()}})

    ship(arcs.sparkSession)
    both = both.withColumn("block", F.pmod(F.xxhash64("net", "component"), F.lit(max(1, n // BLOCK) * SHARES)))
    return both.groupBy("block").applyInArrow(run, "net string, arc_id long, tail long, head long, low long, cap long, cost long, flow long, tail_price long, head_price long")


def imbalance(flows: DataFrame) -> DataFrame:
    """(node, net): inflow minus outflow of each node of flows (tail, head, flow)."""
    ends = F.array(F.struct(F.col("head").alias("node"), F.col("flow").alias("d")), F.struct(F.col("tail").alias("node"), (-F.col("flow")).alias("d")))
    return flows.select(F.explode(ends).alias("x")).groupBy("x.node").agg(F.sum("x.d").alias("net"))


def violations(flows: DataFrame) -> DataFrame:
    """Arcs whose flow breaks a bound or complementary slackness under the prices of their ends."""
    reduced = F.col("cost") + F.col("tail_price") - F.col("head_price")
    bad = (F.col("flow") < F.col("low")) | (F.col("flow") > F.col("cap")) | ((reduced < 0) & (F.col("flow") < F.col("cap"))) | ((reduced > 0) & (F.col("flow") > F.col("low")))
    return flows.withColumn("reduced", reduced).where(bad)


def objective(flows: DataFrame) -> DataFrame:
    return flows.agg(F.sum(F.col("cost") * F.col("flow")).alias("objective"))


def check_problem(arcs: DataFrame) -> DataFrame:
    """Arcs of a problem that can't be: bounds that cross, negative bounds, ends that are missing."""
    why = F.when(F.col("tail").isNull() | F.col("head").isNull(), "end missing").when(F.col("low") < 0, "negative bound").when(F.col("low") > F.col("cap"), "bounds cross").when(F.col("tail") == F.col("head"), "loop")
    return arcs.withColumn("why", why).where("why is not null")


#: Lines of a problem file: what follows each letter.
_FORMS = {"p": r"^p\s+min\s+\d+\s+\d+\s*$", "n": r"^n\s+\d+\s+-?\d+\s*$", "a": r"^a\s+\d+\s+\d+\s+-?\d+\s+-?\d+\s+-?\d+\s*$"}


def check_lines(lines: DataFrame) -> DataFrame:
    """(why, n): what is wrong with the lines (value) of one problem file, and how often.

    Lines of no known letter or form; no problem line or several, or one after others; a count of arcs that isn't that of the problem line, too many
    node lines or a node twice; numbers of nodes beyond the problem's; loops; negative bounds and bounds that cross; supplies that
    don't balance, or that a node's arcs can't carry.
    """
    d = lines.select(F.trim("value").alias("value"), F.monotonically_increasing_id().alias("at")).where("value <> ''")
    kind = F.substring("value", 1, 1)
    form = F.lit(None).cast("boolean")
    for k, p in _FORMS.items():
        form = F.when(kind == k, F.col("value").rlike(p)).otherwise(form)
    d = d.withColumn("kind", kind).withColumn("good", form).withColumn("f", F.split("value", r"\s+")).where("kind <> 'c'")
    num = lambda i: F.get("f", F.lit(i)).cast("bigint")
    good = d.where("good")
    size = good.where("kind = 'p'").agg(F.max(num(2)).alias("nodes"), F.max(num(3)).alias("arcs"), F.count(F.lit(1)).alias("problems"), F.min("at").alias("at"))
    first = d.agg(F.min("at").alias("first"))
    arcs = good.where("kind = 'a'").select(num(1).alias("tail"), num(2).alias("head"), num(3).alias("low"), num(4).alias("cap"))
    supply = good.where("kind = 'n'").select(num(1).alias("node"), num(2).alias("excess"))
    said = lambda df, why: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(why).alias("why"), "n")
    one = F.broadcast(size)  # one row
    outside = lambda c: (F.col(c) < 1) | (F.col(c) > F.col("nodes"))
    most = arcs.select("head", "tail", "cap").withColumn("x", F.explode(F.array(F.struct(F.col("tail").alias("node"), F.col("cap").alias("out"), F.lit(0).alias("in")), F.struct(F.col("head").alias("node"), F.lit(0).alias("out"), F.col("cap").alias("in")))))
    most = most.groupBy("x.node").agg(F.sum("x.out").alias("out"), F.sum("x.in").alias("in"))
    carried = supply.join(most, "node", "left").where((F.col("excess") > F.coalesce("out", F.lit(0))) | (-F.col("excess") > F.coalesce("in", F.lit(0))))
    found = [
        said(d.where("good is null"), "unknown line"), said(d.where("not good"), "wrong form"), said(size.where("problems = 0"), "no problem line"),
        said(size.where("problems > 1"), "several problem lines"), said(size.join(F.broadcast(first)).where("at > first"), "problem line not first"),
        said(arcs.agg(F.count(F.lit(1)).alias("have")).join(one).where("have <> arcs"), "wrong number of arcs"), said(supply.agg(F.count(F.lit(1)).alias("have")).join(one).where("have > nodes"), "too many node lines"),
        said(supply.groupBy("node").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "node twice"), said(supply.join(one).where(outside("node")), "unknown node"),
        said(arcs.join(one).where(outside("tail") | outside("head")), "unknown end"), said(arcs.where("tail = head"), "loop"), said(arcs.where("low < 0"), "negative bound"),
        said(arcs.where("low > cap"), "bounds cross"), said(supply.agg(F.sum("excess").alias("x")).where("x <> 0"), "supplies don't balance"), said(carried, "supply beyond capacity"),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.where("n > 0")
