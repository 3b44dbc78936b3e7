"""What is left of a flow network once its chains are single arcs: a genome's network is long chains between a few forks."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

#: (tail, head, low, cap, cost)
Arc = tuple[int, int, int, int, int]
_OPEN = 1 << 60


class Convex:
    """Least cost of sending x along arcs between two nodes, either way, as a convex function: its ends, its slope at the
    lower one, and by how much the slope grows at each x in between."""

    __slots__ = ("lo", "hi", "slope", "grows")

    def __init__(self, lo: int, hi: int, slope: int, grows: dict[int, int]):
        self.lo, self.hi, self.slope, self.grows = lo, hi, slope, grows

    @classmethod
    def of(cls, rooms: list[tuple[int, int]], lo: int) -> Convex:
        """From (slope, width) of what can be sent beyond lo, the cheapest first."""
        rooms = sorted(r for r in rooms if r[1])
        x, grows = lo, {}
        for i, (slope, width) in enumerate(rooms):
            if i and slope != rooms[i - 1][0]:
                grows[x] = slope - rooms[i - 1][0]
            x += width
        return cls(lo, x, rooms[0][0] if rooms else 0, grows)

    def flipped(self) -> Convex:
        """The same, of what goes the other way."""
        return Convex(-self.hi, -self.lo, -(self.slope + sum(self.grows.values())), {-x: g for x, g in self.grows.items()})

    def pieces(self) -> list[tuple[int, int, int]]:
        """(from, to, slope) in order."""
        at, slope, out = self.lo, self.slope, []
        for x in sorted(self.grows):
            if x >= self.hi:
                break
            if x > at:
                out.append((at, x, slope))
                at = x
            slope += self.grows[x]
        return [*out, (at, self.hi, slope)] if at < self.hi else out

    def slopes(self, x: int) -> tuple[int, int]:
        """Slopes below and above x, open at the ends."""
        below = self.slope + sum(g for y, g in self.grows.items() if y < x)
        return -_OPEN if x == self.lo else below, _OPEN if x == self.hi else below + self.grows.get(x, 0)

    def least(self) -> int:
        """The x of least cost, next to 0 of several."""
        x = self.lo
        for a, z, slope in self.pieces():
            if slope > 0 or (slope == 0 and a >= 0):
                break
            x = z if slope < 0 else min(z, max(a, 0))
        return x


def in_series(each: list[Convex]) -> Convex:
    """Of what goes through all of them: a sum over the x that all let through."""
    lo, hi = max(f.lo for f in each), min(f.hi for f in each)
    if lo > hi:
        raise ValueError("no flow meets the supplies")
    slope, grows = 0, defaultdict(int)
    for f in each:
        slope += f.slope
        for x, g in f.grows.items():
            if x <= lo:
                slope += g
            elif x < hi:
                grows[x] += g
    return Convex(lo, hi, slope, grows)


def spread(total: int, bounds: list[tuple[int, int]]) -> list[int]:
    """Whole numbers within bounds (open where beyond all others) that sum up to total."""
    out = [a if a > -_OPEN else z if z < _OPEN else 0 for a, z in bounds]
    left = total - sum(out)
    for i, (a, z) in enumerate(bounds):
        if not left:
            break
        step = min(left, z - out[i]) if left > 0 else max(left, a - out[i])
        out[i] += step
        left -= step
    return out


class Bundles:
    """Arcs of many networks, bundled by the two nodes that they join; a bundle runs from its smaller node. `first`: where the bundles of each network begin, and the end of all."""

    def __init__(self, arcs_first: np.ndarray, tail: np.ndarray, head: np.ndarray, low: np.ndarray, cap: np.ndarray, cost: np.ndarray):
        if (low > cap).any():
            raise ValueError("an arc's lower bound exceeds its capacity")
        net = np.repeat(np.arange(len(arcs_first) - 1), np.diff(arcs_first))
        u, v = np.minimum(tail, head), np.maximum(tail, head)
        slope = np.where(tail == u, cost, -cost)
        self.loops = tail == head
        self.loop_flow = np.where(cost < 0, cap, low)
        arcs = np.flatnonzero(~self.loops)
        same = np.lexsort((v[arcs], u[arcs], net[arcs]))
        a = arcs[same]
        new = np.ones(len(a), bool)
        new[1:] = (net[a][1:] != net[a][:-1]) | (u[a][1:] != u[a][:-1]) | (v[a][1:] != v[a][:-1])
        # bundles in the order of their first arcs, as what is chosen of several cheapest flows goes by it; in each the cheaper arcs first
        lead = np.empty(len(a), np.int64)
        lead[same] = a[np.flatnonzero(new)][np.cumsum(new) - 1]
        inner = np.lexsort(((cap - low)[arcs], slope[arcs], lead))
        self.order, lead = arcs[inner], lead[inner]
        arcs = self.order
        net, u, v, slope, self.forth = net[arcs], u[arcs], v[arcs], slope[arcs], (tail == u)[arcs]
        self.low, self.cap = low[arcs], cap[arcs]
        self.width = self.cap - self.low
        new[1:] = lead[1:] != lead[:-1]
        begin = np.flatnonzero(new)
        self.bundle = np.cumsum(new) - 1
        self.first = np.searchsorted(net[begin], np.arange(len(arcs_first))).tolist()
        self.ends = list(zip(u[begin].tolist(), v[begin].tolist()))
        some = len(arcs) > 0
        self.lo = np.add.reduceat(np.where(self.forth, self.low, -self.cap), begin) if some else np.zeros(0, np.int64)
        total = np.add.reduceat(self.width, begin) if some else np.zeros(0, np.int64)
        sums = np.cumsum(self.width) - self.width
        self.before = sums - sums[begin][self.bundle]  # room of the cheaper arcs of a bundle
        wide = np.flatnonzero(self.width)
        own, s = self.bundle[wide], slope[wide]
        lead = np.r_[True, own[1:] != own[:-1]][: len(own)]
        least = np.zeros(len(begin), np.int64)
        least[own[lead]] = s[lead]
        grow = np.r_[0, np.diff(s)][: len(s)]
        change = np.flatnonzero(~lead & (grow != 0))
        x = (self.lo[own] + self.before[wide])[change].tolist()
        cut = np.searchsorted(own[change], np.arange(len(begin) + 1)).tolist()
        grows = grow[change].tolist()
        self.cost = [Convex(lo, hi, slope, dict(zip(x[i:j], grows[i:j]))) for lo, hi, slope, i, j in zip(self.lo.tolist(), (self.lo + total).tolist(), least.tolist(), cut, cut[1:])]

    def flows(self, sent: list[int]) -> list[int]:
        """Flows of the arcs that send so much through each bundle from its first node at least cost."""
        part = np.clip(np.array(sent, np.int64)[self.bundle] - self.lo[self.bundle] - self.before, 0, self.width)
        flow = self.loop_flow.copy()
        flow[self.order] = np.where(self.forth, self.low + part, self.cap - part)
        return flow.tolist()


class Network:
    """Bundles (nodes and costs) of a network. Nodes that nothing branches off at (two neighbours and no supply) are passed through, dead ends
    carry nothing; `chains` are what joins the others."""

    def __init__(self, nodes: int, ends: list[tuple[int, int]], cost: list[Convex], supply: dict[int, int]):
        self.nodes, self.ends, self.cost = nodes, ends, cost
        at: list[list[int]] = [[] for _ in range(nodes)]
        for k, (u, v) in enumerate(self.ends):
            at[u].append(k)
            at[v].append(k)
        degree = [len(x) for x in at]
        self.dead: list[tuple[int, int, int]] = []  # bundle, its end inside, its dead end; those next to the rest last
        gone = [False] * len(self.ends)
        queue = [v for v in range(nodes) if degree[v] == 1 and not supply.get(v)]
        while queue:
            v = queue.pop()
            k = next((k for k in at[v] if not gone[k]), None)
            if k is None:
                continue
            gone[k] = True
            u = self.other(k, v)
            self.dead.append((k, u, v))
            degree[u] -= 1
            degree[v] -= 1
            if degree[u] == 1 and not supply.get(u):
                queue.append(u)
        self.fork = [bool(supply.get(v)) or degree[v] > 2 for v in range(nodes)]
        self.chains: list[tuple[int, int, list[int]]] = []  # first node, last node, bundles in order
        used = gone[:]
        for v in [*(v for v in range(nodes) if self.fork[v]), *(v for v in range(nodes) if not self.fork[v])]:
            for k in at[v]:
                if used[k]:
                    continue
                chain, u = [], v
                while True:
                    used[k] = True
                    chain.append(k)
                    u = self.other(k, u)
                    if self.fork[u] or u == v:
                        break
                    k = next(j for j in at[u] if not used[j])
                self.chains.append((v, u, chain))

    def other(self, k: int, v: int) -> int:
        a, b = self.ends[k]
        return b if v == a else a

    def along(self, start: int, chain: list[int]) -> list[Convex]:
        out = []
        for k in chain:
            out.append(self.cost[k] if self.ends[k][0] == start else self.cost[k].flipped())
            start = self.other(k, start)
        return out


def solve_networks(nodes: list[int], arcs_first: np.ndarray, arcs: tuple[np.ndarray, ...], supply: list[dict[int, int]], solver) -> tuple[list[int], list[list[int]]]:
    """Flows of the arcs (tail, head, low, cap, cost: columns) of many networks at least cost, and the prices of the nodes of each that prove it, as solver(nodes, arcs, supply) would
    give them for one network. arcs_first: where the arcs of each network begin, and the end of all; nodes: how many each has, numbered from 0 in each."""
    b = Bundles(np.asarray(arcs_first), *arcs)
    sent: list[int] = []
    prices = []
    for n, i, j, s in zip(nodes, b.first, b.first[1:], supply):
        x, price = _solve(Network(n, b.ends[i:j], b.cost[i:j], s), s, solver)
        sent += x
        prices.append(price)
    return b.flows(sent), prices


def solve_network(nodes: int, arcs: list[Arc], supply: dict[int, int] | None, solver) -> tuple[list[int], dict[int, int]]:
    """solve_networks for one network."""
    columns = tuple(np.array(c, np.int64) for c in (zip(*arcs) if arcs else [()] * 5))
    flow, prices = solve_networks([nodes], np.array([0, len(arcs)]), columns, [supply or {}], solver)
    return flow, dict(enumerate(prices[0]))


def _solve(n: Network, supply: dict[int, int], solver) -> tuple[list[int], list[int]]:
    """What goes through each bundle from its first node, and node prices: the solver gets the forks only.

    Along a chain the prices' whole difference is shared out so that every arc's part lies between its slopes at the flow.
    """
    supply = {v: s for v, s in supply.items() if s}
    through, price, known = [0] * len(n.ends), [0] * n.nodes, [False] * n.nodes
    number = {v: i for i, v in enumerate(v for v in range(n.nodes) if n.fork[v])}
    inner: list[Arc] = []
    sent: list[list[int] | int] = []
    along = [n.along(u, chain) for u, _, chain in n.chains]
    for (u, v, _), each in zip(n.chains, along):
        f = in_series(each)
        if u == v:  # a ring that nothing enters or leaves
            sent.append(f.least())
            continue
        parts = f.pieces() or [(f.lo, f.lo, 0)]
        sent.append(list(range(len(inner), len(inner) + len(parts))))
        inner += [(number[u], number[v], a if j == 0 else 0, z if j == 0 else z - a, slope) for j, (a, z, slope) in enumerate(parts)]
    if number:
        got, prices = solver(len(number), inner, {number[v]: s for v, s in supply.items()})
        for v, i in number.items():
            price[v], known[v] = prices[i], True
    for (u, v, chain), each, s in zip(n.chains, along, sent):
        x = s if isinstance(s, int) else sum(got[i] for i in s)
        steps = spread(price[v] - price[u], [f.slopes(x) for f in each])
        at = u
        for k, step in zip(chain, steps):
            through[k] = x if n.ends[k][0] == at else -x
            to = n.other(k, at)
            if not known[to]:
                price[to], known[to] = price[at] + step, True
            at = to
        known[u] = True
    for k, u, v in reversed(n.dead):
        f = n.cost[k] if n.ends[k][0] == u else n.cost[k].flipped()
        if not f.lo <= 0 <= f.hi:
            raise ValueError("no flow meets the supplies")
        low, high = f.slopes(0)
        price[v] = price[u] + min(max(0, low), high)
    return through, price
