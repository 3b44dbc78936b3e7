"""Gain and loss calls: runs of changed copy number, smoothing, final table."""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush
from itertools import count, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from genoflux.scratch import materialise
from genoflux.shipping import ship

from .components import SHARES, in_blocks

#: Calls that SHARES calls of the smoothing function get together.
AT_ONCE = 200_000


def clamp(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(0.5)), F.lit(-0.5))


def toward(flow: Column, ref: Column) -> Column:
    """A half flow rounded towards the reference; whole flows stay."""
    half = flow != F.floor(flow)
    return F.when(half & (flow > ref), flow - 0.5).when(half & (flow < ref), flow + 0.5).otherwise(flow)


def signed_runs(rows: DataFrame, by: str, order: list[str], value: Column, length: Column) -> DataFrame:
    """(by, run, sign, n, length, peak): maximal runs of rows of equal sign (+1, -1), in order; peak: least absolute value."""
    w = W.partitionBy(by).orderBy(*order)
    d = rows.withColumn("_v", value).withColumn("_l", length).withColumn("sign", F.signum("_v").cast("int"))
    d = d.withColumn("_new", F.coalesce(F.col("sign") != F.lag("sign").over(w), F.lit(True)).cast("int"))
    d = d.withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.where("sign <> 0").groupBy(by, "run", "sign").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("_l"), 6).alias("length"), F.round(F.min(F.abs("_v")), 6).alias("peak"))


def longest_run(runs: DataFrame, by: str) -> DataFrame:
    """The longest run of each group, the first of equal ones."""
    return runs.groupBy(by).agg(F.max_by(F.struct("run", "sign", "length"), F.struct("length", -F.col("run"))).alias("x")).select(by, "x.*")


def extract_runs(path: list[tuple[int, int]], length: dict[int, int], decide: dict[int, int], diff: dict[int, float], cutoff: int = 100):
    """Calls (start, end, change, path length, new decide length, new length) of one contig.

    path: (start, edge) in order. Over and over, the longest run of edges that differ from the reference in one
    direction, by decide, is called with the least difference in it, which is then taken from its edges. An edge that the
    run passes more than once is spent each time. Stops when no run reaches the cutoff. Runs lie in islands of one sign; a call changes only the
    islands that its edges are in, and only those are cut into runs again.
    """
    diff, edge, seen, calls = dict(diff), [e for _, e in path], set(), []
    places = defaultdict(list)
    for p, e in enumerate(edge):
        places[e].append(p)
    sign = lambda x: (x > 0) - (x < 0)
    heap: list[tuple] = []
    island = [-1] * len(path)  # number of the island that a position is in
    bounds: dict[int, tuple[int, int]] = {}
    made = count()

    def add(a: int, z: int) -> None:
        """Islands of the positions a..z-1, and their runs."""
        i = a
        while i < z:
            way, j = sign(diff[edge[i]]), i
            while j < z and sign(diff[edge[j]]) == way:
                j += 1
            number = next(made) if way else -1
            island[i:j] = [number] * (j - i)
            if way:
                bounds[number] = (i, j)
                while i < j:
                    least, used, size, k = None, {}, 0, i
                    while k < j:
                        e = edge[k]
                        times = used.get(e, 0) + 1
                        step = abs(diff[e]) if least is None else min(abs(diff[e]) / times, least)
                        if times > 1:
                            step = int(step)
                            if step < 1:
                                break
                        least, used[e], size, k = step, times, size + decide[e], k + 1
                    heappush(heap, (-size, i, number, k, way, least))
                    i = k
            i = j

    add(0, len(path))
    while heap:
        size, i, number, j, way, least = heappop(heap)
        if number not in bounds:
            continue
        if -size < cutoff:
            break
        run = dict.fromkeys(edge[i:j])
        new = [e for e in run if e not in seen]
        seen.update(run)
        start = path[i][0]
        calls.append((start, start + sum(length[e] for e in edge[i:j]) - 1, way * least, -size, sum(decide[e] for e in new), sum(length[e] for e in new)))
        for e in edge[i:j]:
            if sign(diff[e]) == way:
                diff[e] -= way * least
                if sign(diff[e]) == -way:
                    diff[e] = 0
        for k in {island[p] for e in run for p in places[e]} - {-1}:
            add(*bounds.pop(k))
    return calls


def sign_islands(rows: DataFrame, by: str, at: str, order: tuple[str, ...], value: str, width: int = 1 << 24) -> DataFrame:
    """rows with _way, the sign of value, and island: a number in `by` of each run of neighbours of one sign in the order of the columns, the
    first of which is `at`. Runs are counted in slices first, which then tell each other how many there were and how the last ended."""
    d = rows.withColumn("_way", F.signum(value).cast("int")).withColumn("_slice", F.floor(F.col(at) / width))
    w = W.partitionBy(by, "_slice").orderBy(*order)
    last = d.groupBy(by, "_slice").agg(F.max(F.struct(*order, "_way")).alias("_last"))
    before = last.select(by, "_slice", F.lag("_last").over(W.partitionBy(by).orderBy("_slice")).alias("_before"))
    d = d.join(before, [by, "_slice"])
    new = F.coalesce(F.col("_way") != F.coalesce(F.lag("_way").over(w), F.col("_before._way")), F.lit(True)).cast("int")
    d = d.withColumn("_in", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))
    sums = d.groupBy(by, "_slice").agg(F.max("_in").alias("_n"))
    sums = sums.select(by, "_slice", F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return d.join(sums, [by, "_slice"]).withColumn("island", F.col("_in") + F.col("_off")).select(*rows.columns, "_way", "island")


#: In a path, what stands between islands that aren't neighbours.
_GAP = -1


def call_runs(occurrences: DataFrame, cutoff: int = 100, at_once: int = 500_000) -> DataFrame:
    """Calls of each contig of occurrences (contig, pos, edge_id, length, decide, diff).

    Runs lie in islands of one sign, and calls bind islands only by the edges that they share; so the islands that edges tie together, directly or over
    others, are worked on together, and the others apart. Up to `at_once` occurrences in all are not worth telling apart within a contig.
    """
    columns = ["contig", "component", "pos", "edge_id", "island", "length", "decide", "diff"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        p = pdf.sort_values(columns[:4], kind="stable")
        for (contig, _), rows in groupby(zip(*(p[c].tolist() for c in columns)), key=lambda r: r[:2]):
            path: list[tuple[int, int]] = []
            length, decide, diff = {_GAP: 0}, {_GAP: 0}, {_GAP: 0}
            last = None
            for _, _, pos, e, island, *values in rows:
                length[e], decide[e], diff[e] = values
                if last not in (None, island):
                    path.append((pos, _GAP))
                path.append((pos, e))
                last = island
            found += [(contig, *call) for call in extract_runs(path, length, decide, diff, cutoff)]
        return pd.DataFrame(found, columns=["contig", "start", "end", "flow_diff", "path_len", "nd_unmasked", "nd_total"])

    ship(occurrences.sparkSession)
    d = occurrences.select("contig", "pos", "edge_id", "length", "decide", "diff")
    d = materialise(sign_islands(d, "contig", "pos", ("pos", "edge_id"), "diff").where("_way <> 0").drop("_way"), "islands")
    d = in_blocks(d, "contig", "island", "edge_id", at_once)
    schema = "contig string, start long, end long, flow_diff double, path_len long, nd_unmasked long, nd_total long"
    return d.groupBy("block").applyInPandas(run, schema)


#: A stretch: start, end, value, and the length that the value counts for.
Stretch = tuple[int, int, float, int]


def overlapping(a: Stretch, b: Stretch) -> Stretch | None:
    """Two stretches of one sign as one if the second starts inside the first: the length grows by what the second reaches beyond, and the
    value is the mean weighted with that length and the second's own, over that length."""
    if b[0] > a[1]:
        return None
    size = a[3] + max(b[1] - a[1] + 1, 0)
    return a[0], max(a[1], b[1]), (a[2] * size + b[2] * b[3]) / size, size


def close_by(forgiveness: float):
    """Two stretches of one sign as one if the gap is at most `forgiveness` percent of what both reach over: the mean weighted by lengths, the
    gap with the mean of both."""
    def rule(a: Stretch, b: Stretch) -> Stretch | None:
        gap = b[0] - a[1]
        if 100 * gap > forgiveness * (b[1] - a[0]):
            return None
        size = a[3] + gap + b[3]
        return a[0], b[1], (a[2] * a[3] + b[2] * b[3] + gap * (a[2] + b[2]) / 2) / size, size

    return rule


def fold(island: list[tuple[int, int, float]], rule) -> list[tuple[int, int, float]]:
    """An island's calls (start, end, value), each joined to the one before as long as the rule gives a stretch of both."""
    done: list[Stretch] = []
    for s, e, v in island:
        row = (s, e, v, e - s + 1)
        one = rule(done[-1], row) if done else None
        done[len(done) - (one is not None) :] = [one or row]
    return [d[:3] for d in done]


def smooth_island(island: list[tuple[int, int, float]], forgiveness: float) -> list[tuple[int, int, float]]:
    """Neighbouring calls of one sign, by both rules in turn until nothing changes to twelve digits."""
    close = close_by(forgiveness)
    shown = lambda rows: [(s, e, f"{v:.12g}") for s, e, v in rows]
    while True:
        new = fold(fold(island, overlapping), close)
        if shown(new) == shown(island):
            return new
        island = new


def smooth(calls: list[tuple[int, int, float]], forgiveness: float = 5.0) -> list[tuple[int, int, float]]:
    """Calls (start, end, value) of one chromosome, neighbours of one sign merged until nothing changes."""
    out = []
    for way, island in groupby(sorted(calls, key=lambda r: r[0]), key=lambda r: (r[2] > 0) - (r[2] < 0)):
        out += smooth_island(list(island), forgiveness) if way else list(island)
    return out


def smooth_calls(calls: DataFrame, forgiveness: float = 5.0, least: int = 1000, width: int = 1 << 24) -> DataFrame:
    """Smoothed calls (chr, start, end, call) at least `least` from start to end.

    Calls of different signs never merge, and none merges over another, so that neighbours of one sign (islands) are tasks of their own. Islands are
    counted in slices of a chromosome first; calls of no sign stay as they are.
    """
    d = calls.select("chr", "start", "end", F.col("call").cast("double").alias("call"))
    d = materialise(sign_islands(d, "chr", "start", ("start", "end", "call"), "call", width), "islands")
    cols = ["chr", "start", "end", "call"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["chr", "island", "start", "end", "call"], kind="stable")
        out = []
        for (c, _), rows in groupby(zip(p["chr"], p["island"], p["start"], p["end"], p["call"]), key=lambda r: r[:2]):
            out += [(c, *x) for x in smooth_island([r[2:] for r in rows], forgiveness)]
        return pd.DataFrame(out, columns=cols)

    ship(calls.sparkSession)
    # islands are small and many, and so may be chromosomes: a call of the function takes some thousand calls, of whatever islands
    block = F.pmod(F.xxhash64("chr", "island"), F.lit(max(1, d.count() // AT_ONCE) * SHARES)).alias("block")
    done = d.where("_way <> 0").select(*cols, "island", block).groupBy("block").applyInPandas(run, "chr string, start long, end long, call double")
    return done.unionByName(d.where("_way = 0").select(*cols)).where(F.col("end") - F.col("start") >= least)


def truncated(calls: DataFrame) -> DataFrame:
    """(chr, start, end, call) with flow_diff cut towards zero."""
    return calls.select("chr", "start", "end", F.col("flow_diff").cast("bigint").alias("call"))


def final_calls(calls: DataFrame, ratios: DataFrame | None = None) -> DataFrame:
    """(chr, start, end, call, doc_ratio): gain above zero, else loss."""
    named = F.when(F.col("call") > 0, "gain").otherwise("loss")
    d = calls.withColumn("call", named)
    if ratios is None:
        return d.select("chr", "start", "end", "call")
    return d.join(ratios, ["chr", "start", "end"], "left").select("chr", "start", "end", "call", F.col("ratio").alias("doc_ratio"))
