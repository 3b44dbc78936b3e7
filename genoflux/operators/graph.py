"""Reference and donor graphs: gaps, links between neighbours, split and merged repeat edges, donor arcs."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from genoflux.scratch import materialise
from genoflux.shipping import ship

from .components import in_blocks
from .intervals import gaps, locate, merge


def fill_gaps(edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """(chr, start, end, kind): merged edge intervals and what lies between, before and after them, up to lengths (chr, length)."""
    m = materialise(merge(edges, 0), "merged")  # used four times
    gap = gaps(m, 1, lengths.select("chr", F.col("length").alias("last"))).withColumn("kind", F.lit("gap"))
    return m.withColumn("kind", F.lit("edge")).unionByName(gap)


def dense_ids(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Ids from 0 in the order of the columns: rows are dealt out by ranges of all of them, numbered in each range, and ranges counted."""
    at = F.monotonically_increasing_id()  # number of the task above its rows' numbers
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    d = materialise(d.withColumn("_task", F.shiftright("_at", 33)), "dense-ids")
    sizes = d.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    start = sizes.select("_task", F.coalesce(F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # a row a task
    return d.join(F.broadcast(start), "_task").withColumn(out, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).select(*df.columns, out)


def numbered_in(df: DataFrame, by: str, order: list[str], out: str) -> DataFrame:
    """Numbers from 1 in each value of `by`, in the order of the columns: counts by the first of them, then numbers inside it."""
    first, rest = order[0], order[1:]
    sizes = df.groupBy(by, first).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy(first).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = sizes.withColumn("_start", before).drop("_n")
    nth = F.row_number().over(W.partitionBy(by, first).orderBy(*rest))
    return df.withColumn("_nth", nth).join(start, [by, first]).select(*df.columns, (F.col("_nth") + F.col("_start")).cast("bigint").alias(out))


def free_links(occurrences: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Each occurrence (contig, pos, edge_id) with the next on its contig, (next_pos, next_edge).

    Neighbours are found inside slices of a contig; the last of a slice takes the first of the next slice that has any.
    """
    d = occurrences.select("contig", "pos", "edge_id").withColumn("_slice", F.floor(F.col("pos") / width))
    w = W.partitionBy("contig", "_slice").orderBy("pos", "edge_id")
    d = d.withColumn("_next", F.lead(F.struct("pos", "edge_id")).over(w))
    first = d.groupBy("contig", "_slice").agg(F.min(F.struct("pos", "edge_id")).alias("_first"))
    after = first.select("contig", "_slice", F.lead("_first").over(W.partitionBy("contig").orderBy("_slice")).alias("_after"))
    d = d.join(after, ["contig", "_slice"]).withColumn("_next", F.coalesce("_next", "_after")).where("_next is not null")
    return d.select("contig", "pos", "edge_id", F.col("_next.pos").alias("next_pos"), F.col("_next.edge_id").alias("next_edge"))


def multiplicity(occurrences: DataFrame, ploidy: int = 2) -> DataFrame:
    return occurrences.groupBy("edge_id").agg((ploidy * F.count(F.lit(1))).alias("copies"))


def donor_report(links: DataFrame, flows: DataFrame) -> DataFrame:
    """Donor links (id, ...) that carry flow (id, flow)."""
    return links.join(flows, "id").where("flow <> 0")


def graph_size(edges: DataFrame) -> DataFrame:
    """(size, rows): one more than the largest edge_id, and rows of edges."""
    return edges.agg((F.coalesce(F.max("edge_id"), F.lit(-1)) + 1).alias("size"), F.count(F.lit(1)).alias("rows"))


def bits(kind: Column) -> tuple[Column, Column]:
    """Ends (from, to) that a link's orientation 0..3 joins: 0 (0,1), 1 (1,0), 2 (0,0), 3 (1,1)."""
    return F.when(kind.isin(1, 3), 1).otherwise(0), F.when(kind.isin(0, 3), 1).otherwise(0)


def cut_at(parts: DataFrame, points: DataFrame) -> DataFrame:
    """(chr, start, end): parts cut so that each point (chr, pos) inside one starts a part; all cuts of a part in one pass."""
    from .intervals import BIN

    r = parts.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("end") / BIN))))
    p = points.select(F.col("chr").alias("_chr"), "pos", F.floor(F.col("pos") / BIN).alias("_pbin")).distinct()
    hit = r.join(p, (r["chr"] == p["_chr"]) & (r["_bin"] == p["_pbin"]) & (F.col("pos") > F.col("start")) & (F.col("pos") <= F.col("end")))
    cuts = hit.groupBy("chr", "start", "end").agg(F.array_sort(F.collect_set("pos")).alias("cuts"))
    d = parts.distinct().join(cuts, ["chr", "start", "end"], "left")
    none = F.array().cast("array<bigint>")
    at = F.concat(F.array(F.col("start").cast("bigint")), F.coalesce("cuts", none))
    to = F.concat(F.transform(F.coalesce("cuts", none), lambda x: x - 1), F.array(F.col("end").cast("bigint")))
    return d.select("chr", F.explode(F.arrays_zip(at.alias("start"), to.alias("end"))).alias("x")).select("chr", "x.start", "x.end")


def split_edges(occurrences: DataFrame, points: DataFrame) -> DataFrame:
    """(edge_id, piece, chr, start, end, strand): occurrences (edge_id, chr, start, end, strand) of edges cut so that each point (chr, pos) inside
    one starts a piece. A cut goes through all occurrences of its edge at the same place, counted from the end on the other strand; piece
    counts from 0 along the edge.
    """
    from .intervals import BIN

    r = occurrences.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("end") / BIN))))
    p = points.select(F.col("chr").alias("_chr"), "pos", F.floor(F.col("pos") / BIN).alias("_pbin")).distinct()
    hit = r.join(p, (r["chr"] == p["_chr"]) & (r["_bin"] == p["_pbin"]) & (F.col("pos") > F.col("start")) & (F.col("pos") <= F.col("end")))
    off = F.when(F.col("strand") == "-", F.col("end") - F.col("pos") + 1).otherwise(F.col("pos") - F.col("start")).cast("bigint")
    cuts = hit.select("edge_id", off.alias("off")).groupBy("edge_id").agg(F.array_sort(F.collect_set("off")).alias("cuts"))
    d = occurrences.join(cuts, "edge_id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>")))
    size = (F.col("end") - F.col("start") + 1).cast("bigint")
    ends = F.arrays_zip(F.concat(F.array(F.lit(0).cast("bigint")), "cuts").alias("a"), F.concat("cuts", F.array(size)).alias("z"))
    d = d.select("edge_id", "chr", "start", "end", "strand", F.posexplode(ends).alias("piece", "x"))
    back = F.col("strand") == "-"
    first = F.when(back, F.col("end") - F.col("x.z") + 1).otherwise(F.col("start") + F.col("x.a"))
    last = F.when(back, F.col("end") - F.col("x.a")).otherwise(F.col("start") + F.col("x.z") - 1)
    return d.select("edge_id", "piece", "chr", first.alias("start"), last.alias("end"), "strand")


def in_range(links: DataFrame, lengths: DataFrame) -> DataFrame:
    """Links (chr, from, to, ...) that lie on their contig: from position 1 to the length in lengths (chr, length)."""
    return links.join(lengths.select("chr", "length"), "chr").where((F.col("from") > 0) & (F.col("to") <= F.col("length"))).drop("length")


def donor_arcs(occurrences: DataFrame, links: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """(from_node, from_bit, to_node, to_bit) of the links, one arc between two nodes: that of the first link in (chr, from, to, type).

    occurrences: (chr, start, edge_id, strand), cut so that links start at a start. Nodes: 2 * edge and 2 * edge + 1, its
    start and end. On a '-' occurrence a link leaves from the other node by the other bit. Links that leave their contig, by lengths
    (chr, length) or else by the last end in occurrences, make no arc.
    """
    if lengths is None:
        lengths = occurrences.groupBy("chr").agg(F.max("end" if "end" in occurrences.columns else "start").alias("length"))
    seg = occurrences.select("chr", "start", F.struct("edge_id", "strand").alias("id"))
    link = in_range(links, lengths)
    a = locate(link.select("chr", F.col("from").alias("pos"), "from", "to", "type"), seg)
    a = a.select("chr", F.col("to").alias("pos"), "from", "to", "type", F.col("seg_id").alias("s"))
    b = locate(a, seg).select("chr", "from", "to", "type", "s", F.col("seg_id").alias("t")).where("s is not null and t is not null")
    f, t = bits(F.col("type"))
    node = lambda x: 2 * F.col(f"{x}.edge_id") + F.when(F.col(f"{x}.strand") == "-", 1).otherwise(0)
    bit = lambda x, v: F.when(F.col(f"{x}.strand") == "-", 1 - v).otherwise(v)
    d = b.select(node("s").alias("from_node"), node("t").alias("to_node"), F.struct("chr", "from", "to", "type", bit("s", f).alias("from_bit"), bit("t", t).alias("to_bit")).alias("x"))
    d = d.groupBy("from_node", "to_node").agg(F.min("x").alias("x"))
    return d.select("from_node", "x.from_bit", "to_node", "x.to_bit")


def arc_list(edges: DataFrame, nodes: int) -> DataFrame:
    """(edge_id, part, from, to, hits, len, lam): each edge as an arc into a fake node of its own and one out of it.

    edges: (edge_id, from_node, from_bit, to_node, to_bit, hits, expected, unmasked, paths, free, cb). Nodes count from 1 and the fake ones go
    on from `nodes`. Only the first part (part 1) has hits, a length (unmasked over paths, rounded down) and an expected depth (expected over
    unmasked); free edges and those of which nothing is expected or unmasked have none, and contig breaks nothing at all.
    """
    fake = F.col("edge_id") + nodes + 1
    d = signed_ends(edges).withColumn("fake", fake.cast("bigint"))
    none = F.col("free") | (F.col("expected") == 0)
    size = F.when(F.col("cb") | none, F.lit(0)).otherwise(F.expr("unmasked div paths")).cast("bigint")
    lam = F.when(F.col("cb") | none | (F.col("unmasked") == 0), F.lit(0.0)).otherwise(F.try_divide(F.col("expected"), F.col("unmasked").cast("double")))
    hits = F.when(F.col("cb"), F.lit(0.0)).otherwise(F.col("hits").cast("double"))
    part = lambda k, a, z, h, n, x: F.struct(F.lit(k).alias("part"), a.cast("bigint").alias("from"), z.cast("bigint").alias("to"), h.alias("hits"), n.alias("len"), F.round(x, 6).alias("lam"))
    both = F.array(part(1, F.col("from"), F.col("fake"), hits, size, lam), part(2, F.col("fake"), F.col("to"), F.lit(0.0), F.lit(0).cast("bigint"), F.lit(0.0)))
    return d.select("edge_id", F.explode(both).alias("x")).select("edge_id", "x.*")


def closing_arc(occurrences: DataFrame) -> DataFrame:
    """(from, to, hits, len, lam): from the end of the last occurrence (contig, pos, edge_id) to the start of the first, of length -1."""
    at = F.struct("contig", "pos", "edge_id")
    d = occurrences.agg(F.max(at).alias("z"), F.min(at).alias("a"))
    return d.select((2 * F.col("z.edge_id") + 2).alias("from"), (2 * F.col("a.edge_id") + 1).alias("to"), F.lit(0.0).alias("hits"), F.lit(-1).cast("bigint").alias("len"), F.lit(0.0).alias("lam"))


def called(edges: DataFrame) -> DataFrame:
    """(length, hits, funny, breaks): unmasked length and hits of what is called, edges without a called length, contig breaks."""
    cb = F.col("cb")
    size = F.when(F.col("free") | (F.col("expected") == 0), F.lit(0)).otherwise(F.expr("unmasked div paths"))
    return edges.agg(
        F.coalesce(F.sum(F.when(~cb & ~F.col("free"), F.col("unmasked"))), F.lit(0)).cast("bigint").alias("length"), F.round(F.coalesce(F.sum(F.when(~cb, F.col("hits"))), F.lit(0.0)), 6).alias("hits"),
        F.count(F.when(~cb & (size == 0), 1)).alias("funny"), F.count(F.when(cb, 1)).alias("breaks"),
    )


def signed_ends(arcs: DataFrame) -> DataFrame:
    """arcs (from_node, from_bit, to_node, to_bit, ...) with from and to, as signed_arcs has them."""
    return arcs.withColumn("from", F.when(F.col("from_bit") != 0, -1).otherwise(1) * (F.col("from_node") + 1)).withColumn("to", F.when(F.col("to_bit") == 0, -1).otherwise(1) * (F.col("to_node") + 1))


def signed_arcs(arcs: DataFrame) -> DataFrame:
    """Arcs (from_node, from_bit, to_node, to_bit) with signed ends: from is negative by a set bit, to by an unset one; nodes count from 1."""
    return signed_ends(arcs).select("from", "to")


class _Signed:
    """Union-find with a sign on every link. Members of a root in `both` are tied to it by either sign."""

    def __init__(self):
        self.up: dict = {}
        self.both: set = set()

    def find(self, x):
        path, sign = [], 1
        while self.up.setdefault(x, (x, 1))[0] != x:
            path.append(x)
            x = self.up[x][0]
        for p in reversed(path):
            sign *= self.up[p][1]
            self.up[p] = (x, sign)
        return x, (self.up[path[0]][1] if path else 1)

    def join(self, a, b, sign):
        (ra, sa), (rb, sb) = self.find(a), self.find(b)
        if ra != rb:
            self.up[max(ra, rb)] = (min(ra, rb), sa * sb * sign)
        if (ra == rb and sa * sb * sign < 0) or ra in self.both or rb in self.both:
            self.both.add(min(ra, rb))


def classes(rows: list[tuple[int, int, int, str]]) -> list[tuple[tuple[int, int], int, int, str]]:
    """(first place, start, end, strand) of the pieces of positions (edge, start, end, strand) of one contig, cut until no two overlap in part, equal ones in one edge.

    First all cuts: an end of one position inside another is a cut of that one, which its edge hands on to the
    edge's other positions, mirrored on the other strand, until nothing new comes; each cut is looked at once. Then pieces of one place, or at one place of an edge,
    are one class by signed union; a class
    that is tied to itself turned round is on the + strand as a whole. Works as a closure of cuts and so needs no order of splitting.
    """
    edges = defaultdict(list)
    for e, s, t, strand in rows:
        edges[e].append((s, t, strand))
    # positions by start, to find those that a new cut lies in: an end beyond the cut among those that start before it
    order = sorted((s, t, strand, e) for e, s, t, strand in rows)
    starts = [x[0] for x in order]
    longest = max((t - s for _, s, t, _ in rows), default=0)
    offsets = {e: set() for e in edges}
    new = sorted({c for _, s, t, _ in rows for c in (s, t + 1)})
    cuts = set(new)
    while new:
        found = set()
        for c in new:
            for s, t, strand, e in order[bisect_left(starts, c - longest) : bisect_left(starts, c)]:
                n = t - s + 1
                off = c - s if strand == "+" else n - (c - s)
                if c <= t and off not in offsets[e]:
                    offsets[e].add(off)
                    found |= {a + (off if way == "+" else z - a + 1 - off) for a, z, way in edges[e]}
        new = sorted(found - cuts)
        cuts |= found
    same = _Signed()
    for e, members in edges.items():
        grid = sorted(offsets[e] | {0, members[0][1] - members[0][0] + 1})
        for a, z in zip(grid[:-1], grid[1:]):
            first = None
            for s, t, strand in members:
                n = t - s + 1
                piece = (s + a, s + z - 1) if strand == "+" else (s + n - z, s + n - a - 1)
                sign = 1 if strand == "+" else -1
                same.find(piece)
                if first is None:
                    first = (piece, sign)
                else:
                    same.join(first[0], piece, first[1] * sign)
    out = []
    for piece in sorted(same.up):
        root, sign = same.find(piece)
        out.append((root, *piece, "+" if sign > 0 or root in same.both else "-"))
    return out


def refine(rows: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """The pieces of classes, numbered in the order of their first places."""
    names: dict = {}
    return [(names.setdefault(root, len(names)), *rest) for root, *rest in classes(rows)]


def refine_repeats(positions: DataFrame, at_once: int = 500_000) -> DataFrame:
    """(contig, edge_id, start, end, strand): refine() of the positions of each contig; ids count from 0 in each contig.

    Cuts go on only where positions overlap or belong to one edge; so stretches of overlapping positions that edges tie together, directly or
    over others, are worked on together, and the others apart; up to `at_once` positions in all are not worth telling apart. Their classes are
    numbered over the contig afterwards.
    """
    columns = ["contig", "component", "edge_id", "start", "end", "strand"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        p = pdf.sort_values(columns[:2], kind="stable")
        for (contig, _), rows in groupby(zip(*(p[c].tolist() for c in columns)), key=lambda r: r[:2]):
            out += [(contig, *root, *rest) for root, *rest in classes([r[2:] for r in rows])]
        return pd.DataFrame(out, columns=["contig", "root_start", "root_end", "start", "end", "strand"])

    ship(positions.sparkSession)
    p = positions.select("contig", "edge_id", "start", "end", "strand")
    stretches = materialise(merge(p.select(F.col("contig").alias("chr"), "start", "end")), "stretches")
    at = p.withColumn("chr", F.col("contig")).withColumn("pos", F.col("start"))
    d = materialise(locate(at, stretches.select("chr", "start", F.col("start").alias("id"))).select(*p.columns, F.col("seg_id").alias("stretch")), "positions")
    d = in_blocks(d, "contig", "stretch", "edge_id", at_once)
    found = materialise(d.groupBy("block").applyInPandas(run, "contig string, root_start long, root_end long, start long, end long, strand string"), "pieces")
    roots = found.select("contig", "root_start", "root_end").distinct().withColumn("slice", F.floor(F.col("root_start") / (1 << 20)))
    named = numbered_in(roots, "contig", ["slice", "root_start", "root_end"], "edge_id").withColumn("edge_id", F.col("edge_id") - 1).drop("slice")
    return found.join(named, ["contig", "root_start", "root_end"]).select("contig", "edge_id", "start", "end", "strand")
