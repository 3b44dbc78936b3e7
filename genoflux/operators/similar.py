"""Nearly equal stretches of pairwise alignments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoflux.scratch import materialise
from genoflux.shipping import ship

from .graph import dense_ids

WINDOW, MATCHES = 100, 99


def stretches(a: str, b: str, window: int = WINDOW, matches: int = MATCHES) -> list[tuple[int, int]]:
    """Closed column ranges covered by gapless windows with enough matches, trimmed to matches; ranges don't overlap.

    Windows are counted with running sums of matches and gaps; a range ends at the first window that fails, and the next
    begins after the range's last column.
    """
    n = len(a)
    good, gaps = [0], [0]
    same = [x.upper() == y.upper() and x != "-" and y != "-" for x, y in zip(a, b)]
    for x, y, s in zip(a, b, same):
        good.append(good[-1] + s)
        gaps.append(gaps[-1] + (x == "-" or y == "-"))
    out, i = [], 0
    while i + window <= n:
        if gaps[i + window] > gaps[i] or good[i + window] - good[i] < matches:
            i += 1
            continue
        j = i
        while j + 1 + window <= n and gaps[j + 1 + window] == gaps[j + 1] and good[j + 1 + window] - good[j + 1] >= matches:
            j += 1
        s, e = i, j + window - 1
        while not same[s]:
            s += 1
        while not same[e]:
            e -= 1
        out.append((s, e))
        i = max(j + 1, e + 1)
    return out


def repeat_pairs(axt: DataFrame, lengths: DataFrame) -> DataFrame:
    """(edge_id, contig, start, end, strand): both places of each stretch of alignments (axt), lengths: (contig, length).

    On the other strand coordinates count from the contig's end. Ids are dense in the order of blocks and stretches.
    """
    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                for k, (s, e) in enumerate(stretches(r.s1, r.s2)):
                    g1, g2 = r.s1[:s].count("-"), r.s2[:s].count("-")
                    rows.append((r.num, k, r.contig1, r.start1 + s - g1, r.start1 + e - g1, "+"))
                    a, z = r.start2 + s - g2, r.start2 + e - g2
                    if r.strand == "-":
                        a, z = r.length - z + 1, r.length - a + 1
                    rows.append((r.num, k, r.contig2, a, z, r.strand))
            yield pd.DataFrame(rows, columns=["num", "k", "contig", "start", "end", "strand"])

    ship(axt.sparkSession)
    d = axt.join(lengths.select(F.col("contig").alias("contig2"), "length"), "contig2")
    d = d.select("num", "contig1", "start1", "contig2", "start2", "strand", "s1", "s2", "length").mapInPandas(run, "num long, k long, contig string, start long, end long, strand string")
    d = materialise(d, "stretches")  # used twice
    each = dense_ids(d.select("num", "k").distinct().withColumn("slice", F.floor(F.col("num") / 65_536)), ["slice", "num", "k"], "edge_id")
    return d.join(each.drop("slice"), ["num", "k"]).select("edge_id", "contig", "start", "end", "strand")
