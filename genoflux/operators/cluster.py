"""Greedy leader clustering of mate pairs and the links that clusters make."""

from __future__ import annotations

from collections import deque
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from genoflux.shipping import ship

from .graph import numbered_in
from .intervals import locate, merge

NO_LINK = 10_000_000


def leaders(rows: list[tuple[int, int, int]], kind: int, reach: float, tolerance: float) -> list[int]:
    """Leader's index of each of rows (main, sec, dist), sorted: the first unclustered row within reach that it agrees with.

    Types 0 and 1 agree in distance, 2 and 3 in the sum of both ends. Leaders that are open at one time don't agree with each other, so that of
    one step of values as wide as the tolerance there is one at most, and a row is compared with those of three steps only.
    """
    lead = list(range(len(rows)))
    if tolerance <= 0:
        return lead
    open_: deque[int] = deque()
    value = [d if kind in (0, 1) else m + s for m, s, d in rows]
    steps: dict[int, list[int]] = {}
    for i, (main, _, _) in enumerate(rows):
        while open_ and main - rows[open_[0]][0] > reach:
            j = open_.popleft()
            steps[int(value[j] // tolerance)].remove(j)
        v, k = value[i], int(value[i] // tolerance)
        near = [j for n in (k - 1, k, k + 1) for j in steps.get(n, ()) if abs(value[j] - v) < tolerance]
        if near:
            lead[i] = min(near)
        else:
            open_.append(i)
            steps.setdefault(k, []).append(i)
    return lead


def leader_clusters(pairs: DataFrame, mean: float, sd: float, tol: float = 6, factor: float = 1) -> DataFrame:
    """pairs (chr, type, left_pos, right_pos, dist, template) with cluster: the number of its leader in its group.

    A group is a chromosome and type, cut wherever consecutive rows are further apart than a leader reaches, so
    that tasks are as small as the data allow; part is where its first row lies.
    """
    reach = mean + factor * sd
    main = F.when(F.col("type").isin(0, 2), F.col("left_pos")).otherwise(F.col("right_pos"))
    d = pairs.withColumn("_main", main).withColumn("_sec", F.when(F.col("type").isin(0, 2), F.col("right_pos")).otherwise(F.col("left_pos")))
    d = d.withColumn("_chr", F.col("chr")).withColumn("chr", F.concat_ws("\t", "chr", "type")).withColumn("pos", F.col("_main").cast("bigint"))
    parts = merge(d.select("chr", F.col("pos").alias("start"), (F.col("pos") + int(reach)).alias("end")))
    d = locate(d, parts.select("chr", "start", F.col("start").alias("id"))).withColumn("chr", F.col("_chr")).withColumn("part", F.col("seg_id"))
    d = d.drop("_chr", "pos", "seg_start", "seg_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["part", "_main", "_sec", "dist", "template"], kind="stable")
        lead: list[int] = []
        for _, rows in groupby(zip(p["part"], p["_main"], p["_sec"], p["dist"]), key=lambda r: r[0]):
            lead += leaders([r[1:] for r in rows], int(p["type"].iloc[0]), reach, tol * sd)
        return p.assign(cluster=lead).drop(columns=["_main", "_sec", "_block"])

    ship(pairs.sparkSession)
    fields = ", ".join(f"{n} {t}" for n, t in d.drop("_main", "_sec").dtypes)
    # parts are small and many: a call of the function takes those that begin in a stretch of the chromosome
    return d.withColumn("_block", F.floor(F.col("part") / (1 << 16))).groupBy("chr", "type", "_block").applyInPandas(run, f"{fields}, cluster long")


def cluster_summary(rows: DataFrame, mean: float) -> DataFrame:
    """(chr, from, to, type, count, l_from, l_to, avg_md, sd, id) of clusters that make a link.

    rows: (chr, type, part, cluster, left_pos, right_pos, dist, template). Extent and mean over all members; counted are
    members that differ from the one before in left end or distance, once for each template. A link needs more than
    one member, a mean of twice the library's, and more than one counted. Its ends are those that the type puts
    next to the breakpoints. Ids count from 1 in each type.
    """
    key = ["chr", "type", "part", "cluster"]
    w = W.partitionBy(*key).orderBy("left_pos", "dist", "right_pos", "template")
    same = (F.col("left_pos") == F.lag("left_pos").over(w)) & (F.col("dist") == F.lag("dist").over(w))
    d = rows.withColumn("_new", ~F.coalesce(same, F.lit(False)))
    nth = F.row_number().over(W.partitionBy(*key, "template", "_new").orderBy("left_pos", "dist", "right_pos"))
    d = d.withColumn("_kept", F.col("_new") & (nth == 1)).withColumn("_avg", F.avg("dist").over(W.partitionBy(*key)))
    s = d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("size"), F.min("left_pos").alias("x1"), F.max("left_pos").alias("x2"), F.min("right_pos").alias("x3"), F.max("right_pos").alias("x4"),
        F.avg("dist").alias("avg"), F.sum(F.col("_kept").cast("bigint")).alias("count"),
        F.sum(F.when(F.col("_kept"), (F.col("dist") - F.col("_avg")) * (F.col("dist") - F.col("_avg")))).alias("ss"),
    ).where((F.col("size") > 1) & (F.col("avg") >= 2 * mean) & (F.col("count") > 1))
    t = F.col("type")
    s = s.select(
        "chr", F.when(t.isin(0, 2), F.col("x2")).otherwise(F.col("x1")).alias("from"), F.when(t.isin(1, 2), F.col("x4")).otherwise(F.col("x3")).alias("to"), "type", "count",
        (F.col("x2") - F.col("x1")).alias("l_from"), (F.col("x4") - F.col("x3")).alias("l_to"), F.round("avg", 6).alias("avg_md"), F.round(F.sqrt(F.col("ss") / F.col("size")), 6).alias("sd"),
    )
    return numbered_in(s, "type", ["chr", "from", "to", "l_from", "l_to", "avg_md"], "id")


def filter_links(links: DataFrame, least: int) -> DataFrame:
    return links.where((F.col("count") >= least) & (F.col("avg_md") < NO_LINK))


def members(clusters: DataFrame, pairs: DataFrame, which: list[int]) -> DataFrame:
    """Rows of pairs (read_id, ...) of the clusters (id, members array) named."""
    return pairs.join(clusters.where(F.col("id").isin(which)).select("id", F.explode("members").alias("read_id")), "read_id")
