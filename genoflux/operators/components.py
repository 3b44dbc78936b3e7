"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoflux.scratch import materialise


def _large(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node of links (a, b long): the smallest node that it reaches.

    Each round is two grouped minima and two joins, written to the shared scratch folder; no list of a node's
    neighbours is gathered anywhere. Links of a node to itself and repeated links do no harm; no links: no rows.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, seen = materialise(e, "components"), None
    for _ in range(most):
        # two checksums tell whether the round changed anything
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        if not now[0] or now == seen:
            break
        seen = now
        e = materialise(_small(_large(e)), "components")
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def linked_groups(members: DataFrame, by: str, group: str, key: str) -> DataFrame:
    """(by, group, component): of the groups (numbers) of each value of `by`, those that share a value of `key`, directly or over others, have one
    component. members: a row for each group and key. Rare false ties, as groups are known by hashes, make a component larger."""
    node = F.xxhash64(by, group).alias("node")
    m = members.select(by, group, key).distinct().select(by, group, key, node)
    least = m.groupBy(by, key).agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = components(m.join(least, [by, key]).select(F.col("node").alias("a"), F.col("least").alias("b")))
    each = m.select(by, group, "node").distinct()
    return each.join(found, "node", "left").select(by, group, F.coalesce("component", "node").alias("component"))


#: Blocks for `at_once` rows, so that the tasks of a stage end at about the same time; and blocks of a small table.
SHARES = 8


def in_blocks(members: DataFrame, by: str, group: str, key: str, at_once: int) -> DataFrame:
    """members with component, of their group as linked_groups has it, and block: a number that components share, whatever their `by`, so that one
    call gets some thousand rows and not those of one small component. With no more than `at_once` rows in all, each value of `by` is one component."""
    n = members.count()
    if n <= at_once:
        tied = members.withColumn("component", F.xxhash64(by))
    else:
        tied = members.join(linked_groups(members, by, group, key), [by, group])
    return tied.withColumn("block", F.pmod(F.xxhash64("component"), F.lit(max(1, n // at_once) * SHARES)))
