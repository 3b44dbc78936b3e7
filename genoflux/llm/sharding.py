"""Sharding by longest processing time: whole groups, largest first, each to the least-loaded shard."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .cluster import materialise, read

#: Leading binary digits of a group's size that make its size class: sizes in a class differ by at most 1 in 2**11.
CLASS_BITS = 12


def place(classes: list[tuple[int, int, float]], shards: int) -> list[tuple[int, list[int]]]:
    """Longest processing time over size classes.

    classes: (class, number of groups, mean size), the largest size first. Groups of one class are equal, so a
    class gives each shard a number of groups. Returns (class, running sums of those numbers by shard).
    Few groups go through the heap one by one; many equal ones are levelled at once, to the same loads.
    """
    loads = [0.0] * shards
    out = []
    for name, n, each in classes:
        given = [0] * shards
        left = n
        if n > 8 * shards:
            base = np.array(loads)
            lo, hi = base.min(), base.max() + each * (n / shards + 2)
            for _ in range(70):  # the highest level whose filling takes no more groups than there are
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if np.ceil(np.maximum(mid - base, 0) / each).sum() <= n else (lo, mid)
            given = np.ceil(np.maximum(lo - base, 0) / each).astype(int).tolist()
            left = n - sum(given)
            loads = [a + each * g for a, g in zip(loads, given)]
        heap = [(a, i) for i, a in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(left):
            a, i = heap[0]
            given[i] += 1
            heapq.heapreplace(heap, (a + each, i))
        for a, i in heap:
            loads[i] = a
        out.append((name, np.cumsum(given).tolist()))
    return out


def shard_groups(rows: DataFrame, group: str, size: str, shards: int, seed: str = "shard") -> DataFrame:
    """Add `shard` to rows (which should be cheap to read twice) so that equal values of `group` stay together.

    Driver: one row per size class, at most 2**(CLASS_BITS - 1) * 52 whatever the data. Executors: a group is one row
    after a map-side sum, so a group of any number of rows costs no more than others; its rows meet it again in
    a join that adaptive execution may split. No rows: no rows. A null group is a group like any other.
    """
    spark = rows.sparkSession
    g = rows.groupBy(group).agg(F.sum(size).alias("_bytes"))
    g = g.withColumn("_s", F.greatest(F.lit(0), F.length(F.bin("_bytes")) - CLASS_BITS).cast("int"))
    g = materialise(g.withColumn("_class", F.expr("shiftleft(shiftright(_bytes, _s), _s)")).drop("_s"), "shard-groups")
    g = g.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed), group), F.lit(blocks_for(g.count()))).cast("int"))
    hist = g.groupBy("_class", "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_bytes").alias("_b"))
    hist = materialise(hist, "shard-classes")
    classes = hist.groupBy("_class").agg(F.sum("_n").alias("n"), F.sum("_b").alias("b")).collect()
    classes = sorted(((r["_class"], r["n"], max(r["b"] / r["n"], 1e-9)) for r in classes), reverse=True)
    schema = T.StructType([T.StructField("_class", T.LongType()), T.StructField("_upto", T.ArrayType(T.LongType()))])
    plan = spark.createDataFrame(place(classes, shards), schema)
    before = F.sum("_n").over(W.partitionBy("_class").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    start = hist.withColumn("_start", F.coalesce(before, F.lit(0))).select("_class", "_part", "_start")
    nth = F.row_number().over(W.partitionBy("_class", "_part").orderBy(F.xxhash64(F.lit(seed), group), group)) - 1
    placed = (
        g.withColumn("_nth", nth)
        .join(start, ["_class", "_part"])
        .join(F.broadcast(plan), "_class")  # bounded: a row for each size class
        .withColumn("shard", F.expr("cast(size(filter(_upto, x -> x <= _nth + _start)) as int)"))
        .select(F.col(group).alias("_group"), "shard")
    )
    return rows.join(placed, rows[group].eqNullSafe(placed["_group"]), "left").drop("_group")


def blocks_for(rows: int, per_block: int = 250_000) -> int:
    """Into how many blocks rows that are to be numbered are dealt, should all have one key."""
    return max(64, 1 << max(0, rows // per_block).bit_length())


def number_rows(df: DataFrame, key: str, order: list[str], out: str, per_block: int = 250_000) -> DataFrame:
    """Add `out`: the rows of each `key` numbered from 0 without gaps. df should be cheap to read twice.

    Each key's rows are dealt by hash to blocks whose number follows the row count, counted, and numbered inside
    their block, so that one key never makes one task.
    """
    blocks = blocks_for(df.count(), per_block)
    d = df.withColumn("_block", F.pmod(F.xxhash64(F.lit("block"), *order), F.lit(blocks)).cast("int"))
    n = d.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    start = n.withColumn("_start", F.coalesce(upto, F.lit(0))).select(key, "_block", "_start")
    nth = F.row_number().over(W.partitionBy(key, "_block").orderBy(*order)) - 1
    return d.withColumn("_nth", nth).join(start, [key, "_block"]).withColumn(out, F.col("_nth") + F.col("_start")).drop("_nth", "_start", "_block")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of docs; equal texts share a shard.

    size: UTF-8 bytes plus 8. A null text counts as an empty one, in size, checksum and group. Repeated rows are
    rows of their own. Other columns are ignored.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("_text"),
    )
    rows = materialise(rows, "shard-rows")
    placed = materialise(shard_groups(rows, "_text", "size", shards), "shard-placed")
    return number_rows(placed, "shard", ["doc_id", "_text"], "slot").drop("_text")


def op1_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shard_documents(read(spark, sf_dir, "documents"), 24)
    return d.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op1_lpt_sharding": op1_lpt_sharding}
SQL: dict[str, str] = {}
