"""Reports on regions: copy counts spread over occurrences, weighted statistics, order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def apportion(occurrences: DataFrame, by: list[str]) -> DataFrame:
    """occurrences (by, pos, edge_id, flow) with share: an edge's flow over its occurrences, the remainder to the first."""
    all_ = W.partitionBy(*by, "edge_id")
    n, nth = F.count(F.lit(1)).over(all_), F.row_number().over(all_.orderBy("pos"))
    d = occurrences.withColumn("_n", n).withColumn("_nth", nth)
    return d.withColumn("share", F.expr("flow div _n + case when _nth <= flow % _n then 1 else 0 end")).drop("_n", "_nth")


def histogram(rows: DataFrame, value: str, weight: str, bound: int = 2000) -> DataFrame:
    return rows.where(F.col(value).between(-bound, bound)).groupBy(value).agg(F.sum(weight).alias("weight"))


def weighted_stats(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """(by, mean, mode, median): exact, from the histogram. Median: smallest value with at least half the weight up to it."""
    h = rows.groupBy(by, value).agg(F.sum(weight).alias("w"))
    upto = F.sum("w").over(W.partitionBy(by).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    h = h.withColumn("_upto", upto).withColumn("_all", F.sum("w").over(W.partitionBy(by)))
    return h.groupBy(by).agg(
        F.round(F.sum(F.col(value) * F.col("w")) / F.sum("w"), 6).alias("mean"),
        F.max_by(value, F.struct(F.col("w"), -F.col(value))).alias("mode"),
        F.min(F.when(2 * F.col("_upto") >= F.col("_all"), F.col(value))).alias("median"),
    )


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def walk(paths: DataFrame, regions: DataFrame) -> DataFrame:
    """(id, edge_id, pos, rel_start, rel_end, length, flow, ref, share): the segments of paths (contig, pos, edge_id, length, flow, ref) that lie
    in each of regions (id, chr, start, end), with their ends as seen from the region's start, the length inside, and the edge's flow spread
    over its segments in the region."""
    from .intervals import overlap_amount, overlap_join

    seg = paths.select(F.col("contig").alias("chr"), F.col("pos").alias("start"), (F.col("pos") + F.col("length") - 1).alias("end"), "edge_id", "flow", "ref")
    j = overlap_join(regions.select("id", "chr", "start", "end"), seg)
    d = j.select(
        "id", F.col("r_edge_id").alias("edge_id"), F.col("r_start").alias("pos"), (F.col("r_start") - F.col("start")).alias("rel_start"), (F.col("r_end") - F.col("start")).alias("rel_end"),
        overlap_amount(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")).alias("length"), F.col("r_flow").alias("flow"), F.col("r_ref").alias("ref"),
    )
    return apportion(d, ["id"])


def walk_statistics(walked: DataFrame) -> DataFrame:
    """(id, length, difference, reference, mean, mode, median) of walk: over the length inside, the mean difference from the reference and the
    mean reference copies, and mean, mode and median of the copies as they are spread."""
    d = walked.groupBy("id").agg(
        F.sum("length").alias("length"), F.round(weighted_mean(F.col("flow") - F.col("ref"), F.col("length")), 6).alias("difference"), F.round(weighted_mean(F.col("ref"), F.col("length")), 6).alias("reference")
    )
    return d.join(weighted_stats(walked, "id", "share", "length"), "id")


def region_copies(rows: DataFrame, start: int, end: int) -> DataFrame:
    """(copies, n): reference copies of rows (ref, length, rel_end) in a region, by their share of it, where rel_end isn't -1."""
    d = rows.where("rel_end <> -1")
    return d.agg(F.round(F.coalesce(F.sum(F.col("ref") * ((end - start + 1) / F.col("length"))), F.lit(0.0)), 6).alias("copies"), F.count(F.lit(1)).alias("n"))


def nscore(values: DataFrame, by: str, value: str, total: Column, percent: float) -> DataFrame:
    """(by, nscore): smallest value at which the ascending sum reaches percent of total."""
    h = values.groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum(F.col(value) * F.col("c")).over(W.partitionBy(by).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    return h.withColumn("_upto", upto).where(F.col("_upto") >= total * percent / 100).groupBy(by).agg(F.min(value).alias("nscore"))


def argmin(value: str, index: str) -> Column:
    """First index of the smallest value."""
    return F.min_by(index, F.struct(value, index))


def argmax(value: str, index: str) -> Column:
    return F.min_by(index, F.struct(-F.col(value), F.col(index)))


def segments(occurrences: DataFrame) -> DataFrame:
    """Per edge: donor and reference copies, total and unmasked length, hits over expected to two decimals."""
    d = occurrences.groupBy("edge_id").agg(F.max("flow").alias("donor"), (2 * F.count(F.lit(1))).alias("ref"), F.sum("length").alias("length"), F.sum("unmasked").alias("unmasked"), F.sum("hits").alias("h"), F.sum("expected").alias("x"))
    return d.select("edge_id", "donor", "ref", "length", "unmasked", ((100 * F.try_divide("h", "x")).cast("bigint") / 100).alias("ratio"))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """All rows of a key; on Parquet sorted by it the filter reaches the row groups."""
    return df.where(F.col(key) == value)


def from_row(df: DataFrame, order: list[str], offset: int) -> DataFrame:
    """Rows from an offset in the given order; a negative one counts from the end."""
    if offset >= 0:
        return df.orderBy(*order).offset(offset)
    return df.orderBy(*[F.desc(c) for c in order]).limit(-offset)
