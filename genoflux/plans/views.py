"""The driver's tables seen as mappings, intervals, links, edges and flows; each view also as a DuckDB CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mappings(spark, sf) -> DataFrame:
    """Read mappings (read_id, ref_name, ref_pos, orientation)."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("read_id"),
        F.concat(F.lit("chr"), F.col("l_suppkey") % 5).alias("ref_name"),
        (F.col("l_partkey") + 1).alias("ref_pos"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("orientation"),
    )


MAPPINGS = """mappings as (select l_orderkey as read_id, 'chr' || (l_suppkey % 5) as ref_name, l_partkey + 1 as ref_pos,
  case when l_linestatus = 'O' then '+' else '-' end as orientation from lineitem)"""


def intervals(spark, sf) -> DataFrame:
    """Distinct closed intervals (chr, start, end, label)."""
    start = F.col("l_partkey") * 100 + F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("chr"), F.col("l_suppkey") % 5).alias("chr"), start.alias("start"),
        (start + F.col("l_quantity").cast("bigint")).alias("end"), F.col("l_returnflag").alias("label"),
    ).distinct()


INTERVALS = """iv as (select distinct 'chr' || (l_suppkey % 5) as chr, l_partkey * 100 + l_linenumber as "start",
  l_partkey * 100 + l_linenumber + cast(l_quantity as bigint) as "end", l_returnflag as label from lineitem)"""


def breaks(spark, sf) -> DataFrame:
    """Contig breaks (id, chr, start, end)."""
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("chr"), F.col("s_suppkey") % 5).alias("chr"),
        (F.col("s_suppkey") * 2000).alias("start"), (F.col("s_suppkey") * 2000 + 500).alias("end"),
    )


BREAKS = """br as (select s_suppkey as id, 'chr' || (s_suppkey % 5) as chr, s_suppkey * 2000 as "start", s_suppkey * 2000 + 500 as "end" from supplier)"""


def links(spark, sf) -> DataFrame:
    """Mate-pair links (id, chr, from, to, type, count, avg_md)."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("chr"), F.col("o_custkey") % 5).alias("chr"),
        (F.col("o_custkey") * 50 + 1).alias("from"), (F.col("o_custkey") * 50 + 1 + F.col("o_orderkey") % 4000).alias("to"),
        (F.col("o_orderkey") % 4).alias("type"), (F.col("o_orderkey") % 7).alias("count"), F.col("o_totalprice").alias("avg_md"),
    )


LINKS = """links as (select o_orderkey as id, 'chr' || (o_custkey % 5) as chr, o_custkey * 50 + 1 as "from", o_custkey * 50 + 1 + o_orderkey % 4000 as "to",
  o_orderkey % 4 as type, o_orderkey % 7 as count, o_totalprice as avg_md from orders)"""


def coverage(spark, sf) -> DataFrame:
    """Positions with depth and expected depth (chr, pos, cov, lam); lam is null where masked."""
    return table(spark, sf, "lineitem").groupBy(F.concat(F.lit("chr"), F.col("l_suppkey") % 5).alias("chr"), (F.col("l_partkey") * 10 + 1).alias("pos")).agg(
        F.sum("l_quantity").alias("cov")
    ).withColumn("lam", F.when(F.col("pos") % 7 != 0, F.lit(20.0)))


COVERAGE = """cov as (select chr, pos, cov, case when pos % 7 <> 0 then cast(20.0 as double) end as lam from
  (select 'chr' || (l_suppkey % 5) as chr, l_partkey * 10 + 1 as pos, sum(l_quantity) as cov from lineitem group by all))"""


def edges(spark, sf) -> DataFrame:
    """Occurrences of graph edges (contig, pos, edge_id, length, flow): a path of edges along each contig."""
    e = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("chr"), F.col("o_custkey") % 5).alias("contig"), (e * 100 + 1).alias("pos"), (F.col("o_custkey") % 1000).alias("edge_id"),
        (F.col("o_custkey") % 1000 % 90 + 10).alias("length"), (F.col("o_custkey") % 1000 * 7 % 6).alias("flow"),
    )


EDGES = """edges as (select 'chr' || (o_custkey % 5) as contig, o_orderkey * 100 + 1 as pos, o_custkey % 1000 as edge_id,
  o_custkey % 1000 % 90 + 10 as length, o_custkey % 1000 * 7 % 6 as flow from orders)"""


def calls(spark, sf) -> DataFrame:
    """Raw calls (chr, start, end, flow_diff)."""
    return table(spark, sf, "orders").select(
        F.concat(F.lit("chr"), F.col("o_custkey") % 5).alias("chr"), (F.col("o_orderkey") * 1000).alias("start"),
        (F.col("o_orderkey") * 1000 + F.col("o_custkey") % 1500 + 100).alias("end"), (F.col("o_totalprice") % 7 - 3).alias("flow_diff"),
    )


CALLS = """calls as (select 'chr' || (o_custkey % 5) as chr, o_orderkey * 1000 as "start", o_orderkey * 1000 + o_custkey % 1500 + 100 as "end",
  o_totalprice % 7 - 3 as flow_diff from orders)"""


def arcs(spark, sf) -> DataFrame:
    """Graph arcs (arc_id, from, to, hits, len, lam) between signed nodes."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("arc_id"), (k % 25 + 1).cast("bigint").alias("from"), F.when(k % 3 == 0, -((k * 7) % 25 + 1)).otherwise((k * 7) % 25 + 1).cast("bigint").alias("to"),
        (k % 40).cast("bigint").alias("hits"), (k % 11 * 40).cast("bigint").alias("len"), (F.lit(0.02) + (k % 5) * 0.01).alias("lam"),
    )


ARCS = """arcs as (select s_suppkey as arc_id, cast(s_suppkey % 25 + 1 as bigint) as "from",
  cast(case when s_suppkey % 3 = 0 then -((s_suppkey * 7) % 25 + 1) else (s_suppkey * 7) % 25 + 1 end as bigint) as "to",
  cast(s_suppkey % 40 as bigint) as hits, cast(s_suppkey % 11 * 40 as bigint) as len, cast(0.02 as double) + (s_suppkey % 5) * cast(0.01 as double) as lam from supplier)"""
