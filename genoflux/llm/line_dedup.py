"""Line removal by site-relative frequency: lines on too large a share of their host's pages go. Native operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import materialise, read
from .page_lines import host_lines, normal_lines, once, page_key

#: Share of a host's pages above which a line is boilerplate. A line on one page alone repeats nothing, whatever its share.
RATIO, LEAST_PAGES = 0.05, 2
#: Boilerplate lines that are broadcast at most; beyond it each page's are joined by shuffle.
BROADCAST_ROWS = 200_000


def _hashes() -> Column:
    """Hashes of a text's lines as they are compared; null for lines without a word."""
    return F.transform(normal_lines(F.col("text")), lambda x: F.when(x != "", F.xxhash64(x)))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """(host, line): hashes of the lines that are on more than `ratio` of the host's pages (host, page, hashes), and on `least` of them."""
    total = pages.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    often = host_lines(pages).where(F.col("pages") >= least).join(total, "host").where(F.col("pages") > ratio * F.col("total"))
    return often.select("host", "line")


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """docs with boilerplate lines taken out of `text`, and n_lines, n_dropped (long; null texts: 0).

    A line is compared without regard to case and blanks; a line without a word is never boilerplate. A line goes if
    it is on more than `ratio` of the host's pages, and on `least` of them. A page is a doc_id with its text (copies_once: a text). Other lines and
    their line feeds stay as they are. host: the column source; rows without one, null and empty texts stay. Columns of docs that are
    called n_lines or n_dropped are replaced. Repeated rows are repeated and count once.
    """
    page = page_key(copies_once)
    pages = docs.where("source is not null and text is not null").select(F.col("source").alias("host"), page.alias("page"), F.array_compact(_hashes()).alias("hashes"))
    pages = materialise(pages, "site-lines")
    often = materialise(boilerplate(pages, ratio, least), "boilerplate")
    d = docs.drop("n_lines", "n_dropped")
    if often.count() <= BROADCAST_ROWS:
        lists = often.groupBy("host").agg(F.collect_list("line").alias("_often")).withColumnRenamed("host", "_host")
        d = d.join(F.broadcast(lists), d["source"] == lists["_host"], "left").drop("_host")
    else:
        own = pages.select("host", "page", F.explode(F.array_distinct("hashes")).alias("line")).distinct()
        lists = own.join(often, ["host", "line"]).groupBy("host", "page").agg(F.collect_list("line").alias("_often"))
        lists = lists.select(F.col("host").alias("_host"), F.col("page").alias("_page"), "_often")
        d = d.withColumn("_own", page).join(lists, (F.col("source") == F.col("_host")) & (F.col("_own") == F.col("_page")), "left").drop("_host", "_page", "_own")
    has = F.size("_often") > 0
    d = once(d, F.when(has, _hashes()).alias("_hash"))
    d = once(d, F.when(has, F.array_intersect("_hash", "_often")).alias("_gone"))
    some = F.coalesce(F.size("_gone") > 0, F.lit(False))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.coalesce(F.array_contains("_gone", F.col("_hash")[i]), F.lit(False)))
    gone = F.filter("_hash", lambda x: F.array_contains("_gone", x))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    new = F.when(some, F.array_join(kept, "\n")).otherwise(F.col("text"))
    out = (new.alias("_new"), n_lines.cast("long").alias("n_lines"), F.when(some, F.size(gone)).otherwise(F.lit(0)).cast("long").alias("n_dropped"))
    d = once(d, *out).withColumn("text", F.col("_new"))
    return d.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def op10_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drop_boilerplate(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


_OP10 = r"""
with d as (select *, row_number() over () as row from documents), l as (
  select row, doc_id, source, text, i, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) as norm
  from (select row, doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i, unnest(string_split(text, chr(10))) as line from d)
), page as (
  select distinct source, doc_id, text from d where source is not null and text is not null
), total as (
  select source, count(*) as total from page group by source
), often as (
  select source, norm from (select distinct source, doc_id, text, norm from l where source is not null and norm <> '') join total using (source)
  group by source, norm, total having count(*) >= 2 and count(*) > 0.05 * total
), marked as (
  select l.*, o.norm is not null as gone from l left join often o on l.source = o.source and l.norm = o.norm
), lines as (
  select row, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped, coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '') as kept
  from marked group by row
)
select doc_id, source, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped, sha256(kept) as text_sha256
from d left join lines using (row)
"""
QUERIES = {"op10_site_line_dedup": op10_site_line_dedup}
SQL = {"op10_site_line_dedup": _OP10}
