"""Algebra of closed intervals (chr, start, end, ...): merging, complement, overlap joins and best overlap.

Range joins are equi-joins on (chr, bin): Spark has no range join, and a join on chr alone would put a whole
chromosome in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from genoflux.scratch import materialise

#: Width of a bin, of positions.
BIN = 1 << 14


def overlap_amount(s1, e1, s2, e2) -> Column:
    """Positions that two closed intervals share, 0 if none."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def overlaps(s1, e1, s2, e2) -> Column:
    return (s1 <= e2) & (s2 <= e1)


def contains(s1, e1, s2, e2) -> Column:
    """The first interval holds the second."""
    return (s1 <= s2) & (e2 <= e1)


def contains_point(s, e, p) -> Column:
    return (s <= p) & (p <= e)


def left_of(e1, s2) -> Column:
    """The first interval lies wholly before the second."""
    return e1 < s2


def reaches(chr1, e1, chr2, s2) -> Column:
    """Of two intervals in order, whether the first goes on to the start of the second."""
    return (chr1 == chr2) & (e1 >= s2)


def before(chr1, s1, chr2, s2) -> Column:
    """Strict order by chromosome and start."""
    return (chr1 < chr2) | ((chr1 == chr2) & (s1 < s2))


def with_previous(df: DataFrame, by: str, at: str, value: str, out: str, width: int = 1 << 20) -> DataFrame:
    """df with `out`: the value of the row before it by `at` among rows of equal `by`; null for the first.

    Neighbours are found inside slices; the first row of a slice takes the last of the slice before that has any.
    """
    d = df.withColumn("_slice", F.floor(F.col(at) / width))
    last = d.groupBy(by, "_slice").agg(F.max(F.struct(at, value)).alias("_last"))
    before = last.select(by, "_slice", F.lag("_last").over(W.partitionBy(by).orderBy("_slice")).alias("_before"))
    d = d.withColumn(out, F.lag(value).over(W.partitionBy(by, "_slice").orderBy(at, value)))
    return d.join(before, [by, "_slice"]).withColumn(out, F.coalesce(out, F.col(f"_before.{value}"))).drop("_slice", "_before")


def merge(df: DataFrame, gap: int = 0, width: int = 1 << 20) -> DataFrame:
    """(chr, start, end): intervals joined where one starts at most `gap` after the end of those before.

    Islands are found in slices of a chromosome, which know how far intervals of earlier slices reach. Only the
    island that goes on into a slice and the last one of a slice are put together over the slices, at most two for
    each, so that no task sees a chromosome.
    """
    d = df.select("chr", "start", "end").withColumn("_slice", F.floor(F.col("start") / width))
    reach = d.groupBy("chr", "_slice").agg(F.max("end").alias("_end"))
    over = W.partitionBy("chr").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    reach = reach.select("chr", "_slice", F.max("_end").over(over).alias("_reach"))
    w = W.partitionBy("chr", "_slice").orderBy("start", "end")
    before = F.greatest(F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("_reach"))
    d = d.join(reach, ["chr", "_slice"]).withColumn("_new", F.coalesce(F.col("start") > before + gap, F.lit(True)).cast("int"))
    d = d.withColumn("_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    part = d.groupBy("chr", "_slice", "_no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    part = part.withColumn("_border", (F.col("_no") == 0) | (F.col("_no") == F.max("_no").over(W.partitionBy("chr", "_slice"))))
    along = W.partitionBy("chr").orderBy("_slice", "_no").rowsBetween(W.unboundedPreceding, 0)
    edge = part.where("_border").withColumn("_island", F.sum((F.col("_no") > 0).cast("int")).over(along))
    edge = edge.groupBy("chr", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return part.where("not _border").select("chr", "start", "end").unionByName(edge.select("chr", "start", "end"))


def gaps(merged: DataFrame, first: int, last: DataFrame | int) -> DataFrame:
    """(chr, start, end): what lies between merged intervals, and from `first` and up to `last` (a position, or (chr, last))."""
    d = with_previous(merged, "chr", "start", "end", "_prev")
    inner = d.select("chr", (F.coalesce("_prev", F.lit(first - 1)) + 1).alias("start"), (F.col("start") - 1).alias("end"))
    tail = merged.groupBy("chr").agg((F.max("end") + 1).alias("start"))
    tail = tail.withColumn("last", F.lit(last).cast("bigint")) if isinstance(last, int) else tail.join(last, "chr")
    return inner.unionByName(tail.select("chr", "start", F.col("last").alias("end"))).where("start <= end")


def complement(df: DataFrame, length: int) -> DataFrame:
    """(chr, start, end): maximal closed runs of 0..length-1 outside the intervals, on chromosomes that have some."""
    return gaps(materialise(merge(df, 1), "merged"), 0, length - 1)


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


#: How much wider bins of the next level are, and how many levels there are: an interval is put in bins of the first of which it takes that many at most.
STEP, LEVELS = 64, 3


def _level(start: Column, end: Column, width: int) -> Column:
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(end - start + 1 <= width * STEP ** (k + 1), k).otherwise(out)
    return out


def _placed(df: DataFrame, start: str, end: str, width: int, prefix: str) -> DataFrame:
    """A row for each bin of each level from an interval's own on, those above being one or two."""
    own = _level(F.col(start), F.col(end), width)
    none = F.array().cast("array<struct<level:int,bin:bigint>>")
    each = F.lit(None)
    for k in range(LEVELS):
        w, level = width * STEP**k, F.lit(k).alias("level")
        bins = F.transform(F.sequence(F.floor(F.col(start) / w), F.floor(F.col(end) / w)), lambda b: F.struct(level, b.alias("bin")))  # noqa: B023
        here = F.when(own <= k, bins).otherwise(none)
        each = here if k == 0 else F.concat(each, here)
    return df.withColumn(f"{prefix}own", own).select("*", F.inline(each).alias(f"{prefix}level", f"{prefix}bin"))


def overlap_join(left: DataFrame, right: DataFrame, width: int = BIN, long: bool = False) -> DataFrame:
    """All columns of left, and of right with the prefix r_, for each pair of overlapping intervals.

    long: for intervals of any length, as those of whole chromosomes. Bins then have levels, and two intervals meet at the level of the longer one, so that
    none is repeated more than STEP times or so, where otherwise one is for each of its bins; short ones cost some LEVELS rows each.
    """
    if long:
        a = _placed(left, "start", "end", width, "_")
        b = _placed(right.select([F.col(c).alias(f"r_{c}") for c in right.columns]), "r_start", "r_end", width, "_r")
        met = (a["chr"] == b["r_chr"]) & (a["_level"] == b["_rlevel"]) & (a["_bin"] == b["_rbin"]) & overlaps(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
        first = F.floor(F.greatest("start", "r_start") / (width * F.pow(F.lit(float(STEP)), F.col("_level"))))
        pair = a.join(b, met).where((F.col("_level") == F.greatest("_own", "_rown")) & (F.col("_bin") == first))
        return pair.drop("_own", "_level", "_bin", "_rown", "_rlevel", "_rbin")
    a = left.withColumn("_bin", _bins(F.col("start"), F.col("end"), width))
    b = right.select([F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_rbin", _bins(F.col("r_start"), F.col("r_end"), width))
    pair = a.join(b, (a["chr"] == b["r_chr"]) & (a["_bin"] == b["_rbin"]) & overlaps(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")))
    first = F.floor(F.greatest("start", "r_start") / width)  # in one bin only, of those that the pair shares
    return pair.where(F.col("_bin") == first).drop("_bin", "_rbin")


def _overlapping(left: DataFrame, right: DataFrame, how: str, width: int) -> DataFrame:
    """Rows of left by whether they overlap an interval of right. Rows up to `width` long are keyed by the bin of their start alone, and right is
    in every bin from which they can reach it; longer ones are looked up in all their bins, once for each different row."""
    b = right.select(F.col("chr").alias("_chr"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    size = F.col("end") - F.col("start") + 1
    a = left.where(size <= width).withColumn("_bin", F.floor(F.col("start") / width))
    near = b.withColumn("_rbin", F.explode(F.sequence(F.floor(F.col("_s") / width) - 1, F.floor(F.col("_e") / width))))
    on = lambda x, y: (x["chr"] == y["_chr"]) & (x["_bin"] == y["_rbin"]) & overlaps(x["start"], x["end"], y["_s"], y["_e"])
    short = a.join(near, on(a, near), how).drop("_bin")
    far = b.withColumn("_rbin", _bins(F.col("_s"), F.col("_e"), width))
    long = left.where(size > width)
    each = long.select("chr", "start", "end").distinct().withColumn("_bin", _bins(F.col("start"), F.col("end"), width))
    hit = each.join(far, on(each, far), "left_semi").select("chr", "start", "end").distinct()
    return short.unionByName(long.join(hit, ["chr", "start", "end"], how).select(left.columns))


def overlap_anti(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Rows of left that overlap no interval of right."""
    return _overlapping(left, right, "left_anti", width)


def overlap_semi(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    return _overlapping(left, right, "left_semi", width)


def without_points_in(df: DataFrame, points: dict[str, Column], right: DataFrame, width: int = BIN) -> DataFrame:
    """Rows of df none of whose points lies in an interval of right on the same chr."""
    b = right.select(F.col("chr").alias("_chr"), F.col("start").alias("_s"), F.col("end").alias("_e"), _bins(F.col("start"), F.col("end"), width).alias("_rbin"))
    for name, p in points.items():
        d = df.withColumn(f"_{name}", p)
        x = d[f"_{name}"]
        df = d.join(b, (d["chr"] == b["_chr"]) & (F.floor(x / width) == b["_rbin"]) & contains_point(b["_s"], b["_e"], x), "left_anti").drop(f"_{name}")
    return df


def screen_links(links: DataFrame, breaks: DataFrame, tolerance: int) -> DataFrame:
    """Links (chr, from, to, type, ...) neither of whose ends, moved inwards by the tolerance, is in a break.

    The left end moves right but for type 3, the right end moves left but for type 2.
    """
    left = F.col("from") + F.when(F.col("type") == 3, -tolerance).otherwise(tolerance)
    right = F.col("to") - F.when(F.col("type") == 2, -tolerance).otherwise(tolerance)
    return without_points_in(links, {"left": left, "right": right}, breaks)


def best_overlap(query: DataFrame, db: DataFrame, key: str = "id") -> DataFrame:
    """Each query row with what overlaps it: best share, its share of the match, counts, differences and lists.

    Best: most shared positions, then smallest start and end. Ratios have four decimals. No match: 0, and null differences.
    """
    hit = overlap_join(query.select(key, "chr", "start", "end"), db.select("chr", "start", "end").distinct())
    hit = hit.withColumn("ov", overlap_amount(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")))
    size = F.col("r_end") - F.col("r_start") + 1
    order = F.struct(-F.col("ov"), "r_start", "r_end")
    agg = hit.groupBy(key).agg(
        F.min(order).alias("b"), F.count(F.lit(1)).alias("n"), F.sum("ov").alias("ov"), F.sum(size).alias("size"),
        F.array_sort(F.collect_list(F.struct("r_start", "r_end", "ov"))).alias("all"),
    )
    d = query.join(agg, key, "left")
    own = F.col("end") - F.col("start") + 1
    ratio = lambda a, b: F.round(F.coalesce(a / b, F.lit(0.0)), 4)
    bs, be, bo = F.col("b.r_start"), F.col("b.r_end"), -F.col("b.col1")
    cell = lambda x, of: F.format_string("%.4f", x / of)
    others = F.filter("all", lambda x: (x["r_start"] != bs) | (x["r_end"] != be))
    return d.select(
        key, "chr", "start", "end",
        ratio(bo, own).alias("best_share"), ratio(bo, be - bs + 1).alias("best_match_share"), F.coalesce("n", F.lit(0)).alias("matches"),
        F.abs(bs - F.col("start")).alias("start_diff"), F.abs(be - F.col("end")).alias("end_diff"),
        ratio(F.col("ov"), own).alias("covered"), ratio(F.col("ov"), F.col("size")).alias("match_covered"),
        F.array_join(F.transform("all", lambda x: F.concat_ws("\t", x["r_start"], x["r_end"])), "\t").alias("match_list"),
        F.array_join(F.transform(others, lambda x: F.concat_ws("\t", cell(x["ov"], own), cell(x["ov"], x["r_end"] - x["r_start"] + 1))), "\t").alias("other_shares"),
        own.alias("length"),
    )


#: Columns of each annotation mode.
MODES = {
    "default": ["best_share"], "full": ["best_share", "best_match_share", "matches", "length", "other_shares"],
    "full2": ["best_share", "best_match_share", "matches"], "full3": ["best_share", "best_match_share", "matches", "start_diff", "end_diff"],
    "full4": ["covered", "match_covered", "matches"], "full5": ["best_share", "best_match_share", "matches", "match_list"],
}


def annotate(query: DataFrame, db: DataFrame, mode: str = "default", key: str = "id") -> DataFrame:
    return best_overlap(query, db, key).select(key, "chr", "start", "end", *MODES[mode])


def contained_links(regions: DataFrame, links: DataFrame, slack: int = 3000, key: str = "id") -> DataFrame:
    """Each region with the links that lie inside it, widened by slack, as one tab-separated list in (from, to, id) order."""
    wide = regions.select(key, "chr", (F.col("start") - slack).alias("start"), (F.col("end") + slack).alias("end"))
    l = links.select("chr", F.col("from").alias("start"), F.col("to").alias("end"), F.col("id").alias("link"))
    inside = overlap_join(wide, l).where(contains(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")))
    got = inside.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r_start", "r_end", "r_link"))).alias("x"))
    return regions.join(got, key, "left").select(key, F.coalesce(F.array_join(F.transform("x", lambda v: v["r_link"].cast("string")), "\t"), F.lit("")).alias("links"))


def locate(points: DataFrame, segments: DataFrame, width: int = BIN) -> DataFrame:
    """points (chr, pos, ...) with seg_start and seg_id of the last segment (chr, start, id) that starts at or before pos; null if none.

    Points and segments are put in order inside bins, and each point takes the last segment before it. A bin
    with points also holds the last segment of the bins before, so that no bin needs another. Of segments with one start the largest id counts.
    """
    seg = F.struct(F.col("start").cast("bigint").alias("start"), F.col("id").alias("id"))
    s = segments.select("chr", F.floor(F.col("start") / width).alias("_bin"), seg.alias("_seg"))
    p = points.select("chr", F.floor(F.col("pos") / width).alias("_bin"), F.struct(*points.columns).alias("_row"))
    last = s.groupBy("chr", "_bin").agg(F.max("_seg").alias("_last"))
    every = last.unionByName(p.select("chr", "_bin").distinct(), allowMissingColumns=True).groupBy("chr", "_bin").agg(F.max("_last").alias("_last"))
    w = W.partitionBy("chr").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    carried = every.select("chr", "_bin", F.last("_last", ignorenulls=True).over(w).alias("_seg")).where("_seg is not null")
    both = s.unionByName(carried).unionByName(p, allowMissingColumns=True)
    w = W.partitionBy("chr", "_bin").orderBy(F.coalesce("_seg.start", "_row.pos"), F.col("_row").isNotNull(), "_seg.id").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_seg", F.last("_seg", ignorenulls=True).over(w)).where("_row is not null")
    return both.select("_row.*", F.col("_seg.start").alias("seg_start"), F.col("_seg.id").alias("seg_id"))
