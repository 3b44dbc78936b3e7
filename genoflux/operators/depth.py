"""Depth along the genome: spikes, masks, GC-dependent expectation, ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from genoflux.functions.sequence import letter_stretches, pieces
from genoflux.scratch import materialise
from genoflux.shipping import ship

from .intervals import BIN, locate, merge, overlap_amount, overlap_join


def spikes(cov: DataFrame, low: float, high: float, width: int = 1 << 20) -> DataFrame:
    """(chr, start, end, state): maximal runs of adjacent positions that are all low (at most `low`) or all high (at least `high`).

    Runs are found within slices of a chromosome and joined over their borders.
    """
    d = cov.select("chr", "pos", F.when(F.col("cov") <= low, "low").when(F.col("cov") >= high, "high").alias("state")).where("state is not null")
    d = d.withColumn("_slice", F.floor(F.col("pos") / width))
    by = W.partitionBy("chr", "_slice", "state").orderBy("pos")
    part = d.withColumn("_run", F.col("pos") - F.row_number().over(by)).groupBy("chr", "_slice", "state", "_run").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    # only runs at a border of their slice may go on beyond it: at most two of a state for each slice
    border = (F.col("start") % width == 0) | ((F.col("end") + 1) % width == 0)
    w = W.partitionBy("chr", "state").orderBy("start")
    new = F.coalesce(F.col("start") != F.lag("end").over(w) + 1, F.lit(True)).cast("int")
    edge = part.where(border).withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    edge = edge.groupBy("chr", "state", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cols = ["chr", "start", "end", "state"]
    return part.where(~border).select(*cols).unionByName(edge.select(*cols))


def pad_spikes(runs: DataFrame, by: int = 2, length: int | None = None) -> DataFrame:
    """High runs widened on both sides, within 1 and length."""
    end = F.col("end") + by
    return runs.where("state = 'high'").select("chr", F.greatest(F.col("start") - by, F.lit(1)).alias("start"), (end if length is None else F.least(end, F.lit(length))).alias("end"))


def sequence_pieces(seqs: DataFrame, size: int = 1 << 14) -> DataFrame:
    """(id, start, seq): sequences (id, seq) in pieces of `size` letters, from 1. Pieces, as a reader gives them, stay as they are."""
    if "start" in seqs.columns:
        return seqs.select("id", "start", "seq")
    d = seqs.select("id", F.posexplode(pieces(F.col("seq"), size)).alias("k", "seq"))
    return d.select("id", (F.col("k") * F.lit(size).cast("bigint") + 1).alias("start"), "seq")


def letter_runs(seqs: DataFrame, letters: str = "nN") -> DataFrame:
    """(id, start, end): maximal runs of the letters in each sequence, from 1. seqs: (id, seq), or pieces (id, start, seq).

    Runs are found in each piece and joined over the pieces' borders.
    """
    d = sequence_pieces(seqs)

    def run(batches):
        for b in batches:
            for i, raw, at in letter_stretches(b.column(2)):
                piece, first, last = _runs_of(raw, at, letters)
                size = np.diff(at)[piece]
                start = b.column(1).to_numpy()[i + piece]
                border = (first == 0) | (last == size - 1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + piece)), pa.array(start + first), pa.array(start + last), pa.array(border)], ["id", "start", "end", "border"])

    ship(seqs.sparkSession)
    d = d.select("id", F.col("start").cast("bigint").alias("start"), "seq").where("length(seq) > 0")
    d = materialise(d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, start long, end long, border boolean"), "letter-runs")
    # only runs at a border of their piece may go on beyond it: two at most for each
    edge = merge(d.where("border").select(F.col("id").alias("chr"), "start", "end"), 1).select(F.col("chr").alias("id"), "start", "end")
    return d.where("not border").select("id", "start", "end").unionByName(edge)


def _runs_of(raw: np.ndarray, at: np.ndarray, letters: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first, last) of each run of letters, places from 0 in its piece; pieces begin at `at`, whose last is the end of all."""
    hit = np.zeros(len(raw) + 1, bool)
    for c in set(letters):
        hit[:-1] |= raw == ord(c)
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    first = np.flatnonzero(hit[:-1] & (cut[:-1] | ~np.r_[False, hit[:-2]])) if len(raw) else np.zeros(0, np.int64)
    last = np.flatnonzero(hit[:-1] & (cut[1:] | ~hit[1:]))
    piece = np.searchsorted(at, first, "right") - 1
    return piece, first - at[piece], last - at[piece]


def count_letters(s: Column, letters: str) -> Column:
    return F.length(s) - F.length(F.translate(s, letters, ""))


def gc_bin(gc: Column, at: Column, bins: int = 50) -> Column:
    """Bin of a share of G and C; null where there is neither."""
    percent = F.floor(gc * 100 / (gc + at))
    return F.when(gc + at > 0, F.least(F.floor(percent * bins / 100), F.lit(bins - 1))).cast("bigint")


def _windows(pieces_: DataFrame, size: int, letters: str, bins: int) -> DataFrame:
    """(id, win, len, gc, at, masked, bin) of windows of pieces (id, start, seq, m): letters are counted in each piece, and a window over several is put together.
    masked: unknown letters, and positions in intervals of m (a list of s and e)."""
    counted = ["len", "gc", "at", "masked"]

    def run(batches):
        for b in batches:
            for i, raw, at in letter_stretches(b.column(2)):
                start = b.column(1).to_numpy()[i : i + len(at) - 1]
                who, win, begin = _window_parts(start, at, size)
                hidden = _any_of(raw, letters) | _inside(b.column(3).slice(i, len(start)), start, at)
                each = [np.add.reduceat(x, begin, dtype=np.int32) for x in (_any_of(raw, "gcGC"), _any_of(raw, "atAT"), hidden)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + who)), pa.array(win.astype(np.int32)), pa.array(np.diff(np.r_[begin, len(raw)]).astype(np.int32)), *map(pa.array, each)], ["id", "win", *counted])

    ship(pieces_.sparkSession)
    d = pieces_.where("length(seq) > 0").select("id", F.col("start").cast("bigint").alias("start"), "seq", "m")
    d = d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, win int, len int, gc int, at int, masked int")
    d = d.groupBy("id", "win").agg(*(F.sum(c).cast("int").alias(c) for c in counted))
    return d.withColumn("bin", gc_bin(F.col("gc"), F.col("at"), bins))


def _any_of(raw: np.ndarray, letters: str) -> np.ndarray:
    hit = np.zeros(len(raw), bool)
    for c in set(letters):
        hit |= raw == ord(c)
    return hit


def _window_parts(start: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, window, begin) of the parts that windows cut pieces into, of which none is empty; a piece begins at position `start` of its sequence, and at `at`."""
    first = (start - 1) // size
    n = (start + np.diff(at) - 2) // size - first + 1
    who = np.repeat(np.arange(len(start)), n)
    win = first[who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    return who, win, at[who] + np.maximum(win * size + 1 - start[who], 0)


def _inside(lists: pa.Array, start: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which letters of pieces lie in the intervals of their lists; null: none."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    step = np.zeros(int(at[-1]) + 1, np.int32)
    if n.sum():
        s, e = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
        who = np.repeat(np.arange(len(start)), n)
        s, e = np.maximum(s, start[who]), np.minimum(e, start[who] + np.diff(at)[who] - 1)
        s, e, who = (x[s <= e] for x in (s, e, who))
        np.add.at(step, at[who] + s - start[who], 1)
        np.add.at(step, at[who] + e - start[who] + 1, -1)
    return np.cumsum(step[:-1]) > 0


_LIST = "array<struct<s:bigint,e:bigint>>"


def gc_windows(seqs: DataFrame, size: int = 500, bins: int = 50) -> DataFrame:
    """(id, win, len, gc, at, bin) of consecutive windows of each sequence; the last may be shorter. seqs: (id, seq), or pieces (id, start, seq)."""
    return _windows(sequence_pieces(seqs).withColumn("m", F.lit(None).cast(_LIST)), size, "", bins).drop("masked")


def masked_windows(seqs: DataFrame, masks: DataFrame, size: int = 500, bins: int = 50, letters: str = "nN") -> DataFrame:
    """gc_windows with masked: how many positions of a window are unknown letters or lie in masks (chr, start, end), which may overlap.

    Masks go to the pieces of the sequences that they reach, so that runs of unknown letters, of which a sequence may have as many as it has other letters, are
    never rows.
    """
    width = size * max(1, BIN // size)
    p = sequence_pieces(seqs, width)
    if "start" in seqs.columns:
        end = F.col("start") + F.length("seq") - 1
        p = p.where("length(seq) > 0").withColumn("_bin", F.explode(F.sequence(F.floor((F.col("start") - 1) / width), F.floor((end - 1) / width))))
        first = F.greatest(F.col("_bin") * width + 1, F.col("start"))
        s = F.substring("seq", (first - F.col("start") + 1).cast("int"), (F.least((F.col("_bin") + 1) * width, end) - first + 1).cast("int"))
        p = p.select("id", first.alias("start"), s.alias("seq"), "_bin")
    else:
        p = p.withColumn("_bin", F.floor((F.col("start") - 1) / width))
    return _windows(p.join(_parts_of(masks, width, "_bin"), ["id", "_bin"], "left"), size, letters, bins)


def _parts_of(masks: DataFrame, width: int, name: str) -> DataFrame:
    """(id, bin, m): the parts of masks (chr, start, end) in each bin of `width` positions that they reach, from the first on; a column `name` has the bin."""
    bin_ = F.col(name)
    d = masks.where("start <= end and end >= 1").select("chr", "start", "end", F.explode(F.sequence(F.floor((F.greatest("start", F.lit(1)) - 1) / width), F.floor((F.col("end") - 1) / width))).alias(name))
    part = F.struct(F.greatest("start", bin_ * width + 1).cast("bigint").alias("s"), F.least("end", (bin_ + 1) * width).cast("bigint").alias("e"))
    return d.groupBy(F.col("chr").alias("id"), name).agg(F.array_sort(F.collect_set(part)).alias("m"))


def unmasked(windows: DataFrame, masks: DataFrame, size: int = 500) -> DataFrame:
    """The windows (id, win, len, ...) that no mask (chr, start, end) touches; masks are put in windows, the last of which may end before a mask begins."""
    win = F.explode(F.sequence(F.floor((F.greatest("start", F.lit(1)) - 1) / size), F.floor((F.col("end") - 1) / size)))
    m = masks.where("start <= end and end >= 1").select(F.col("chr").alias("_chr"), "start", win.alias("_win"))
    m = m.groupBy("_chr", "_win").agg(F.min("start").alias("_first"))
    return windows.join(m, (windows["id"] == m["_chr"]) & (windows["win"] == m["_win"]) & (F.col("_first") <= F.col("win").cast("bigint") * size + F.col("len")), "left_anti")


def expected_in_windows(windows: DataFrame, lam: DataFrame) -> DataFrame:
    """(id, positions, known, expected) of sequences by their windows (id, win, len, bin, masked): positions, those with an expected depth, and the sum of it. lam:
    (bin, lam) of every bin. Masked positions, and those of windows without a known letter, have none."""
    open_ = F.col("len") - F.col("masked")
    d = windows.join(F.broadcast(lam), "bin", "left").groupBy("id")
    return d.agg(F.sum("len").alias("positions"), F.sum(F.when(F.col("lam").isNotNull(), open_).otherwise(0)).alias("known"), F.sum(F.when(open_ > 0, F.col("lam").cast("decimal(18,6)") * open_)).cast("double").alias("expected"))


def window_intervals(windows: DataFrame, size: int = 500) -> DataFrame:
    """Windows (id, win, len, ...) with chr, start, end."""
    start = F.col("win").cast("bigint") * size + 1
    return windows.withColumn("chr", F.col("id")).withColumn("start", start).withColumn("end", start + F.col("len") - 1)


def position_lambda(windows: DataFrame, masks: DataFrame, lam: DataFrame, size: int = 500) -> DataFrame:
    """(chr, start, end, lam): expected depth along each sequence, as maximal stretches of a window in which it is the same.

    windows: (id, win, len, bin); masks: (chr, start, end), unknown letters included; lam: (bin, lam) of every bin, a row for each. Masked positions,
    and those of windows without a known letter, have no expected depth.
    """
    w = window_intervals(windows, size).select("chr", "win", "start", "end", "bin").join(F.broadcast(lam), "bin", "left")
    hit = _parts_of(merge(masks, 1), size, "win").select(F.col("id").alias("chr"), F.col("win").cast("int").alias("win"), "m")
    # a mask may reach beyond the end of the last window
    m = F.filter(F.transform("m", lambda x: F.struct(x["s"].alias("s"), F.least(x["e"], "end").alias("e"))), lambda x: x["s"] <= x["e"])
    d = w.join(hit, ["chr", "win"], "left").withColumn("m", F.coalesce(m, F.array().cast(_LIST)))
    open_ = F.arrays_zip(F.concat(F.array("start"), F.transform("m", lambda x: x["e"] + 1)).alias("s"), F.concat(F.transform("m", lambda x: x["s"] - 1), F.array("end")).alias("e"))
    own = F.transform(F.filter(open_, lambda x: x["s"] <= x["e"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.col("lam").alias("lam")))
    none = F.transform("m", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(None).cast("double").alias("lam")))
    d = d.select("chr", F.explode(F.concat(own, none)).alias("x"))
    return d.select("chr", F.col("x.s").alias("start"), F.col("x.e").alias("end"), "x.lam")


def bin_lambda(windows: DataFrame) -> DataFrame:
    """(bin, hits, length, lam): arrivals per position of windows (bin, hits, len) of each bin."""
    d = windows.where("bin is not null").groupBy("bin").agg(F.sum("hits").alias("hits"), F.sum("len").alias("length"))
    return d.withColumn("lam", F.round(F.col("hits") / F.col("length"), 6))


def fill_lambda(lam: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, lam) of every bin: its own if positive, else the nearest positive one below (upper half) or above (lower half), else 0."""
    every = lam.sparkSession.range(bins).select(F.col("id").alias("bin")).join(lam.where("lam > 0").select("bin", "lam"), "bin", "left")
    w = W.orderBy("bin")  # a row for each of a fixed number of bins
    down = F.last("lam", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    up = F.first("lam", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return every.select("bin", F.coalesce(F.when(F.col("bin") * 2 > bins, down).otherwise(up), F.lit(0.0)).alias("lam"))


def gc_content(seqs: DataFrame, start: int, end: int) -> DataFrame:
    """(id, gc, known): share of G and C among A, C, G, T of seq[start..end] (from 1, closed), and share of those letters."""
    s = F.substring("seq", start, end - start + 1)
    d = seqs.select("id", count_letters(s, "gcGC").alias("g"), count_letters(s, "acgtACGT").alias("n"), F.length(s).alias("len")).where("len > 0")
    return d.select("id", F.round(F.try_divide("g", "n"), 6).alias("gc"), F.round(F.col("n") / F.col("len"), 6).alias("known"))


def gc_content_of(seqs: DataFrame, regions: DataFrame) -> DataFrame:
    """(id, start, end, gc, known) of each of regions (id, start, end) of sequences (id, seq) or pieces (id, start, seq), as gc_content has it."""
    p = sequence_pieces(seqs)
    p = p.select(F.col("id").alias("chr"), "start", (F.col("start") + F.length("seq") - 1).alias("end"), "seq")
    j = overlap_join(regions.select(F.col("id").alias("chr"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")).distinct(), p)
    first = F.greatest("start", "r_start")
    s = F.substring("r_seq", (first - F.col("r_start") + 1).cast("int"), (F.least("end", "r_end") - first + 1).cast("int"))
    d = j.select(F.col("chr").alias("id"), "start", "end", s.alias("s"))
    d = d.groupBy("id", "start", "end").agg(F.sum(count_letters(F.col("s"), "gcGC")).alias("g"), F.sum(count_letters(F.col("s"), "acgtACGT")).alias("n"), F.sum(F.length("s")).alias("len"))
    return d.select("id", "start", "end", F.round(F.try_divide("g", "n"), 6).alias("gc"), F.round(F.col("n") / F.col("len"), 6).alias("known"))


def positions_in(regions: DataFrame, cov: DataFrame, width: int = BIN) -> DataFrame:
    """Columns of regions (chr, start, end, ...) and pos, cov, lam of each position inside."""
    r = regions.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    c = cov.select(F.col("chr").alias("_chr"), "pos", "cov", "lam", F.floor(F.col("pos") / width).alias("_pbin"))
    return r.join(c, (r["chr"] == c["_chr"]) & (r["_bin"] == c["_pbin"]) & F.col("pos").between(F.col("start"), F.col("end"))).drop("_bin", "_pbin", "_chr")


def depth_ratio(regions: DataFrame, cov: DataFrame, key: str = "id") -> DataFrame:
    """(key, ratio, masked, total): depth over expected depth where that is known and positive, positions without, all depth."""
    good = F.col("lam") > 0
    got = positions_in(regions, cov).groupBy(key).agg(
        F.sum(F.when(good, F.col("cov"))).alias("c"), F.sum(F.when(good, F.col("lam"))).alias("l"),
        F.sum(F.when(good, 0).otherwise(1)).alias("masked"), F.sum("cov").alias("total"),
    )
    d = regions.select(key).join(got, key, "left")
    return d.select(key, F.round(F.try_divide("c", "l"), 6).alias("ratio"), F.coalesce("masked", F.lit(0)).alias("masked"), F.round(F.coalesce("total", F.lit(0.0)), 6).alias("total"))


def edge_hits(parts: DataFrame, masks: DataFrame, cov: DataFrame, free_length: int = 0) -> DataFrame:
    """(edge_id, hits, expected, unmasked, paths, lam, called): sums over the unmasked positions of an edge's occurrences.

    parts: (edge_id, occ, chr, start, end), one row for each occurrence. unmasked: positions with a depth that no mask
    covers. lam: expected / unmasked, 0 without any; called: unmasked over occurrences, rounded down.
    """
    from .intervals import without_points_in

    seen = without_points_in(cov, {"p": F.col("pos")}, masks)
    got = positions_in(parts, seen).groupBy("edge_id", "occ").agg(F.sum("cov").alias("h"), F.sum("lam").alias("x"), F.count(F.lit(1)).alias("u"))
    d = parts.select("edge_id", "occ").join(got, ["edge_id", "occ"], "left").groupBy("edge_id").agg(
        F.round(F.coalesce(F.sum("h"), F.lit(0.0)), 6).alias("hits"), F.round(F.coalesce(F.sum("x"), F.lit(0.0)), 6).alias("expected"),
        F.coalesce(F.sum("u"), F.lit(0)).alias("unmasked"), F.count(F.lit(1)).alias("paths"),
    )
    free = F.col("unmasked") <= free_length
    return d.withColumn("lam", F.round(F.when(free, 0.0).otherwise(F.try_divide("expected", "unmasked")), 6)).withColumn("called", F.expr("unmasked div paths"))


def _known_depth(runs: DataFrame, cov: DataFrame) -> DataFrame:
    """cov (chr, pos, cov) with lam, of the positions whose stretch (chr, start, end, lam) has an expected depth."""
    seg = runs.select("chr", "start", F.struct("end", "lam").alias("id"))
    d = locate(cov.select("chr", "pos", "cov"), seg)
    return d.where("seg_id.lam is not null and pos <= seg_id.end").select("chr", "pos", "cov", F.col("seg_id.lam").alias("lam"))


def _per_region(regions: DataFrame, runs: DataFrame, key: list[str], where: str) -> DataFrame:
    """(key, x, n) of regions (chr, start, end, key): expected depth over their positions in stretches for which `where` holds, and how many these are."""
    j = overlap_join(regions.select(*key, "chr", "start", "end"), runs.where(where).select("chr", "start", "end", "lam"), long=True)
    n = overlap_amount(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    return j.groupBy(*key).agg(F.sum(F.col("r_lam").cast("decimal(18,6)") * n).cast("double").alias("x"), F.sum(n).alias("n"))


def edge_sums(parts: DataFrame, runs: DataFrame, cov: DataFrame) -> DataFrame:
    """(edge_id, hits, expected, unmasked, paths) of edges by their occurrences (edge_id, occ, chr, start, end), which don't overlap: depth, expected depth and
    number of the positions that have one. runs: (chr, start, end, lam); cov: (chr, pos, cov) of positions with depth.

    Positions without depth are only in the lengths of stretches, and those with depth find their occurrence by the last start before them, so that
    no occurrence, however long, is taken apart for them.
    """
    seg = parts.select("chr", "start", F.struct("end", "edge_id").alias("id"))
    at = locate(_known_depth(runs, cov).drop("lam"), seg).where("pos <= seg_id.end")
    hits = at.groupBy(F.col("seg_id.edge_id").alias("edge_id")).agg(F.round(F.sum("cov"), 6).alias("hits"))
    known = _per_region(parts, runs, ["edge_id", "occ"], "lam is not null").groupBy("edge_id").agg(F.sum("x").alias("expected"), F.sum("n").alias("unmasked"))
    d = parts.groupBy("edge_id").agg(F.count(F.lit(1)).alias("paths")).join(known, "edge_id", "left").join(hits, "edge_id", "left")
    return d.select("edge_id", F.coalesce("hits", F.lit(0.0)).alias("hits"), F.round(F.coalesce("expected", F.lit(0.0)), 6).alias("expected"), F.coalesce("unmasked", F.lit(0)).cast("bigint").alias("unmasked"), "paths")


def run_ratio(regions: DataFrame, runs: DataFrame, cov: DataFrame, key: str = "id") -> DataFrame:
    """(key, ratio): depth over expected depth of regions (chr, start, end, key), over all positions of which a depth above 0 is expected."""
    good = _known_depth(runs, cov).where("lam > 0").select("chr", F.col("pos").alias("start"), F.col("pos").alias("end"), "cov")
    c = overlap_join(regions.select(key, "chr", "start", "end"), good, long=True).groupBy(key).agg(F.sum("r_cov").alias("c"))
    x = _per_region(regions, runs, [key], "lam > 0")
    d = regions.select(key).join(x, key, "left").join(c, key, "left")
    return d.select(key, F.round(F.try_divide(F.when(F.col("x").isNotNull(), F.coalesce("c", F.lit(0.0))), "x"), 6).alias("ratio"))
