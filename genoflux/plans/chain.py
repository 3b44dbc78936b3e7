"""The whole run from mappings, breaks, sequences and links to named calls, stage by stage over tables that a later run goes on from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoflux.operators import calls as ca
from genoflux.operators import depth as de
from genoflux.operators import flow as fl
from genoflux.operators import graph as gr
from genoflux.operators import intervals as iv
from genoflux.operators import reads as rd
from genoflux.scratch import materialise


@dataclass(frozen=True)
class Options:
    """low, high: depths of spikes; window, bins: of GC; ploidy, lines, allow_none: of the costs; cutoff: of a run's called length;
    forgiveness, least: of smoothing, in percent and positions."""

    low: float = 0
    high: float = 15
    window: int = 500
    bins: int = 50
    ploidy: int = 2
    lines: int = 10
    allow_none: int = 20
    cutoff: int = 100
    forgiveness: float = 5.0
    least: int = 1000


class Stages:
    """Tables of a run's stages in one folder. A table whose writing has ended is read, others are made anew; without a folder all are scratch tables."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder and folder.rstrip("/")
        self.made: list[str] = []
        self.tables: dict[str, DataFrame] = {}

    def _there(self, path: str) -> bool:
        from genoflux.sources.binary import _file

        fs, mark = _file(self.spark, f"{path}/_SUCCESS")
        return fs.exists(mark)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.tables:
            if self.folder is None:
                self.made.append(name)
                self.tables[name] = materialise(make(), name)
            else:
                path = f"{self.folder}/{name}"
                if not self._there(path):
                    self.made.append(name)
                    make().write.mode("overwrite").parquet(path)
                self.tables[name] = self.spark.read.parquet(path)
        return self.tables[name]


def expected_runs(stages: Stages, cov: DataFrame, masks: DataFrame, seqs: DataFrame, o: Options) -> DataFrame:
    """(chr, start, end, lam): expected depth of stretches of the sequences, null where masked: depth per position of the windows
    of one GC share, over windows that no mask touches."""
    windows = stages.table("windows", lambda: de.gc_windows(seqs, o.window, o.bins))

    def bins() -> DataFrame:
        clean = de.unmasked(windows, masks, o.window)
        own = cov.withColumn("win", F.floor((F.col("pos") - 1) / o.window).cast("int")).groupBy(F.col("chr").alias("id"), "win").agg(F.sum("cov").alias("hits"))
        return de.bin_lambda(clean.join(own, ["id", "win"], "left").withColumn("hits", F.coalesce("hits", F.lit(0.0))))

    lam = stages.table("gc_depth", bins)
    known = windows.select(F.col("id").alias("chr")).distinct()
    return stages.table("expected", lambda: de.position_lambda(windows, masks.join(known, "chr", "left_semi"), de.fill_lambda(lam, o.bins), o.window))


def graph_parts(stages: Stages, pairs: DataFrame, links: DataFrame, lengths: DataFrame) -> DataFrame:
    """(contig, pos, end, strand, edge_id): a path of edges along each contig of lengths (chr, length): repeats (edge_id, contig, start, end, strand),
    cut until none overlap in part, what lies between them, and all of it cut where links begin and end. Ids are dense."""

    def reference() -> DataFrame:
        same = gr.refine_repeats(pairs).select("contig", F.concat_ws(":", F.lit("r"), "contig", "edge_id").alias("name"), "start", "end", "strand")
        filled = gr.fill_gaps(same.select(F.col("contig").alias("chr"), "start", "end"), lengths)
        rest = filled.where("kind = 'gap'").unionByName(lengths.join(filled.select("chr").distinct(), "chr", "left_anti").select("chr", F.lit(1).cast("bigint").alias("start"), F.col("length").alias("end"), F.lit("gap").alias("kind")))
        rest = rest.select(F.col("chr").alias("contig"), F.concat_ws(":", F.lit("g"), "chr", "start").alias("name"), "start", "end", F.lit("+").alias("strand"))
        return same.unionByName(rest)

    ref = stages.table("reference_graph", reference)

    def cut() -> DataFrame:
        on = gr.in_range(links, lengths)
        points = on.select("chr", F.explode(F.array("from", "to")).alias("pos"))
        d = gr.split_edges(ref.select(F.col("name").alias("edge_id"), F.col("contig").alias("chr"), "start", "end", "strand"), points)
        d = materialise(d, "cut-edges")
        names = d.select("edge_id", "piece").distinct().withColumn("_part", F.pmod(F.xxhash64("edge_id"), F.lit(4096)))
        ids = gr.dense_ids(names, ["_part", "edge_id", "piece"], "id")
        return d.join(ids.select("edge_id", "piece", "id"), ["edge_id", "piece"]).select(F.col("chr").alias("contig"), F.col("start").alias("pos"), "end", "strand", F.col("id").alias("edge_id"))

    return stages.table("graph", cut)


def donor_graph(stages: Stages, path: DataFrame, links: DataFrame, lengths: DataFrame, sums: DataFrame, o: Options) -> tuple[DataFrame, int]:
    """(net, arc_id, from, to, hits, len, lam) of the donor graph, and its number of nodes; a contig is a net. Each edge has nodes 2e + 1 and 2e + 2. Edges are those of
    the path with what `sums` says of them, free ones between neighbours on the path, and free ones of links; one more arc closes the path.

    arc_id is twice the number of the edge, and one more for its second part; edges of the path keep their numbers."""
    edges = path.agg(F.coalesce(F.max("edge_id") + 1, F.lit(0))).first()[0]

    def every() -> DataFrame:
        none = [F.lit(0.0).alias("hits"), F.lit(0.0).alias("expected"), F.lit(0).cast("bigint").alias("unmasked"), F.lit(1).cast("bigint").alias("paths"), F.lit(True).alias("free"), F.lit(False).alias("cb")]
        at = path.groupBy("edge_id").agg(F.min("contig").alias("net"))
        own = sums.join(at, "edge_id").select(
            "net", "edge_id", (2 * F.col("edge_id")).alias("from_node"), F.lit(0).alias("from_bit"), (2 * F.col("edge_id") + 1).alias("to_node"), F.lit(1).alias("to_bit"), "hits", "expected", "unmasked", "paths", F.lit(False).alias("free"), F.lit(False).alias("cb")
        )
        strand = path.select("contig", "pos", F.struct("edge_id", "strand").alias("edge_id"))
        step = gr.free_links(strand)
        back, next_back = F.col("edge_id.strand") == "-", F.col("next_edge.strand") == "-"
        step = step.select(
            F.col("contig").alias("net"), (2 * F.col("edge_id.edge_id") + F.when(back, 0).otherwise(1)).alias("from_node"), F.when(back, 1).otherwise(0).alias("from_bit"),
            (2 * F.col("next_edge.edge_id") + F.when(next_back, 1).otherwise(0)).alias("to_node"), F.when(next_back, 0).otherwise(1).alias("to_bit"), F.lit(0).alias("kind"), "pos",
        )
        occ = path.select(F.col("contig").alias("chr"), F.col("pos").alias("start"), "end", "edge_id", "strand")
        donor = gr.donor_arcs(occ, links, lengths).join(at.select("net", (2 * F.col("edge_id")).alias("_a")), F.expr("from_node - from_node % 2") == F.col("_a"))
        donor = donor.select("net", "from_node", "from_bit", "to_node", "to_bit", F.lit(1).alias("kind"), F.col("from_node").alias("pos"))
        more = gr.dense_ids(step.unionByName(donor), ["net", "kind", "pos", "to_node"], "edge_id").withColumn("edge_id", F.col("edge_id") + edges)
        return own.unionByName(more.select("net", "edge_id", "from_node", "from_bit", "to_node", "to_bit", *none))

    d = stages.table("donor_edges", every)
    nodes = 2 * edges + d.agg(F.coalesce(F.max("edge_id") + 1, F.lit(0))).first()[0]
    arcs = gr.arc_list(d.drop("net"), 2 * edges).join(d.select("edge_id", "net"), "edge_id")
    arcs = arcs.select("net", (2 * F.col("edge_id") + F.col("part") - 1).alias("arc_id"), "from", "to", "hits", "len", "lam")
    ends = path.groupBy("contig").agg(F.max_by("edge_id", "pos").alias("z"), F.min_by("edge_id", "pos").alias("a"))
    ends = gr.dense_ids(ends, ["contig", "a"], "id").select(
        F.col("contig").alias("net"), (F.col("id") + 2 * nodes).alias("arc_id"), (2 * F.col("z") + 2).alias("from"), (2 * F.col("a") + 1).alias("to"), F.lit(0.0).alias("hits"), F.lit(-1).cast("bigint").alias("len"), F.lit(0.0).alias("lam")
    )
    return arcs.unionByName(ends), nodes


def raw_calls(stages: Stages, path: DataFrame, sums: DataFrame, copies: DataFrame, o: Options) -> DataFrame:
    """(chr, start, end, flow_diff): runs along each contig in which the copies differ one way from those of the reference."""
    flow = copies.where("arc_id % 2 = 0").select(F.expr("arc_id div 2").alias("edge_id"), "flow")
    ref = gr.multiplicity(path, o.ploidy)
    called = F.when(F.col("expected") == 0, F.lit(0)).otherwise(F.expr("unmasked div paths")).cast("bigint")
    d = path.join(flow, "edge_id").join(ref, "edge_id").join(sums.select("edge_id", called.alias("decide")), "edge_id")
    diff = ca.toward(F.col("flow"), F.col("copies")) - F.col("copies")
    d = d.select("contig", "pos", "edge_id", (F.col("end") - F.col("pos") + 1).alias("length"), "decide", diff.cast("double").alias("diff"))
    return ca.call_runs(d, o.cutoff).select(F.col("contig").alias("chr"), "start", "end", "flow_diff")


def run_chain(
    spark: SparkSession, maps: DataFrame, breaks: DataFrame, seqs: DataFrame, links: DataFrame, pairs: DataFrame, high_copy: DataFrame | None = None, options: Options | None = None, folder: str | None = None
) -> tuple[DataFrame, Stages]:
    """Final calls (chr, start, end, call, doc_ratio) of a whole run, and its stages.

    maps: (read_id, ref_name, ref_pos, orientation); breaks, high_copy: (chr, start, end); seqs: (id, seq) or pieces; links: (chr, from, to, type), as
    stage1 gives them; pairs: (edge_id, contig, start, end, strand) of repeats, as repeat_pairs gives them. folder: where tables of stages are kept;
    a run that stopped goes on after the last table there. Contigs without a sequence take no part.
    """
    o = options or Options()
    s = Stages(spark, folder)
    pieces = de.sequence_pieces(seqs)
    seqs = s.table("sequences", lambda: pieces)  # read four times, where making the letters may cost more than to read them
    lengths = s.table("lengths", lambda: seqs.groupBy(F.col("id").alias("chr")).agg(F.max(F.col("start") + F.length("seq") - 1).cast("bigint").alias("length")))
    cov = s.table("coverage", lambda: rd.coverage(maps.join(lengths.select(F.col("chr").alias("ref_name")), "ref_name", "left_semi")).select(F.col("ref_name").alias("chr"), F.col("ref_pos").alias("pos"), "cov"))

    def masked() -> DataFrame:
        known = breaks.select("chr", "start", "end").unionByName(de.pad_spikes(de.spikes(cov, o.low, o.high))).unionByName(de.letter_runs(seqs).select(F.col("id").alias("chr"), "start", "end"))
        return iv.merge(known if high_copy is None else known.unionByName(high_copy.select("chr", "start", "end")), 1)

    masks = s.table("masks", masked)
    runs = expected_runs(s, cov, masks, seqs, o)
    path = graph_parts(s, pairs, links, lengths)
    parts = path.select("edge_id", F.monotonically_increasing_id().alias("occ"), F.col("contig").alias("chr"), F.col("pos").alias("start"), "end")
    sums = s.table("edge_sums", lambda: de.edge_sums(parts, runs, cov))
    arcs, nodes = donor_graph(s, path, links, lengths, sums, o)
    arcs = s.table("arcs", lambda: arcs)
    network = s.table("network", lambda: fl.network_arcs(arcs, nodes, baseflow=o.ploidy, lines=o.lines, allow_none=o.allow_none))
    solved = s.table("solution", lambda: fl.solve(network))
    copies = s.table("copies", lambda: fl.solved_copies(solved))
    raw = s.table("raw_calls", lambda: raw_calls(s, path, sums, copies, o))

    def named() -> DataFrame:
        smooth = ca.smooth_calls(ca.truncated(iv.overlap_anti(raw, breaks)), o.forgiveness, o.least)
        ratio = de.run_ratio(smooth.withColumn("id", F.struct("chr", "start", "end")), runs, cov).select("id.*", "ratio")
        return ca.final_calls(smooth, ratio)

    return s.table("calls", named), s
