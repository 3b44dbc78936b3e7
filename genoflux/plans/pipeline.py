"""The whole chain from mappings to calls, in two stages that can run by themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoflux.operators import calls as ca
from genoflux.operators import cluster as cl
from genoflux.operators import depth as de
from genoflux.operators import intervals as iv
from genoflux.operators import reads as rd


#: Options of a run with the types that they must have.
OPTIONS = {"mean": (int, float), "sd": (int, float), "read_len": (int,), "least": (int,)}
MODES = ("all", "stage1", "stage2")


def check_inputs(spark, mode: str, options: dict, references: list[str], files: dict[str, str]) -> list[str]:
    """What is missing or wrong in the inputs of a run: its mode, options, and for each reference the files of each kind (a path with {ref})."""
    from genoflux.sources.binary import _file

    wrong = [] if mode in MODES else [f"mode {mode} is none of {', '.join(MODES)}"]
    for name, types in OPTIONS.items():
        if name not in options:
            wrong.append(f"option {name} is missing")
        elif not isinstance(options[name], types) or options[name] < 0:
            wrong.append(f"option {name} is not a number from 0")
    if not references:
        wrong.append("no references")
    for kind, pattern in files.items():
        for ref in references:
            fs, path = _file(spark, pattern.format(ref=ref))
            if not fs.exists(path):
                wrong.append(f"{kind} of {ref} is missing")
    return wrong


def thresholds(mean: float, sd: float) -> dict[str, float]:
    """Concordant distances: three deviations about the mean, at least 1; tolerance beyond breaks."""
    return {"lower": max(1.0, mean - 3 * sd), "upper": mean + 3 * sd, "tolerance": mean + 3 * sd}


def stage1(maps: DataFrame, breaks: DataFrame, read_len: int, mean: float, sd: float, least: int, low: float = 0, high: float = 15, most: int = 10_000_000) -> dict[str, DataFrame]:
    """Depth, masks and links of mappings. Depth and links share one reading of maps, which the caller may cache."""
    t = thresholds(mean, sd)
    cov = rd.coverage(maps).select(F.col("ref_name").alias("chr"), F.col("ref_pos").alias("pos"), "cov")
    spikes = de.pad_spikes(de.spikes(cov, low, high))
    masks = iv.merge(breaks.select("chr", "start", "end").unionByName(spikes))
    pairs = rd.discordant_pairs(maps, read_len, int(t["lower"]), int(t["upper"]), most)
    pairs = pairs.select(F.col("ref_name").alias("chr"), "type", "left_pos", "right_pos", "dist", F.col("read_id").alias("template"))
    links = cl.filter_links(cl.cluster_summary(cl.leader_clusters(pairs, mean, sd), mean), least)
    return {"coverage": cov, "masks": masks, "links": iv.screen_links(links, breaks, int(t["tolerance"]))}


def stage2(raw: DataFrame, breaks: DataFrame, depth: DataFrame, forgiveness: float = 5.0, least: int = 1000) -> DataFrame:
    """Final calls (chr, start, end, call, doc_ratio) of raw ones (chr, start, end, flow_diff)."""
    kept = iv.overlap_anti(raw, breaks)
    smooth = ca.smooth_calls(ca.truncated(kept), forgiveness, least)
    named = smooth.withColumn("id", F.struct("chr", "start", "end"))
    ratios = de.depth_ratio(named, depth).select("id.*", "ratio")
    return ca.final_calls(smooth, ratios)
