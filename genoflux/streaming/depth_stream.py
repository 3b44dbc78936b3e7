"""Depth of mappings as they arrive: the batch operators' sums as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def position_counts(maps: DataFrame, slice_width: int = 1 << 20) -> DataFrame:
    """Running number of mappings of each position of a stream of mappings (update mode); state is one row for each position."""
    return maps.groupBy("ref_name", F.floor(F.col("ref_pos") / slice_width).alias("slice"), "ref_pos").agg(F.count(F.lit(1)).alias("n"))


def event_windows(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Number and sum of values of each type of event in tumbling windows; rows later than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")
