"""Read mappings: weights, depth, mate pairs, insert sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: Reference of a mapping that has none.
UNMAPPED = "-1"


def block_weights(maps: DataFrame, order: str | None = None) -> DataFrame:
    """maps with weight = 1 / number of the read's mappings, over all references, before any reference is left out.

    A read whose first mapping, by `order`, is on no reference is left out as a whole; without an order, one all of whose mappings are.
    """
    w = W.partitionBy("read_id")
    first = F.max("ref_name").over(w) if order is None else F.first("ref_name").over(w.orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    d = maps.withColumn("weight", 1.0 / F.count(F.lit(1)).over(w)).withColumn("_first", first)
    return d.where(F.col("_first") != UNMAPPED).drop("_first")


def coverage(maps: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """(ref_name, ref_pos, cov): sum of weights of the mappings at each position. A position beyond its reference of lengths (ref_name,
    length) is an error."""
    d = block_weights(maps).groupBy("ref_name", "ref_pos").agg(F.round(F.sum("weight"), 6).alias("cov"))
    if lengths is None:
        return d
    wrong = F.raise_error(F.concat(F.lit("position "), "ref_pos", F.lit(" is beyond "), "ref_name"))
    d = d.join(lengths.select("ref_name", "length"), "ref_name", "left")
    return d.withColumn("ref_pos", F.when(F.col("ref_pos") > F.col("length"), wrong.cast("bigint")).otherwise(F.col("ref_pos"))).drop("length")


def on_references(maps: DataFrame, refs: DataFrame) -> DataFrame:
    """Mappings on the references listed in refs (ref_name)."""
    return maps.join(refs, "ref_name", "left_semi")


def template(read_id: Column) -> Column:
    return read_id - read_id % 2


def pair_type(left: Column, right: Column) -> Column:
    """0: +-, 1: -+, 2: ++, 3: --, of the strands of the left and right mate."""
    return F.when((left == "+") & (right == "-"), 0).when((left == "-") & (right == "+"), 1).when(left == "+", 2).otherwise(3)


def pair_distance(left_pos: Column, right_pos: Column, kind: Column, read_len: int) -> Column:
    """From the start of the left to the end of the pair: the gap and one, two or three read lengths by type."""
    return right_pos - left_pos + read_len * F.when(kind == 0, 1).when(kind == 1, 3).otherwise(2)


def mate_pairs(maps: DataFrame, read_len: int, most: int | None = None) -> DataFrame:
    """All pairs of a first and a second mate of one template on one reference, with type and distance; only those whose positions are at most
    `most` apart, if given, which then also bounds what is joined.

    Equal positions: the second mate is the left one.
    """
    m = maps.withColumn("template", template(F.col("read_id")))
    f = m.where("read_id % 2 = 0").select("template", "ref_name", F.col("ref_pos").alias("fp"), F.col("orientation").alias("fo"))
    b = m.where("read_id % 2 = 1").select("template", "ref_name", F.col("ref_pos").alias("bp"), F.col("orientation").alias("bo"))
    if most is None:
        p = f.join(b, ["template", "ref_name"])
    else:
        # a template may map to very many places: mates meet in stretches of the reference
        here = F.floor(F.col("bp") / most)
        f = f.withColumn("_bin", F.floor(F.col("fp") / most))
        b = b.withColumn("_bin", F.explode(F.array(here - 1, here, here + 1)))
        p = f.join(b, ["template", "ref_name", "_bin"]).where(F.abs(F.col("fp") - F.col("bp")) <= most).drop("_bin")
    left = F.col("fp") < F.col("bp")
    p = p.select(
        "template", "ref_name", F.least("fp", "bp").alias("left_pos"), F.greatest("fp", "bp").alias("right_pos"),
        F.when(left, F.col("fo")).otherwise(F.col("bo")).alias("l_orientation"), F.when(left, F.col("bo")).otherwise(F.col("fo")).alias("r_orientation"),
    )
    p = p.withColumn("type", pair_type(F.col("l_orientation"), F.col("r_orientation")))
    return p.withColumn("dist", pair_distance(F.col("left_pos"), F.col("right_pos"), F.col("type"), read_len))


def is_concordant(lower: int, upper: int) -> Column:
    return (F.col("type") == 0) & (F.col("left_pos") < F.col("right_pos")) & F.col("dist").between(lower, upper)


def discordant_pairs(maps: DataFrame, read_len: int, lower: int, upper: int, most: int) -> DataFrame:
    """Pairs at most `most` apart of templates that have no concordant pair."""
    p = mate_pairs(maps, read_len, max(1, upper, most))
    ok = F.max(is_concordant(lower, upper).cast("int")).over(W.partitionBy("template"))
    p = p.withColumn("_ok", ok).where("_ok = 0").drop("_ok")
    return p.where(F.col("dist") <= most).withColumnRenamed("template", "read_id")


def insert_sizes(maps: DataFrame, read_len: int, low: int, high: int) -> DataFrame:
    """(mean, sd, n) of distances strictly between low and high, over templates both of whose mates map once."""
    one = maps.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.first("ref_name").alias("ref_name"), F.first("ref_pos").alias("ref_pos"), F.first("orientation").alias("orientation"))
    p = mate_pairs(one.where("n = 1").drop("n"), read_len).where((F.col("dist") > low) & (F.col("dist") < high))
    return p.agg(F.round(F.avg("dist"), 6).alias("mean"), F.round(F.stddev_samp("dist"), 6).alias("sd"), F.count(F.lit(1)).alias("n"))


def dense_rank(values: DataFrame, column: str, out: str, slices: int = 10_000) -> DataFrame:
    """Distinct long values of a column with their rank from 1, without ordering them all in one task.

    Values are dealt to slices of their range, counted, and ranked inside a slice; only the slices are ordered as a whole.
    """
    v = values.select(column).distinct()
    low, high = v.agg(F.min(column), F.max(column)).first()
    if low is None:
        return v.withColumn(out, F.lit(1).cast("bigint"))
    v = v.withColumn("_slice", F.floor((F.col(column) - low) / max(1, -(-(high - low + 1) // slices))))
    n = v.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    nth = F.row_number().over(W.partitionBy("_slice").orderBy(column))
    return v.withColumn("_nth", nth).join(before, "_slice").select(column, (F.col("_nth") + F.col("_before")).alias(out))


def interleave(a: DataFrame, b: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Blocks of equal `name` (a number that ascends in each source) of two sources in turn: (block, source, seq, name with _1 or _2, rest)."""
    def side(d: DataFrame, k: int) -> DataFrame:
        seq = F.row_number().over(W.partitionBy(name).orderBy(*order)).cast("bigint")
        return d.withColumn("seq", seq).join(dense_rank(d, name, "block"), name).withColumn("source", F.lit(k)).withColumn(name, F.concat(F.col(name).cast("string"), F.lit(f"_{k}")))

    return side(a, 1).unionByName(side(b, 2))
