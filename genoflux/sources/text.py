"""Text inputs and outputs: mapping lines, intervals, FASTA, AXT, graph and flow files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from genoflux.functions.sequence import kmers, pieces


def _fields(df: DataFrame) -> DataFrame:
    return df.withColumn("f", F.split(F.trim("value"), r"\s+"))


def read_mappings(spark: SparkSession, paths: str | list[str], form: str = "txt") -> DataFrame:
    """(read_id, orientation, ref_name, ref_pos) from text: 'txt' is `id strand ref pos`, from 1;
    'bowtie_concise' is `id strand :<ref,pos,mismatches>`, from 0, whose references 0..21 are chr1..chr22 and 22 is chr0."""
    lines = spark.read.text(paths)
    if form == "txt":
        d = _fields(lines).where("size(f) >= 4")
        return d.select(d.f[0].cast("bigint").alias("read_id"), d.f[1].alias("orientation"), d.f[2].alias("ref_name"), d.f[3].cast("bigint").alias("ref_pos"))
    if form == "bowtie_concise":
        part = lambda k: F.regexp_extract("value", r"^(\d+)([+-]):<(\d+),(\d+),", k)
        ref = part(3).cast("int")
        named = F.concat(F.lit("chr"), F.when(ref < 22, ref + 1).when(ref == 22, 0).otherwise(ref))
        return lines.where(part(1) != "").select(part(1).cast("bigint").alias("read_id"), part(2).alias("orientation"), named.alias("ref_name"), (part(4).cast("bigint") + 1).alias("ref_pos"))
    if form == "bam":
        from .bam import read_bam

        b = read_bam(spark, paths)
        return b.select("read_id", F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+").alias("orientation"), F.coalesce("ref_name", F.lit("-1")).alias("ref_name"), (F.col("position") + 1).alias("ref_pos"))
    raise ValueError(f"unknown format {form}")


def read_file_list(spark: SparkSession, path: str) -> list[str]:
    """Names in a file of names; as many as a job has inputs."""
    return [r.value for r in spark.read.text(path).where("trim(value) <> ''").collect()]


def read_intervals(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chr, start, end, label) from `chr start end [label]`; the label keeps the delimiter before it."""
    part = lambda k: F.regexp_extract("value", r"^\s*(\S+)\s+(-?\d+)\s+(-?\d+)(.*)$", k)
    return spark.read.text(path).where(part(1) != "").select(part(1).alias("chr"), part(2).cast("bigint").alias("start"), part(3).cast("bigint").alias("end"), part(4).alias("label"))


def read_links(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(chr, from, to, type, count, l_from, l_to, avg_md, id) of the rows of cluster files that end in EDGE; other lines are left out."""
    names = [("chr", "string"), ("from", "bigint"), ("to", "bigint"), ("type", "int"), ("count", "bigint"), ("l_from", "bigint"), ("l_to", "bigint"), ("avg_md", "double"), ("id", "bigint")]
    d = _fields(spark.read.text(paths)).where((F.size("f") == len(names) + 1) & (F.get("f", F.lit(len(names))) == "EDGE"))
    return d.select(*(d.f[i].cast(t).alias(n) for i, (n, t) in enumerate(names)))


def link_lines(links: DataFrame) -> DataFrame:
    """(value): lines of links as read_links takes them."""
    return links.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("chr", "from", "to", "type", "count", "l_from", "l_to", "avg_md", "id")), F.lit("EDGE")).alias("value"))


def line_index(spark: SparkSession, paths: str | list[str], token: int | None = None, sep: str = r"\s+") -> DataFrame:
    """(path, line, offset, key): the lines of each file from 0 with the byte that each begins at; key: its first token, or the given one.

    Lines are numbered inside their split, and splits inside their file, so that a file is as many tasks as it has splits; lines end in one line feed.
    """
    d = spark.read.text(paths).select(F.input_file_name().alias("path"), F.input_file_block_start().alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    d = d.withColumn("size", F.octet_length("value") + 1).withColumn("key", F.get(F.split(F.ltrim("value"), sep), F.lit(token or 0))).drop("value")
    sums = d.groupBy("path", "split").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("path", "split", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("lines"))
    inside = W.partitionBy("path", "split").orderBy("at")
    d = d.withColumn("offset", F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("line", F.row_number().over(inside) - 1)
    return d.join(sums, ["path", "split"]).select("path", (F.col("line") + F.col("lines")).alias("line"), (F.col("offset") + F.col("bytes")).alias("offset"), "key")


def key_index(index: DataFrame) -> DataFrame:
    """(path, key, line, offset): of each run of lines of one key the first, as a lookup by key starts there."""
    from genoflux.operators.intervals import with_previous

    d = with_previous(index.withColumn("_key", F.concat(F.lit("="), "key")), "path", "line", "_key", "previous")
    return d.where("previous is null or previous <> _key").select("path", "key", "line", "offset")


#: Bytes of a file whose lookups one read serves, if they lie so near to each other.
NEAR = 1 << 16


def lines_at(index: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value): the lines of each of keys (key) in files with an index as key_index gives it.

    Keys find the places of their lines in the index; these are sorted by file and offset and dealt out in ranges, and a task seeks its
    places, those near each other in one read. Nothing else of the files is read. Keys that aren't there have no lines; a key given twice counts once.
    """
    from genoflux.shipping import ship

    from . import store

    ship(index.sparkSession)
    stop = F.lead("offset").over(W.partitionBy("path", F.floor(F.col("offset") / (1 << 26))).orderBy("offset"))
    first = index.groupBy("path", F.floor(F.col("offset") / (1 << 26)).alias("_slice")).agg(F.min("offset").alias("_first"))
    after = first.select("path", "_slice", F.lead("_first").over(W.partitionBy("path").orderBy("_slice")).alias("_after"))
    d = index.withColumn("stop", stop).withColumn("_slice", F.floor(F.col("offset") / (1 << 26))).join(after, ["path", "_slice"]).withColumn("stop", F.coalesce("stop", "_after"))
    d = d.join(keys.select("key").distinct(), "key").select("path", "key", "offset", "stop").repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")

    def run(batches):
        import pyarrow as pa

        path, f, at, held = None, None, 0, b""
        for b in batches:
            found, names = [], []
            for p, key, a, z in zip(*(b.column(i).to_pylist() for i in range(4))):
                if p != path:
                    if f is not None:
                        f.close()
                    path, f, held = p, store.opened(p), b""
                if z is None:
                    z = f.size()
                if not at <= a or z > at + len(held):
                    f.seek(a)
                    at, held = a, f.read(max(NEAR, z - a))
                lines = held[a - at : z - at].decode().removesuffix("\n").split("\n")
                found += lines
                names += [key] * len(lines)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], ["key", "value"])
        if f is not None:
            f.close()

    return d.mapInArrow(run, "key string, value string")


def read_rows(spark: SparkSession, path: str, names: list[str], comment: str = "#", sep: str | None = None) -> DataFrame:
    """String columns from rows split at white space, or at `sep`; comment lines are left out."""
    d = spark.read.text(path).where(~F.col("value").startswith(comment))
    d = _fields(d) if sep is None else d.withColumn("f", F.split("value", sep))
    return d.select(*(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)))


def read_headed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, name, seq): each file is one sequence, its first line the header."""
    whole = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.regexp_extract("value", r"^>?\s*(\S*)", 1).alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"[\r\n]", "").alias("seq"))


def _begun(batches):
    """Lines (path, split, seq) with the letters before each in its split, as a task reads them: split by split, in order."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    now, n = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        path, split, seq = b.columns
        size = pc.utf8_length(seq).to_numpy(zero_copy_only=False).astype(np.int64)
        code, at = pc.dictionary_encode(path).indices.to_numpy(), split.to_numpy()
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (at[1:] != at[:-1])])
        before = np.cumsum(size) - size
        inside = before - np.repeat(before[first], np.diff(np.r_[first, len(size)]))
        if (path[0].as_py(), at[0]) == now:
            inside[: first[1] if len(first) > 1 else None] += n
        now, n = (path[-1].as_py(), at[-1]), int(inside[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([path, split, pa.array(inside), seq], ["path", "split", "inside", "seq"])


def read_fasta_pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, name, start, seq): the lines of each file's sequence with where they begin in it, from 1; the first line is the header. A folder of parts as
    save_parts writes them (`path/part-<number>`) is one file, `path`.

    A file is read in splits: letters are counted inside their split as its lines are read, and splits inside their file, so that no task sees a
    chromosome, and no line is sorted. What is broadcast has a row for each split.
    """
    from genoflux.shipping import ship

    ship(spark)
    lines = spark.read.text(paths).select(F.input_file_name().alias("path"), F.input_file_block_start().alias("split"), F.rtrim(F.regexp_replace("value", "\r$", "")).alias("seq"))
    head = F.col("seq").startswith(">")
    part = r"/part-(\d+)$"
    file, nth = F.regexp_replace("path", part, "").alias("file"), F.regexp_extract("path", part, 1).try_cast("decimal(38,0)").alias("nth")
    names = lines.where(head).withColumn("at", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("seq", F.struct("split", "at")).alias("seq"))
    names = names.select(file, nth, "seq").groupBy("file").agg(F.min_by("seq", F.struct("nth")).alias("seq")).select("file", F.regexp_extract("seq", r"^>\s*(\S*)", 1).alias("name"))
    d = lines.where(~head & (F.col("seq") != ""))
    sizes = d.groupBy("path", "split").agg(F.sum(F.length("seq")).alias("n")).select("path", "split", "n", file, nth)
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("nth", "split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = sizes.select("path", "split", "file", before.alias("before")).join(names, "file", "left")
    d = d.mapInArrow(_begun, "path string, split long, inside long, seq string").join(F.broadcast(places), ["path", "split"])
    return d.select(F.col("file").alias("path"), F.coalesce("name", F.lit("")).alias("name"), (F.col("before") + F.col("inside") + 1).alias("start"), "seq")


def fasta_bodies(seqs: DataFrame, width: int = 60) -> DataFrame:
    """seqs (seq, further columns) with body in place of seq: the lines of a FASTA file of the sequence, without its header."""
    return seqs.withColumn("body", F.concat(F.array_join(pieces(F.col("seq"), width), "\n"), F.lit("\n")).cast("binary")).drop("seq")


def fasta_length(spark: SparkSession, path: str) -> DataFrame:
    """Letters outside header lines; lines are counted where they lie, without joining the sequence."""
    return spark.read.text(path).where("value not like '%>%'").agg(F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("length"))


def chunk_sequence(seqs: DataFrame, size: int = 1 << 20, overlap: int = 0) -> DataFrame:
    """(name, chunk, start, seq): pieces of a sequence, from 1, each with `overlap` letters of the next."""
    d = seqs.select("name", pieces(F.col("seq"), size).alias("p"))
    more = lambda x, i: F.concat(x, F.coalesce(F.substring(F.get("p", i + 1), 1, overlap), F.lit("")))
    d = d.select("name", F.posexplode(F.transform("p", more)).alias("chunk", "seq"))
    return d.select("name", "chunk", (F.col("chunk") * size + 1).alias("start"), "seq")


def tiles(reads: DataFrame, start: int, end: int) -> DataFrame:
    """(id, i, value): FASTA records SIM_LOC<i> of those of reads (id, start from 1, kmer) that begin in start..end, from 0."""
    d = reads.withColumn("i", F.col("start") - 1).where(F.col("i").between(start, end))
    return d.select("id", "i", F.concat(F.lit(">SIM_LOC"), "i", F.lit("\n"), "kmer").alias("value"))


def tile_fasta(seqs: DataFrame, start: int, end: int, size: int) -> DataFrame:
    """(i, value): FASTA records SIM_LOC<i> of every substring of `size` letters that starts in start..end, from 0."""
    return tiles(kmers(seqs.select(F.lit(0).alias("id"), "seq"), size), start, end).drop("id")


def read_axt(spark: SparkSession, path: str | list[str], least: int = 100) -> DataFrame:
    """(num, contig1, start1, end1, contig2, start2, end2, strand, score, s1, s2) of alignment blocks of one contig with itself,
    at least `least` long on both sides; comments are left out."""
    blocks = spark.read.text(path, lineSep="\n\n").select(F.regexp_replace("value", r"(?m)^#.*\n?", "").alias("value"))
    d = blocks.withColumn("l", F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).where("size(l) >= 3").withColumn("h", F.split(F.col("l")[0], r"\s+"))
    names = ["num", "contig1", "start1", "end1", "contig2", "start2", "end2", "strand", "score"]
    ints = {"num", "start1", "end1", "start2", "end2", "score"}
    d = d.select(*(F.col("h")[i].cast("bigint" if n in ints else "string").alias(n) for i, n in enumerate(names)), F.col("l")[1].alias("s1"), F.col("l")[2].alias("s2"))
    return d.where((F.col("contig1") == F.col("contig2")) & (F.least(F.col("end1") - F.col("start1"), F.col("end2") - F.col("start2")) + 1 >= least))


#: Lines of a graph file by their tag, with columns and types.
GRAPH_LINES = {
    "NODE": [("id", "bigint"), ("contig", "string"), ("pos", "bigint"), ("strand", "string")],
    "ARC": [("i", "bigint"), ("from", "bigint"), ("fake", "bigint"), ("to", "bigint"), ("len", "bigint"), ("lam", "double")],
    "PATH": [("contig", "string"), ("pos", "bigint"), ("strand", "string"), ("node", "bigint"), ("edge", "bigint")],
    "DG": [("edge", "bigint"), ("contig", "string"), ("start", "bigint"), ("end", "bigint"), ("o", "int")],
    "GRAPHINFO": [("length", "bigint"), ("reads", "double"), ("funny", "bigint"), ("breaks", "bigint"), ("zero", "bigint")],
}


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A table for each tag of a graph file."""
    d = _fields(spark.read.text(path))
    return {tag: d.where(d.f[0] == tag).select(*(F.get("f", F.lit(i + 1)).cast(t).alias(n) for i, (n, t) in enumerate(cols))) for tag, cols in GRAPH_LINES.items()}


def graph_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """(value): lines of a graph file."""
    out = None
    for tag, d in tables.items():
        line = d.select(F.concat_ws(" ", F.lit(tag), *(F.col(n).cast("string") for n, _ in GRAPH_LINES[tag])).alias("value"))
        out = line if out is None else out.unionByName(line)
    return out


def problem_lines(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(value): NODE lines of nodes (id) and ARC lines of arcs (from, to, hits, len, lam), as the flow stage takes them."""
    arc = arcs.select(F.concat_ws(" ", F.lit("ARC"), *(F.col(c).cast("string") for c in ("from", "to", "hits", "len", "lam"))).alias("value"))
    return nodes.select(F.concat_ws(" ", F.lit("NODE"), F.col("id").cast("string"), F.lit("0")).alias("value")).unionByName(arc)


def read_dimacs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(arcs, supply) of a minimum-cost flow problem: `a tail head low cap cost` and `n node excess` lines."""
    from genoflux.operators.graph import dense_ids

    d = _fields(spark.read.text(path)).withColumn("at", F.monotonically_increasing_id())
    num = lambda i: d.f[i].cast("bigint")
    arcs = d.where(d.f[0] == "a").select("at", num(1).alias("tail"), num(2).alias("head"), num(3).alias("low"), num(4).alias("cap"), num(5).alias("cost"))
    # numbered in the order of lines: inside each task's lines, and the tasks by their counts
    arcs = dense_ids(arcs.withColumn("task", F.shiftright("at", 33)), ["task", "at"], "arc_id").withColumn("arc_id", (F.col("arc_id") + 1).cast("bigint")).drop("at", "task")
    return arcs, d.where(d.f[0] == "n").select(num(1).alias("node"), num(2).alias("excess"))


def dimacs_lines(arcs: DataFrame, supply: DataFrame | None = None) -> DataFrame:
    """(value): arc lines of a problem and node lines of its supply, without the header that needs their counts."""
    a = arcs.select(F.concat_ws(" ", F.lit("a"), *("tail", "head", "low", "cap", "cost")).alias("value"))
    return a if supply is None else supply.select(F.concat_ws(" ", F.lit("n"), "node", "excess").alias("value")).unionByName(a)


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """(tail, head, flow) of the `f` lines of a solver's output."""
    d = _fields(spark.read.text(path)).where("f[0] = 'f'")
    return d.select(d.f[1].cast("bigint").alias("tail"), d.f[2].cast("bigint").alias("head"), d.f[3].cast("bigint").alias("flow"))


def write_calls(calls: DataFrame, path: str) -> None:
    """Final calls as tab-separated text, a folder for each chromosome."""
    calls.withColumn("_chr", F.col("chr")).write.partitionBy("_chr").csv(path, sep="\t")


def graph_dump(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(value): lines of a graph for viewers. 'sif': `from edge to` of each of edges (edge_id, from_node, to_node, length, ...); 'attributes':
    `from (edge) to = length`; 'table': tab-separated edges with their columns as they are, and 'nodes': of nodes."""
    name = lambda c: F.col(c).cast("string")
    if kind == "sif":
        return edges.select(F.concat_ws(" ", name("from_node"), name("edge_id"), name("to_node")).alias("value"))
    if kind == "attributes":
        return edges.select(F.concat(name("from_node"), F.lit(" ("), name("edge_id"), F.lit(") "), name("to_node"), F.lit(" = "), name("length")).alias("value"))
    if kind in ("table", "nodes"):
        d = edges if kind == "table" else nodes
        return d.select(F.concat_ws("\t", *(F.coalesce(name(c), F.lit("")) for c in d.columns)).alias("value"))
    raise ValueError(f"unknown dump {kind}")


def log_time(ts: Column) -> Column:
    """A time as the log has it: 9:5:3, Mon Jan 7, 2008."""
    return F.date_format(ts, "H:m:s, E MMM d, yyyy")


def log_lines(commands: DataFrame) -> DataFrame:
    """(value): lines of the execution log of commands (ts, command)."""
    return commands.select(F.concat(log_time(F.col("ts")), F.lit("\t\t"), "command").alias("value"))


def append_log(commands: DataFrame, path: str) -> None:
    """Add commands (ts, command) to the log in a folder."""
    log_lines(commands).write.mode("append").text(path)


def write_sorted(df: DataFrame, path: str, by: tuple[str, ...], order: tuple[str, ...]) -> None:
    """Parquet, a folder for each value of `by`, its rows in order from file to file: ranges of the order, so that a large group is many tasks."""
    df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).write.partitionBy(*by).parquet(path)


def in_file_order(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """df, read from files of write_sorted, with nth: a row's place in its group as the files have it."""
    d = df.withColumn("_file", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())
    name = F.regexp_extract("_file", r"part-(\d+)", 1).cast("int")
    d = d.withColumn("_file", name)
    n = d.groupBy(*by, "_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("_in", F.row_number().over(W.partitionBy(*by, "_file").orderBy("_at"))).join(n.select(*by, "_file", before.alias("_before")), [*by, "_file"])
    return d.withColumn("nth", F.col("_in") + F.col("_before")).drop("_file", "_at", "_in", "_before")


def write_by_reference(df: DataFrame, path: str, refs: DataFrame | None = None, by: tuple[str, ...] = ("ref_name",)) -> None:
    """Parquet, a folder for each reference (and type); rows on references outside refs (ref_name) are left out. Tasks take ranges of the references and,
    inside one, of its rows, so that a reference with most rows is many files."""
    d = df if refs is None else df.join(refs, "ref_name", "left_semi")
    d = d.withColumn("_n", F.monotonically_increasing_id())
    d.repartitionByRange(*by, "_n").sortWithinPartitions(*by).drop("_n").write.partitionBy(*by).parquet(path)
