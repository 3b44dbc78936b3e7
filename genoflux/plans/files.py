"""Queries that write the files of each format from the driver's tables and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoflux.functions import alignment as al
from genoflux.functions import sequence as sq
from genoflux.operators import depth as de
from genoflux.operators import graph as gr
from genoflux.operators import reads as rd
from genoflux.operators import similar as si
from genoflux.scratch import new_path
from genoflux.sources import bam, bam_index, binary, store, text

from . import views as v
from .catalogue import query


def _text(df: DataFrame, tag: str) -> str:
    path = new_path(df.sparkSession, tag)
    df.write.text(path)
    return path


# ---- mappings --------------------------------------------------------------------------------------------------------


@query(f"with {v.MAPPINGS} select read_id, orientation, ref_name, ref_pos from mappings")
def scan_mapping_text(s, sf):
    """Two folders of mapping lines, named by a list."""
    m = v.mappings(s, sf)
    line = F.concat(F.col("read_id"), F.lit("\t"), "orientation", F.lit("  "), "ref_name", F.lit(" "), "ref_pos").alias("value")
    paths = [_text(m.where(f"read_id % 2 = {k}").select(line), f"maps{k}") for k in (0, 1)]
    listed = _text(s.createDataFrame([(p,) for p in [*paths, ""]], "value string").coalesce(1), "list")
    return text.read_mappings(s, text.read_file_list(s, listed))


@query("""select l_orderkey as read_id, case when l_linestatus = 'O' then '+' else '-' end as orientation,
  case when l_suppkey % 25 < 22 then 'chr' || (l_suppkey % 25 + 1) when l_suppkey % 25 = 22 then 'chr0' else 'chr' || (l_suppkey % 25) end as ref_name, l_partkey + 1 as ref_pos from lineitem""")
def scan_mapping_concise(s, sf):
    d = v.table(s, sf, "lineitem")
    line = F.concat(F.col("l_orderkey"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-"), F.lit(":<"), F.col("l_suppkey") % 25, F.lit(","), "l_partkey", F.lit(","), "l_linenumber", F.lit(">"))
    return text.read_mappings(s, _text(d.select(line.alias("value")), "concise"), "bowtie_concise")


REFS = [(f"chr{i}", 100_000_000) for i in range(5)]


def _records(s, sf) -> DataFrame:
    p, q = F.col("l_partkey"), F.col("l_quantity").cast("int")
    op = lambda t, n: F.struct(F.lit(t).alias("type"), n.cast("int").alias("length"))
    cigar = F.array(op("M", q + 3), op("I", p % 4 + 1), op("D", p % 3 + 1), op("S", F.lit(2)))
    d = v.table(s, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("r"), "l_orderkey").alias("name"), (F.col("l_suppkey") % 5).cast("int").alias("ref_id"), (p * 997).alias("position"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(16).alias("flag"), (F.col("l_linenumber") * 7).cast("int").alias("mapq"), cigar.alias("cigar"),
        F.substring(F.repeat(F.lit("ACGTN"), 20), F.lit(1), (q + 3 + p % 4 + 1 + 2).cast("int")).alias("bases"), F.lit(-1).alias("mate_ref_id"), F.lit(-1).cast("bigint").alias("mate_position"),
        F.col("l_linenumber").cast("bigint").alias("insert_size"), F.create_map(F.lit("RG"), F.concat(F.lit("g"), F.col("l_suppkey") % 3), F.lit("NM"), (p % 3).cast("string")).alias("tags"),
    )
    d = d.withColumn("quals", F.repeat(F.lit("I"), F.length("bases")))
    return d.withColumn("bin", al.region_bin(F.col("position"), al.reference_end(F.col("position"), F.col("cigar"))).cast("int"))


_REC = """rec as (select l_orderkey, l_linenumber, 'r' || l_orderkey as name, l_suppkey % 5 as ref_id, l_partkey * 997 as position, case when l_linestatus = 'O' then 0 else 16 end as flag,
  l_linenumber * 7 as mapq, cast(l_quantity as int) + 3 as m, l_partkey % 4 + 1 as i, l_partkey % 3 + 1 as d, 'g' || (l_suppkey % 3) as rg, (l_partkey % 3)::varchar as nm, l_partkey as p, l_linenumber as isize from lineitem),
  recs as (select *, m || 'M' || i || 'I' || d || 'D2S' as cigar, substring(repeat('ACGTN', 20), 1, (m + i + 2)::int) as bases, position + m + d as last from rec),
  reg as (select *, last - 1 as z from recs),
  binned as (select *, case when position >> 14 = z >> 14 then 4681 + (position >> 14) when position >> 17 = z >> 17 then 585 + (position >> 17) when position >> 20 = z >> 20 then 73 + (position >> 20) when position >> 23 = z >> 23 then 9 + (position >> 23) when position >> 26 = z >> 26 then 1 + (position >> 26) else 0 end as bin from reg)"""


def _bam_files(s, sf) -> str:
    folder = new_path(s, "bam")
    d = _records(s, sf).repartitionByRange("l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber")
    store.write_bodies(bam.bam_blocks(d, REFS), folder)
    return folder


@query(f"""with {_REC} select dense_rank() over (order by l_orderkey) - 1 as read_id, name, 'chr' || ref_id as ref_name, position, flag::int as flag, mapq::int as mapq, bin::int as bin, cigar, bases, repeat('I', length(bases)::int) as quals,
  isize as insert_size, rg, nm from binned""")
def scan_alignments(s, sf):
    """Alignment files, written in the order of names and read back, with read numbers by runs of names and two tags."""
    d = bam.read_bam(s, _bam_files(s, sf))
    cigar = F.array_join(F.transform("cigar", lambda x: F.concat(x["length"], x["type"])), "")
    return d.select("read_id", "name", "ref_name", "position", "flag", "mapq", "bin", cigar.alias("cigar"), "bases", "quals", "insert_size", F.col("tags")["RG"].alias("rg"), F.col("tags")["NM"].alias("nm"))


@query(f"with {_REC} select dense_rank() over (order by l_orderkey) - 1 as read_id, case when flag = 16 then '-' else '+' end as orientation, 'chr' || ref_id as ref_name, position + 1 as ref_pos from rec")
def scan_mapping_alignments(s, sf):
    return text.read_mappings(s, _bam_files(s, sf), "bam")


@query(f"with {_REC} select name, position, last from recs where ref_id = 2 and last > 50000 and position < 150000")
def scan_alignment_region(s, sf):
    d = bam.in_region(bam.read_records(s, _bam_files(s, sf)), "chr2", 50_000, 150_000)
    return d.select("name", "position", al.reference_end(F.col("position"), F.col("cigar")).alias("last"))


def _sorted(s, sf) -> DataFrame:
    d = _records(s, sf).withColumn("path", F.lit("all"))
    return gr.dense_ids(d, ["ref_id", "position", "l_orderkey", "l_linenumber"], "ordinal")


_IDX = f"""{_REC}, o as (select *, row_number() over (order by ref_id, position, l_orderkey, l_linenumber) - 1 as ordinal from binned),
  r as (select *, ordinal - row_number() over (partition by ref_id, bin order by ordinal) as run from o),
  idx as (select ref_id, bin, min(ordinal) as "start", max(ordinal) + 1 as stop from r group by ref_id, bin, run)"""


@query(f"with {_IDX} select ref_id::int as ref_id, bin::int as bin, \"start\", stop from idx")
def alignment_index(s, sf):
    return bam.build_index(_sorted(s, sf)).select("ref_id", "bin", F.explode("chunks").alias("c")).select("ref_id", "bin", "c.start", "c.stop")


@query(f"""with {_IDX}, b as (select 0 as bin union all select 1 + unnest(range(50000 >> 26, (149999 >> 26) + 1)) union all select 9 + unnest(range(50000 >> 23, (149999 >> 23) + 1))
  union all select 73 + unnest(range(50000 >> 20, (149999 >> 20) + 1)) union all select 585 + unnest(range(50000 >> 17, (149999 >> 17) + 1)) union all select 4681 + unnest(range(50000 >> 14, (149999 >> 14) + 1)))
select min("start") as "start", max(stop) as stop from idx where ref_id = 2 and bin in (select bin from b)""")
def alignment_index_jump(s, sf):
    """Where reading starts and stops for a region."""
    index = bam.build_index(_sorted(s, sf))
    half = index.where("bin % 2 = 0"), index.where("bin % 2 = 1")
    return bam.jump(bam.merge_index(*half), 2, 50_000, 150_000).select("start", "stop")


def _indexed(s, sf) -> str:
    """Files sorted by coordinate, each with its index."""
    folder = new_path(s, "indexed")
    d = _records(s, sf).repartitionByRange("ref_id", "position", "l_orderkey").sortWithinPartitions("ref_id", "position", "l_orderkey", "l_linenumber")
    store.write_bodies(bam.bam_blocks(d, REFS), folder)
    bam_index.write_index(s, folder)
    return folder


@query(f"with {_REC} select name, position, last from recs where ref_id = 1 and last > 60000 and position < 170000")
def alignment_region_by_index(s, sf):
    """A region of indexed files, by seeks."""
    d = bam_index.read_indexed(s, _indexed(s, sf), "chr1", 60_000, 170_000)
    return d.select("name", "position", al.reference_end(F.col("position"), F.col("cigar")).alias("last"))


@query(f"with {_REC} select ref_id, name, position, bases from recs where ref_id = 3 and position >= 100000 and position < 400000")
def alignments_by_pushed_filters(s, sf):
    """Records of indexed files by filters, which decide what is read."""
    d = bam_index.read_indexed(s, _indexed(s, sf)).where("ref_name = 'chr3' and position >= 100000 and position < 400000")
    return d.select(F.col("ref_id").cast("bigint").alias("ref_id"), "name", "position", "bases")


@query(f"with {_REC} select name, position, last from recs where ref_id = 1 and last > 60000 and position < 170000")
def alignment_region_by_ordinals(s, sf):
    d = _sorted(s, sf)
    return bam.read_region(d, bam.build_index(d), 1, 60_000, 170_000).select("name", "position", al.reference_end(F.col("position"), F.col("cigar")).alias("last"))


# ---- intervals, rows, sequences --------------------------------------------------------------------------------------


@query(f"""with {v.INTERVALS} select chr, "start", "end", ' ' || label || '  x' as label from iv""")
def scan_interval_text(s, sf):
    line = F.concat_ws(" ", "chr", "start", "end", "label").alias("value")
    return text.read_intervals(s, _text(v.intervals(s, sf).select(F.concat(line, F.lit("  x")).alias("value")), "intervals"))


@query("select s_suppkey::varchar as id, s_name as name, s_nationkey::varchar as nation from supplier where s_suppkey % 10 <> 3")
def scan_commented_rows(s, sf):
    k = F.col("s_suppkey")
    line = F.concat(F.when(k % 10 == 3, "#").otherwise(""), k, F.lit(" \t "), "s_name", F.lit("  "), "s_nationkey")
    return text.read_rows(s, _text(v.table(s, sf, "supplier").select(line.alias("value")), "rows"), ["id", "name", "nation"])


@query("select c_custkey::varchar as id, c_name as name, c_mktsegment as segment from customer")
def scan_headed_rows(s, sf):
    path = new_path(s, "headed")
    v.table(s, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).write.csv(path, sep="\t", header=True)
    return text.read_headed(s, path)


def _letters(s, sf) -> DataFrame:
    """A sequence of nucleotides for each document."""
    seq = F.translate(F.regexp_replace(F.lower("text"), r"[^a-z]", "N"), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTnN")
    return v.table(s, sf, "documents").where("length(text) > 0").select(F.concat(F.lit("chr"), "doc_id").alias("name"), seq.alias("seq"))


_LETTERS = """ntseq as (select 'chr' || doc_id as name, translate(regexp_replace(lower(text), '[^a-z]', 'N', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTnN') as seq from documents where length(text) > 0)"""


def _fasta_bodies(s, sf) -> DataFrame:
    """Of each source a header and the letters of its documents in lines one after the other."""
    d = v.table(s, sf, "documents").select(F.concat(F.lit("chr"), "doc_id").alias("name"), "doc_id", F.concat("source", F.lit(".fa")).alias("file"))
    # a row for each document, not for each line
    body = text.fasta_bodies(_letters(s, sf).join(d, "name")).select(F.col("file").alias("name"), (F.col("doc_id") * (1 << 20) + 1).alias("part"), "body")
    head = d.select("file").distinct()
    head = head.select(F.col("file").alias("name"), F.lit(0).cast("bigint").alias("part"), F.concat(F.lit(">"), F.regexp_replace("file", "[.]fa", " a note"), F.lit("\n")).cast("binary").alias("body"))
    return head.unionByName(body)


def _fasta(s, sf) -> str:
    """A file for each source."""
    folder = new_path(s, "fasta")
    binary.save_files(_fasta_bodies(s, sf), folder)
    return folder


def _fasta_parts(s, sf) -> str:
    """A folder of parts for each source, so that many tasks write its file."""
    folder = new_path(s, "fasta")
    binary.save_parts(_fasta_bodies(s, sf), folder)
    return f"{folder}/*"


_CONTIGS = f"""{_LETTERS}, ctg as (select source as name, string_agg(seq, '' order by doc_id) as seq from ntseq join (select 'chr' || doc_id as name, doc_id, source from documents) using (name) group by source)"""


@query(f"with {_CONTIGS} select name, md5(seq) as digest, length(seq)::int as length from ctg")
def scan_sequences(s, sf):
    d = text.read_fasta(s, _fasta(s, sf))
    return d.select("name", F.md5(F.col("seq").cast("binary")).alias("digest"), F.length("seq").alias("length"))


@query(f"with {_CONTIGS} select sum(length(seq))::bigint as length from ctg")
def sequence_length(s, sf):
    return text.fasta_length(s, _fasta_parts(s, sf))


@query(f"""with {_CONTIGS}, c as (select name as id, unnest(range(1, length(seq) + 1)) as pos, unnest(string_split(seq, '')) as c from ctg),
  g as (select id, pos, pos - row_number() over (partition by id order by pos) as k from c where c in ('n', 'N'))
select id, min(pos) as "start", max(pos) as "end" from g group by id, k""")
def unknown_runs_of_files(s, sf):
    """Runs of N in sequences that are read by lines."""
    p = text.read_fasta_pieces(s, _fasta_parts(s, sf))
    return de.letter_runs(p.select(F.col("name").alias("id"), "start", "seq"))


_FWIN = f"""{_CONTIGS}, w0 as (select name as id, seq, unnest(range(0, cast(ceil(length(seq) / 500) as bigint))) as win from ctg),
  w1 as (select id, win::int as win, substring(seq, win * 500 + 1, 500) as s from w0),
  w2 as (select id, win, s, length(s)::int as len, length(regexp_replace(s, '[^gcGC]', '', 'g'))::int as gc, length(regexp_replace(s, '[^atAT]', '', 'g'))::int as at_ from w1),
  fwin as (select *, case when gc + at_ > 0 then least((gc * 100 // (gc + at_)) * 50 // 100, 49)::bigint end as bin from w2)"""


@query(f'with {_FWIN} select id, win, len, gc, at_ as "at", bin from fwin')
def gc_windows_of_files(s, sf):
    p = text.read_fasta_pieces(s, _fasta_parts(s, sf))
    return de.gc_windows(p.select(F.col("name").alias("id"), "start", "seq"))


@query(f"""with {_LETTERS}, x as (select name, seq, unnest(range(0, length(seq) - 30 + 1)) as i from ntseq where length(seq) >= 30)
select name, count(*) as n, min(md5('>SIM_LOC' || i || chr(10) || substring(seq, i + 1, 30))) as least from x where i between 10 and 60 group by name""")
def tiled_reads(s, sf):
    """Reads of 30 letters that start at 10 to 60 of each sequence, as records of a file."""
    d = sq.kmers(_letters(s, sf).select(F.col("name").alias("id"), "seq"), 30)
    d = text.tiles(d, 10, 60)
    return d.groupBy(F.col("id").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min(F.md5(F.col("value").cast("binary"))).alias("least"))


def _alignments(s, sf) -> DataFrame:
    """Blocks of 160 columns: the second sequence differs from the first at a few places of some, and one row in seven has a gap."""
    k, q = F.col("o_orderkey"), F.col("o_custkey") + F.col("o_orderkey") % 1000
    base = F.translate(F.concat(*(F.md5((q + i).cast("string").cast("binary")) for i in range(5))), "0123456789abcdef", "ACGTACGTACGTACGT")
    at = q % 150 + 1
    other = F.overlay(base, F.lit("n"), at, F.lit(1))
    other = F.when(q % 3 == 0, F.overlay(other, F.lit("n"), (at + 29) % 150 + 1, F.lit(1))).otherwise(other)
    other = F.when(q % 7 == 0, F.overlay(other, F.lit("-"), F.lit(20), F.lit(1))).otherwise(other)
    strand = F.when(q % 2 == 0, "+").otherwise("-")
    size = F.when(q % 5 == 0, 60).otherwise(160)
    second = F.when(q % 11 == 0, F.lit("chrB")).otherwise(F.lit("chrA"))
    return v.table(s, sf, "orders").select(
        k.alias("num"), F.lit("chrA").alias("contig1"), (q * 200).alias("start1"), (q * 200 + size - 1).alias("end1"), second.alias("contig2"), (q * 300 + 7).alias("start2"), (q * 300 + 6 + size).alias("end2"),
        strand.alias("strand"), F.substring(base, F.lit(1), size).alias("s1"), F.substring(other, F.lit(1), size).alias("s2"),
    )


def _axt(s, sf) -> str:
    d = _alignments(s, sf)
    head = F.concat_ws(" ", "num", "contig1", "start1", "end1", "contig2", "start2", "end2", "strand", F.lit("99"))
    note = F.when(F.col("num") % 5 == 0, F.lit("# a comment\n")).otherwise(F.lit(""))
    return _text(d.select(F.concat(note, head, F.lit("\n"), "s1", F.lit("\n"), "s2", F.lit("\n")).alias("value")), "axt")


_AXT = f"""ax as (select o_orderkey as num, o_custkey + o_orderkey % 1000 as q from orders),
  ax0 as (select num, q, q % 150 + 1 as at1, case when q % 3 = 0 then (q % 150 + 30) % 150 + 1 end as at2, case when q % 7 = 0 then 20 end as gap,
    case when q % 5 = 0 then 60 else 160 end as size, case when q % 11 = 0 then 'chrB' else 'chrA' end as contig2, case when q % 2 = 0 then '+' else '-' end as strand,
    translate({" || ".join(f"md5((q + {i})::varchar)" for i in range(5))}, '0123456789abcdef', 'ACGTACGTACGTACGT') as base from ax),
  axt as (select *, q * 200 as start1, q * 200 + size - 1 as end1, q * 300 + 7 as start2, q * 300 + 6 + size as end2 from ax0),
  kept as (select * from axt where contig2 = 'chrA' and size >= 100)"""


@query(f"with {_AXT} select num, 'chrA' as contig1, start1, end1, contig2, start2, end2, strand, 99::bigint as score, substring(base, 1, size::int) as s1 from kept")
def scan_self_alignments(s, sf):
    return text.read_axt(s, _axt(s, sf)).drop("s2")


# 160 columns hold one stretch at most: windows start at 1 to 61, and a second stretch would have to start after the first's end
@query(f"""with {_AXT}, w as (select num, unnest(range(1, 62)) as i from kept),
  wm as (select w.num, i, coalesce((gap between i and i + 99)::int, 0) as gaps, (coalesce((gap between i and i + 99), false))::int + (case when gap is distinct from at1 then (at1 between i and i + 99)::int else 0 end)
      + (case when at2 is not null and at2 <> at1 and gap is distinct from at2 then (at2 between i and i + 99)::int else 0 end) as bad from w join kept using (num)),
  good as (select num, i, i - row_number() over (partition by num order by i) as run from wm where gaps = 0 and bad <= 1),
  isl as (select num, min(i) as s0, max(i) + 99 as e0 from good group by num, run),
  one as (select num, min(s0) as s0, min_by(e0, s0) as e0 from isl group by num),
  cut as (select k.*, s0 + case when s0 in (at1, coalesce(at2, 0)) then 1 + ((s0 + 1) in (at1, coalesce(at2, 0)))::int else 0 end as s, e0 - case when e0 in (at1, coalesce(at2, 0)) then 1 + ((e0 - 1) in (at1, coalesce(at2, 0)))::int else 0 end as e from one join kept k using (num)),
  ids as (select *, row_number() over (order by num) - 1 as edge_id from cut),
  pl as (select *, s - 1 - case when gap < s then 1 else 0 end as s2, e - 1 - case when gap < s then 1 else 0 end as e2 from ids)
select edge_id, 'chrA' as contig, start1 + s - 1 as "start", start1 + e - 1 as "end", '+' as strand from pl
union all select edge_id, 'chrA', case when strand = '-' then 100000000 - (start2 + e2) + 1 else start2 + s2 end, case when strand = '-' then 100000000 - (start2 + s2) + 1 else start2 + e2 end, strand from pl""")
def repeat_pairs(s, sf):
    lengths = s.createDataFrame([("chrA", 100_000_000)], "contig string, length long")
    return si.repeat_pairs(text.read_axt(s, _axt(s, sf)), lengths)


@query(f"""with {v.LINKS} select chr, "from", "to", type::int as type, count, 1::bigint as l_from, 2::bigint as l_to, avg_md, id from links""")
def links_of_four_files(s, sf):
    """The EDGE rows of a file for each type, among other lines."""
    d = v.links(s, sf).withColumn("l_from", F.lit(1)).withColumn("l_to", F.lit(2))
    other = v.table(s, sf, "supplier").select(F.concat(F.lit("CLUSTER "), "s_suppkey").alias("value"))
    paths = [_text(text.link_lines(d.where(f"type = {t}")).unionByName(other), f"t{t}") for t in range(4)]
    return text.read_links(s, paths)


_LINES = """line as (select c_custkey as k, 'k' || (c_custkey // 7) || ' ' || c_name || ' é' as value from customer),
  offs as (select row_number() over (order by k) - 1 as line, coalesce(sum(octet_length(encode(value)) + 1) over (order by k rows between unbounded preceding and 1 preceding), 0)::bigint as "offset", 'k' || (k // 7) as key from line)"""


def _line_index(s, sf) -> DataFrame:
    folder = new_path(s, "lines")
    k = F.col("c_custkey")
    line = F.concat(F.lit("k"), F.expr("c_custkey div 7"), F.lit(" "), "c_name", F.lit(" é\n"))
    binary.save_files(v.table(s, sf, "customer").select(F.lit("lines.txt").alias("name"), k.alias("part"), line.cast("binary").alias("body")), folder)
    return text.line_index(s, folder)


@query(f'with {_LINES} select line, "offset", key from offs')
def line_offsets(s, sf):
    """Where each line of a file begins."""
    return _line_index(s, sf).drop("path")


@query(f'with {_LINES} select min(line) as line, min("offset") as "offset", key from offs group by key')
def key_offsets(s, sf):
    """Where the lines of each key begin, in a file in the order of keys."""
    return text.key_index(_line_index(s, sf)).drop("path")


@query("""with w as (select distinct 'k' || (s_suppkey * 2) as key from supplier), line as (select c_custkey as k, 'k' || (c_custkey // 7) as key, 'k' || (c_custkey // 7) || ' ' || c_name || ' é' as value from customer)
select key, value from line join w using (key)""")
def lines_by_key(s, sf):
    """Lines of many keys of a file, by the offsets of its index: only these are read."""
    keys = v.table(s, sf, "supplier").select(F.concat(F.lit("k"), F.col("s_suppkey") * 2).alias("key"))
    return text.lines_at(text.key_index(_line_index(s, sf)), keys)


# ---- arrays and records ----------------------------------------------------------------------------------------------


def _array_file(s, sf, value: str = "cov") -> str:
    folder = new_path(s, "arrays")
    cov = v.coverage(s, sf).withColumn("lam", F.coalesce("lam", F.lit(-1.0)))
    binary.save_parts(binary.array_blocks(cov, value, 4096, 0.0 if value == "cov" else -1.0), folder)
    return folder


_CHRS = [f"chr{k}" for k in range(5)]


def _each(read):
    """The rows of each chromosome's array."""
    out = None
    for c in _CHRS:
        d = read(c).withColumn("chr", F.lit(c))
        out = d if out is None else out.unionByName(d)
    return out


@query(f"with {v.COVERAGE} select chr, pos, cov as value from cov where cov <> 0")
def scan_depth_array(s, sf):
    folder = _array_file(s, sf)
    return _each(lambda c: binary.read_records(s, f"{folder}/{c}", "double").where("value <> 0"))


@query(f"with {v.COVERAGE} select chr, count(*) filter (where lam is not null) as known, round(sum(lam), 6) as total, (max(pos) - 1) // 4096 * 4096 + 4096 as length from cov group by chr")
def scan_expected_array(s, sf):
    folder = _array_file(s, sf, "lam")
    d = _each(lambda c: binary.read_records(s, f"{folder}/{c}", "double", -1.0))
    return d.groupBy("chr").agg(F.count("value").alias("known"), F.round(F.sum("value"), 6).alias("total"), F.max("pos").alias("length"))


@query(f"""with {v.COVERAGE}, n as (select chr, (max(pos) - 1) // 4096 * 4096 + 4096 as n from cov group by chr), p as (select chr, unnest(range(101, least(n, 9000) + 1)) as pos from n)
select p.chr, p.pos, coalesce(cov, 0)::double as value from p left join cov using (chr, pos)""")
def depth_array_range(s, sf):
    """A stretch of each array, by seeks; a filter on positions ends it."""
    folder = _array_file(s, sf)
    return _each(lambda c: binary.read_range(s, f"{folder}/{c}", "double", 101, None).where("pos <= 9000"))


@query(f"""with {v.COVERAGE}, n as (select chr, (max(pos) - 1) // 4096 * 4096 + 4096 as n from cov group by chr), p as (select chr, unnest(range(n - 2999, n + 1)) as pos from n)
select p.chr, p.pos, coalesce(cov, 0)::double as value from p left join cov using (chr, pos)""")
def depth_array_tail(s, sf):
    folder = _array_file(s, sf)
    return _each(lambda c: binary.records_from(s, f"{folder}/{c}", "double", -3000))


_PACKED = """select read_id, orientation, ref_name, ref_pos, 1.0::double / count(*) over (partition by read_id) as normodds from mappings"""


@query(f"with {v.MAPPINGS} {_PACKED}")
def scan_mapping_records(s, sf):
    """Weighted mappings as records of 40 bytes, written in parts by tasks and read back."""
    folder = new_path(s, "rmap")
    d = rd.block_weights(v.mappings(s, sf)).select("read_id", "orientation", "ref_name", "ref_pos", F.col("weight").alias("normodds"))
    binary.save_parts(binary.record_bodies(d, "mapping", "all"), folder)
    return binary.read_records(s, f"{folder}/all", "mapping").drop("pos")


@query(f"""with {v.EDGES} select contig, pos as "start", pos + length - 1 as "end", case when edge_id % 2 = 0 then '+' else '-' end as strand, edge_id from edges""")
def scan_graph_records(s, sf):
    """Graph positions as records of 64 bytes, written in parts by tasks and read back."""
    folder = new_path(s, "graph")
    d = v.edges(s, sf).select("contig", F.col("pos").alias("start"), (F.col("pos") + F.col("length") - 1).alias("end"), F.when(F.col("edge_id") % 2 == 0, "+").otherwise("-").alias("strand"), "edge_id")
    binary.save_parts(binary.record_bodies(d, "graph", "all"), folder)
    return binary.read_records(s, f"{folder}/all", "graph").drop("pos")


# ---- graph and flow files --------------------------------------------------------------------------------------------


def _graph_tables(s, sf) -> dict[str, DataFrame]:
    e, a = v.edges(s, sf), v.arcs(s, sf)
    return {
        "NODE": e.select((F.col("edge_id") + 1).alias("id"), "contig", "pos", F.lit("+").alias("strand")),
        "ARC": a.select(F.col("arc_id").alias("i"), F.abs("from").alias("from"), (F.col("arc_id") + 1000).alias("fake"), F.abs("to").alias("to"), "len", F.col("hits").cast("double").alias("lam")),
        "PATH": e.select("contig", "pos", F.lit("-").alias("strand"), (2 * F.col("edge_id") + 1).alias("node"), F.col("edge_id").alias("edge")),
        "DG": v.links(s, sf).select(F.col("id").alias("edge"), F.col("chr").alias("contig"), F.col("from").alias("start"), F.col("to").alias("end"), F.col("type").cast("int").alias("o")),
        "GRAPHINFO": a.agg(F.sum("len").alias("length"), F.sum("hits").cast("double").alias("reads"), F.lit(1).alias("funny"), F.lit(2).alias("breaks"), F.lit(0).alias("zero")),
    }


def _graph_file(s, sf) -> dict[str, DataFrame]:
    return text.read_graph(s, _text(text.graph_lines(_graph_tables(s, sf)), "graph"))


@query(f"""with {v.ARCS} select arc_id as i, abs("from") as "from", arc_id + 1000 as fake, abs("to") as "to", len, hits::double as lam from arcs""")
def scan_graph_arcs(s, sf):
    return _graph_file(s, sf)["ARC"]


@query(f"""with {v.EDGES} select contig, pos, '-' as strand, 2 * edge_id + 1 as node, edge_id as edge from edges""")
def scan_graph_paths(s, sf):
    return _graph_file(s, sf)["PATH"]


@query(f"""with {v.LINKS} select id as edge, chr as contig, "from" as "start", "to" as "end", type::int as o from links""")
def scan_graph_links(s, sf):
    return _graph_file(s, sf)["DG"]


@query(f"""with {v.EDGES}, {v.ARCS}, n as (select edge_id + 1 as id, contig, pos from edges)
select count(*) as nodes, max(id) as last, (select sum(len)::bigint from arcs) as length, (select sum(hits)::double from arcs) as reads from n""")
def scan_graph_nodes(s, sf):
    """Number of the nodes of a graph file, the last of them, and what its summary line says."""
    t = _graph_file(s, sf)
    n = gr.graph_size(t["NODE"].withColumnRenamed("id", "edge_id"))
    return n.select(F.col("rows").alias("nodes"), (F.col("size") - 1).alias("last")).join(F.broadcast(t["GRAPHINFO"].select("length", "reads")))  # one row each


@query(f"""with {v.ARCS}, l as (select 'ARC ' || "from" || ' ' || "to" || ' ' || hits || ' ' || len || ' ' || (lam * 100)::bigint as value from arcs union all select 'NODE ' || s_suppkey || ' 0' from supplier) select * from l""")
def problem_lines(s, sf):
    a = v.arcs(s, sf).withColumn("lam", (F.col("lam") * 100).cast("bigint"))
    lines = text.problem_lines(v.table(s, sf, "supplier").select(F.col("s_suppkey").alias("id")), a)
    return s.read.text(_text(lines, "problem"))


@query("""select s_suppkey % 10 as tail, (s_suppkey * 3 + 1) % 10 as head, 0::bigint as low, s_suppkey % 6 + 1 as cap, floor(s_acctbal)::bigint as cost, row_number() over (order by s_suppkey) as arc_id from supplier""")
def scan_flow_problem(s, sf):
    k = F.col("s_suppkey")
    a = v.table(s, sf, "supplier").orderBy(k).select((k % 10).alias("tail"), ((k * 3 + 1) % 10).alias("head"), F.lit(0).alias("low"), (k % 6 + 1).alias("cap"), F.floor("s_acctbal").alias("cost"))
    return text.read_dimacs(s, _text(text.dimacs_lines(a).coalesce(1), "dimacs"))[0]


@query("select c_custkey % 10 as node, (c_nationkey - 12)::bigint as excess, count(*) as n from customer group by all")
def scan_flow_supply(s, sf):
    c = v.table(s, sf, "customer").select((F.col("c_custkey") % 10).alias("node"), (F.col("c_nationkey") - 12).cast("bigint").alias("excess"))
    none = s.createDataFrame([], "tail long, head long, low long, cap long, cost long")
    return text.read_dimacs(s, _text(text.dimacs_lines(none, c), "dimacs"))[1].groupBy("node", "excess").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey as tail, o_custkey as head, o_orderkey % 5 as flow from orders")
def scan_flows(s, sf):
    o = v.table(s, sf, "orders").select(F.concat_ws(" ", F.lit("f"), "o_orderkey", "o_custkey", F.col("o_orderkey") % 5).alias("value"))
    return text.read_flows(s, _text(o.unionByName(o.limit(0)).unionByName(s.createDataFrame([("s 70",), ("c solved",)], "value string")), "flows"))


_DUMP = """dump as (select s_suppkey as edge_id, s_suppkey % 25 as from_node, s_suppkey * 7 % 25 as to_node, s_suppkey % 11 * 40 as length from supplier)"""


def _dumped(s, sf, kind):
    k = F.col("s_suppkey")
    e = v.table(s, sf, "supplier").select(k.alias("edge_id"), (k % 25).alias("from_node"), (k * 7 % 25).alias("to_node"), (k % 11 * 40).alias("length"))
    return s.read.text(_text(text.graph_dump(e, e, kind), "dump"))


@query(f"with {_DUMP} select from_node || ' ' || edge_id || ' ' || to_node as value from dump")
def graph_dump_sif(s, sf):
    return _dumped(s, sf, "sif")


@query(f"with {_DUMP} select from_node || ' (' || edge_id || ') ' || to_node || ' = ' || length as value from dump")
def graph_dump_attributes(s, sf):
    return _dumped(s, sf, "attributes")


@query(f"with {_DUMP} select concat_ws(chr(9), edge_id, from_node, to_node, length) as value from dump")
def graph_dump_table(s, sf):
    return _dumped(s, sf, "table")


# ---- sinks -----------------------------------------------------------------------------------------------------------


@query(f"with {v.MAPPINGS} select read_id, orientation, ref_pos, ref_name from mappings where ref_name in (select 'chr' || r_regionkey from region where r_regionkey < 3)")
def mappings_by_reference(s, sf):
    refs = v.table(s, sf, "region").where("r_regionkey < 3").select(F.concat(F.lit("chr"), F.col("r_regionkey")).alias("ref_name"))
    path = new_path(s, "rmap")
    text.write_by_reference(v.mappings(s, sf), path, refs)
    return s.read.parquet(path).select("read_id", "orientation", "ref_pos", "ref_name")


@query(f"""with {v.LINKS}, o as (select *, row_number() over (partition by chr, type order by case when type in (0, 2) then "from" else "to" end, case when type in (0, 2) then "to" else "from" end, id) as nth from links)
select chr, type::int as type, id, "from", "to", nth from o""")
def pairs_by_reference_and_type(s, sf):
    """Pairs in a folder for each reference and type, in the order that clustering takes them in."""
    main = F.when(F.col("type").isin(0, 2), F.col("from")).otherwise(F.col("to")).alias("main")
    rest = F.when(F.col("type").isin(0, 2), F.col("to")).otherwise(F.col("from")).alias("rest")
    path = new_path(s, "mmap")
    text.write_sorted(v.links(s, sf).select("id", "chr", F.col("type").cast("int").alias("type"), "from", "to", main, rest), path, ("chr", "type"), ("main", "rest", "id"))
    d = s.read.parquet(path).withColumn("at", F.monotonically_increasing_id())
    return text.in_file_order(d, ("chr", "type")).select("chr", "type", "id", "from", "to", "nth")


@query(f"""with {v.CALLS} select chr, "start"::varchar as "start", "end"::varchar as "end", case when cast(trunc(flow_diff) as bigint) > 0 then 'gain' else 'loss' end as call from calls""")
def calls_file(s, sf):
    from genoflux.operators import calls as ca

    path = new_path(s, "calls")
    text.write_calls(ca.final_calls(ca.truncated(v.calls(s, sf))), path)
    return s.read.csv(path, sep="\t").toDF("chr", "start", "end", "call", "folder").drop("folder")


@query("select strftime(ts, '%-H:%-M:%-S, %a %b %-d, %Y') || chr(9) || chr(9) || event_type || ' ' || user_id as value from events")
def execution_log(s, sf):
    path = new_path(s, "log")
    text.append_log(v.table(s, sf, "events").select("ts", F.concat_ws(" ", "event_type", "user_id").alias("command")), path)
    return s.read.text(path)


@query("""select l_linenumber as j, count(*) as n, count(*) as inside, count(*) filter (l_linenumber % 2 <> 0) as flipped, 7::bigint as different, true as even from lineitem group by l_linenumber""")
def random_and_flip(s, sf):
    """Random whole numbers from 3 to 9 of each line number: all lie there, each comes up, none much more often than others; truth values turned over."""
    d = v.table(s, sf, "lineitem").select("l_linenumber", sq.random_between(3, 9, 5).alias("r"), sq.flip(F.col("l_linenumber") % 2 == 0).alias("odd"))
    count = F.count(F.lit(1))
    every = d.groupBy(F.col("l_linenumber").alias("j"), "r").agg(count.alias("k"), F.count(F.when(F.col("odd"), 1)).alias("odd"))
    n = F.sum("k")
    even = (F.max("k") < n / 7 + 6 * F.sqrt(n / 7)) & (F.min("k") > n / 7 - 6 * F.sqrt(n / 7))
    return every.groupBy("j").agg(n.alias("n"), F.sum(F.when(F.col("r").between(3, 9), F.col("k"))).alias("inside"), F.sum("odd").alias("flipped"), count.alias("different"), even.alias("even"))


@query("""select p_partkey as k, p_partkey::varchar as whole, format('{:g}', p_retailprice::double) as broken, case when p_size % 2 = 0 then '1' else '0' end as truth, coalesce(p_partkey, 0)::bigint as number, p_size::bigint as begun, 0::bigint as none from part""")
def text_and_number(s, sf):
    """Values as text, and the numbers that texts begin with."""
    d = v.table(s, sf, "part")
    lead = F.concat(F.lit(" \t"), F.col("p_size").cast("string"), F.lit(" x9"))
    return d.select(
        F.col("p_partkey").alias("k"), sq.make_string(F.col("p_partkey")).alias("whole"), sq.make_string(F.col("p_retailprice").cast("double")).alias("broken"), sq.make_string(F.col("p_size") % 2 == 0).alias("truth"),
        sq.make_int(sq.make_string(F.col("p_partkey"))).alias("number"), sq.make_int(lead).alias("begun"), sq.make_int(F.concat(F.lit("x"), "p_name")).alias("none"),
    )


@query("""select 'option sd is missing' as wrong union all select 'option least is not a number from 0' union all select 'mode both is none of all, stage1, stage2'
union all select 'sequence of ' || n_name || ' is missing' from nation where n_nationkey % 4 = 0 or n_nationkey % 3 = 0""")
def run_input_check(s, sf):
    """What is wrong with the inputs of a run: a mode, two options, and references without a sequence."""
    from . import pipeline

    names = v.table(s, sf, "nation").select("n_nationkey", "n_name")
    folder = new_path(s, "inputs")
    there = names.where("n_nationkey % 4 <> 0 and n_nationkey % 3 <> 0")
    binary.save_files(there.select(F.concat("n_name", F.lit(".fa")).alias("name"), F.lit(0).alias("part"), F.lit(">x\n").cast("binary").alias("body")), folder)
    refs = [r.n_name for r in names.collect()]  # the references of a run are its options
    wrong = pipeline.check_inputs(s, "both", {"mean": 200, "read_len": 36, "least": -1}, refs, {"sequence": f"{folder}/{{ref}}.fa"})
    return s.createDataFrame([(w,) for w in wrong], "wrong string")
