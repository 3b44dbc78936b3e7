import random
import struct

import pytest
from pyspark.sql import functions as F

from genoflux.operators import similar as si
from genoflux.sources import bam, binary, text


def put(path, s, mode="w"):
    with open(path, mode) as f:
        f.write(s)
    return str(path)


def test_mappings(spark, tmp_path):
    p = put(tmp_path / "m.txt", "1 + chr2 10\n2\t-\tchr3 20\n")
    assert [tuple(r) for r in text.read_mappings(spark, p).collect()] == [(1, "+", "chr2", 10), (2, "-", "chr3", 20)]
    p = put(tmp_path / "b.txt", "3+:<24,11910070,2>\n4-:<0,7,0>\n5+:<22,1,0>\n")
    assert [tuple(r) for r in text.read_mappings(spark, p, "bowtie_concise").collect()] == [(3, "+", "chr24", 11910071), (4, "-", "chr1", 8), (5, "+", "chr0", 2)]


def test_intervals_rows_fasta(spark, tmp_path):
    p = put(tmp_path / "i", "chr1 5 9 a b\nchr2\t1\t2\n")
    assert [tuple(r) for r in text.read_intervals(spark, p).collect()] == [("chr1", 5, 9, " a b"), ("chr2", 1, 2, "")]
    assert [tuple(r) for r in text.read_rows(spark, put(tmp_path / "r", "#x\na b  c\n"), ["x", "y"]).collect()] == [("a", "b")]
    f = put(tmp_path / "f.fa", ">chr1 note\nACGT\nAC\n")
    assert text.read_fasta(spark, f).select("name", "seq").first() == ("chr1", "ACGTAC")
    assert text.fasta_length(spark, f).first()[0] == 6
    s = text.read_fasta(spark, f)
    assert [r.value for r in text.tile_fasta(s, 1, 9, 4).orderBy("i").collect()] == [">SIM_LOC1\nCGTA", ">SIM_LOC2\nGTAC"]
    assert [tuple(r) for r in text.chunk_sequence(s, 4, 1).orderBy("chunk").collect()] == [("chr1", 0, 1, "ACGTA"), ("chr1", 1, 5, "AC")]
    assert text.read_file_list(spark, put(tmp_path / "l", "a\nb\n")) == ["a", "b"]


def test_axt_to_pairs(spark, tmp_path):
    s = "ACGT" * 40
    p = put(tmp_path / "x.axt", f"# made by hand\n0 c 101 260 c 301 460 - 99\n{s}\n{s}\n\n1 c 1 50 c 60 109 + 5\n{s[:50]}\n{s[:50]}\n\n")
    d = text.read_axt(spark, p)
    assert d.count() == 1
    got = si.repeat_pairs(d, spark.createDataFrame([("c", 1000)], "contig string, length long"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, "c", 101, 260, "+"), (0, "c", 541, 700, "-")]


def test_graph_and_flow_files(spark, tmp_path):
    p = put(tmp_path / "g", "NODE 1 c 5 +\nARC 0 1 9 2 100 0.5\nPATH c 5 + 1 0\nDG 3 c 1 9 2\nGRAPHINFO 10 2.5 1 0 0\n")
    t = text.read_graph(spark, p)
    assert t["ARC"].first()["lam"] == 0.5 and t["NODE"].first()["contig"] == "c" and t["DG"].count() == 1
    assert "ARC 0 1 9 2 100 0.5" in [r.value for r in text.graph_lines(t).collect()]
    p = put(tmp_path / "d", "c x\np min 2 1\nn 1 5\nn 2 -5\na 1 2 0 9 3\n")
    arcs, supply = text.read_dimacs(spark, p)
    assert arcs.select("tail", "head", "low", "cap", "cost", "arc_id").first() == (1, 2, 0, 9, 3, 1) and supply.count() == 2
    assert sorted(r.value for r in text.dimacs_lines(arcs, supply).collect()) == ["a 1 2 0 9 3", "n 1 5", "n 2 -5"]
    assert text.read_flows(spark, put(tmp_path / "s", "s 15\nf 1 2 5\n")).first() == (1, 2, 5)


def test_problem_lines(spark):
    arcs = spark.createDataFrame([(1, -2, 2.5, 100, 0.5)], "from long, to long, hits double, len long, lam double")
    assert sorted(r.value for r in text.problem_lines(spark.range(1, 2), arcs).collect()) == ["ARC 1 -2 2.5 100 0.5", "NODE 1 0"]


def test_binary(spark, tmp_path):
    p = put(tmp_path / "a", struct.pack("<3d", 1.5, -1.0, 2.0), "wb")
    assert [tuple(r) for r in binary.read_records(spark, p, "double", -1.0).orderBy("pos").collect()] == [(1, 1.5), (2, None), (3, 2.0)]
    raw = struct.pack("<Qc10s5xQd", 7, b"+", b"chr1", 42, 0.5)
    assert len(raw) == 40
    assert tuple(binary.read_records(spark, put(tmp_path / "m", raw, "wb"), "mapping").first()) == (1, 7, "+", "chr1", 42, 0.5)
    graph = struct.pack("<32sQQc7xQ", b"c", 1, 9, b"-", 3)
    assert len(graph) == 64
    assert tuple(binary.read_records(spark, put(tmp_path / "g", graph, "wb"), "graph").first()) == (1, "c", 1, 9, "-", 3)
    assert binary.pack_array([1.5, None]) == struct.pack("<2d", 1.5, -1.0)
    d = spark.createDataFrame([("c", 1, 2.0), ("c", 5, 3.0)], "chr string, pos long, v double")
    assert [list(r.body) for r in binary.dense_blocks(d, "v", 4).orderBy("block").collect()] == [[2.0, 0, 0, 0], [3.0, 0, 0, 0]]


def test_bam_round_trip(spark, tmp_path):
    recs = [
        ("r1", 0, 99, 16, 60, 4681, [("M", 4), ("I", 1)], "ACGTN", "IIIII", -1, -1, 0, b"NMi" + struct.pack("<i", 2) + b"RGZx\0"),
        ("r1", -1, -1, 4, 0, 0, [], "", "", -1, -1, 0, b""),
        ("r2", 0, 199, 0, 9, 4681, [("M", 3)], "ACG", "###", 0, 5, 7, b""),
    ]
    p = put(tmp_path / "x.bam", bam.encode([("chr1", 1000)], recs, "@HD\tVN:1.0\n"), "wb")
    d = bam.read_bam(spark, p)
    rows = d.orderBy("ordinal").collect()
    assert [r.read_id for r in rows] == [0, 0, 1] and rows[0].tags == {"NM": "2", "RG": "x"} and rows[0].bases == "ACGTN"
    assert [tuple(r) for r in text.read_mappings(spark, p, "bam").orderBy("read_id", "ref_pos").collect()] == [(0, "+", "-1", 0), (0, "-", "chr1", 100), (1, "+", "chr1", 200)]
    assert bam.in_region(d, "chr1", 150, 210).count() == 1
    again = bam.write_bam(d.where("tags is not null"), [("chr1", 1000)]).collect()
    assert sum(len(list(bam.parse(bam.inflate(r.body))[1])) for r in again) == 3


def test_bam_in_splits(spark, tmp_path):
    rng = random.Random(4)
    recs = []
    for i in range(3000):
        n = rng.choice([0, 20, 90, 4000 if i % 50 == 0 else 60])
        tags = b"XAZ" + bytes(rng.randrange(33, 127) for _ in range(rng.randint(0, 300))) + b"\0"
        recs.append((f"r{i // rng.choice([1, 2, 3])}", rng.randint(-1, 2), rng.randint(-1, 10**6), rng.choice([0, 4, 16]), 9, 4681, [("M", n)] if n else [], "".join(rng.choice("ACGTN") for _ in range(n)), "I" * n, -1, -1, 0, tags))
    refs = [(f"chr{k}", 10**6) for k in range(3)]
    for name, part in (("a.bam", recs[:2000]), ("b.bam", recs[2000:])):
        put(tmp_path / name, bam.encode(refs, part, "@HD\tVN:1.0\n" + "@CO\t" + "x" * 70_000 + "\n"), "wb")
    want, ids = [], -1
    for f, part in enumerate((recs[:2000], recs[2000:])):
        last = None
        for k, r in enumerate(part):
            ids += r[0] != last
            last = r[0]
            want.append((ids, f, k, r[0], r[1], r[2], r[7], r[12][3:-1].decode()))
    for size in ("20k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            d = bam.read_bam(spark, str(tmp_path))
            got = [(r.read_id, int(r.path.endswith("b.bam")), r.ordinal, r.name, r.ref_id, r.position, r.bases, r.tags["XA"]) for r in d.collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(got) == want
    region = bam.in_region(bam.read_records(spark, str(tmp_path)), "chr1", 1000, 50_000)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = region._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(ref_name,chr1)" in plan and "LessThan(position,50000)" in plan
    assert region.count() == sum(r[1] == 1 and r[2] < 50_000 and r[2] + len(r[7]) > 1000 for r in recs)


def test_bam_that_ends_inside_a_record(spark, tmp_path):
    whole = bam.encode([("chr1", 1000)], [(f"r{i}", 0, i, 0, 9, 0, [], "", "", -1, -1, 0, b"") for i in range(9)])
    data = bam.inflate(whole)[:-7]
    put(tmp_path / "x.bam", bam.block(data) + bam.EOF, "wb")
    with pytest.raises(Exception, match="ends inside a record"):
        bam.read_bam(spark, str(tmp_path / "x.bam")).count()


def test_partitioned_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "ref_name string, x long")
    text.write_by_reference(d, str(tmp_path / "out"), spark.createDataFrame([("a",), ("b",)], "ref_name string"))
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("ref_name") == "a").count() == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    c = spark.createDataFrame([("chr1", 1, 2, "gain", 1.5)], "chr string, start long, end long, call string, doc_ratio double")
    text.write_calls(c, str(tmp_path / "calls"))
    assert spark.read.text(str(tmp_path / "calls" / "_chr=chr1")).first()[0] == "chr1\t1\t2\tgain\t1.5"
