"""Paths that small tables don't take by themselves: long intervals, several slices, files and splits, broken inputs."""

import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from genoflux import scratch
from genoflux.operators import calls as ca
from genoflux.operators import depth as de
from genoflux.operators import flow as fl
from genoflux.operators import graph as gr
from genoflux.operators import intervals as iv
from genoflux.operators import reads as rd
from genoflux.plans import pipeline
from genoflux.sources import binary, text


def test_overlaps_of_long_intervals(spark):
    rng = random.Random(1)
    left = [(f"c{rng.randint(0, 1)}", s := rng.randint(1, 5000), s + rng.choice([3, 40, 900])) for _ in range(300)]
    left += left[:9]
    right = [(f"c{rng.randint(0, 1)}", s := rng.randint(1, 5000), s + rng.choice([1, 30])) for _ in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "chr string, start long, end long")
    hit = lambda a: any(a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2] for b in right)
    assert sorted(map(tuple, iv.overlap_anti(frame(left), frame(right), 64).collect())) == sorted(a for a in left if not hit(a))
    assert sorted(map(tuple, iv.overlap_semi(frame(left), frame(right), 64).collect())) == sorted(a for a in left if hit(a))


def test_smoothing_over_slices(spark):
    rng = random.Random(2)
    rows = [(f"c{rng.randint(0, 1)}", s := rng.randint(1, 30_000), s + rng.randint(0, 400), rng.randint(-2, 2)) for _ in range(600)]
    want = [(c, *r) for c in ("c0", "c1") for r in ca.smooth(sorted((s, e, float(v)) for k, s, e, v in rows if k == c)) if r[1] - r[0] >= 100]
    d = spark.createDataFrame(rows, "chr string, start long, end long, call long")
    got = [(r.chr, r.start, r.end, round(r.call, 9)) for r in ca.smooth_calls(d, 5.0, 100, 512).collect()]
    assert sorted(got) == sorted((c, s, e, round(v, 9)) for c, s, e, v in want)


def test_sequences_in_pieces(spark, tmp_path):
    rng = random.Random(3)
    seq = {f"s{k}": "".join(rng.choice("ACGTNNnn") for _ in range(rng.randint(1, 3000))) for k in range(5)}
    for name, s in seq.items():
        (tmp_path / f"{name}.fa").write_text(f">{name} note\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        p = text.read_fasta_pieces(spark, str(tmp_path)).select(F.col("name").alias("id"), "start", "seq").cache()
        got = {}
        for r in p.collect():
            got.setdefault(r.id, {})[r.start] = r.seq
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {k: "".join(x[i] for i in sorted(x)) for k, x in got.items()} == seq
    whole = spark.createDataFrame(list(seq.items()), "id string, seq string")
    for f in (de.letter_runs, de.gc_windows):
        assert sorted(map(tuple, f(p).collect())) == sorted(map(tuple, f(whole).collect()))
    assert sorted(map(tuple, de.letter_runs(whole).collect())) == sorted((k, m.start() + 1, m.end()) for k, s in seq.items() for m in __import__("re").finditer("[nN]+", s))


def test_records_in_splits(spark, tmp_path):
    values = [random.Random(4).random() for _ in range(20_000)]
    (tmp_path / "a").write_bytes(struct.pack(f"<{len(values)}d", *values))
    spark.conf.set("spark.hadoop.mapreduce.input.fileinputformat.split.maxsize", "20000")
    path = str(tmp_path / "a")
    assert [(r.pos, r.value) for r in binary.read_records(spark, path, "double").orderBy("pos").collect()] == [(i + 1, v) for i, v in enumerate(values)]
    assert [(r.pos, r.value) for r in binary.read_range(spark, path, "double", 7, 9).collect()] == [(i, values[i - 1]) for i in (7, 8, 9)]
    assert [r.pos for r in binary.records_from(spark, path, "double", -2).collect()] == [19_999, 20_000] and binary.records_from(spark, path, "double", 19_990).count() == 10
    assert binary.read_range(spark, path, "double", 30_000, 40_000).count() == 0


def test_mates_in_bins(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(20), f"chr{rng.randint(0, 1)}", rng.randint(1, 2000), rng.choice("+-")) for _ in range(400)]
    d = spark.createDataFrame(rows, "read_id long, ref_name string, ref_pos long, orientation string")
    every = [tuple(r) for r in rd.mate_pairs(d, 36).collect() if r.right_pos - r.left_pos <= 150]
    assert sorted(tuple(r) for r in rd.mate_pairs(d, 36, 150).collect()) == sorted(every) and every


def test_position_beyond_its_reference(spark):
    d = spark.createDataFrame([(1, "c", 5, "+"), (2, "c", 11, "+")], "read_id long, ref_name string, ref_pos long, orientation string")
    lengths = lambda n: spark.createDataFrame([("c", n)], "ref_name string, length long")
    assert rd.coverage(d, lengths(11)).count() == 2
    with pytest.raises(Exception, match="position 11 is beyond c"):
        rd.coverage(d, lengths(10)).collect()


def test_links_off_their_contig(spark):
    occ = spark.createDataFrame([("c", 1, 100, 0, "+"), ("c", 101, 300, 1, "+")], "chr string, start long, end long, edge_id long, strand string")
    links = spark.createDataFrame([("c", 1, 101, 0), ("c", 0, 101, 0), ("c", 1, 999_999, 0), ("c", 101, 300, 2)], "chr string, from long, to long, type int")
    assert sorted(tuple(r) for r in gr.donor_arcs(occ, links).collect()) == [(0, 0, 2, 1), (2, 0, 2, 0)]


def test_restart_after_a_change_of_costs():
    rng = random.Random(7)
    for _ in range(100):
        n = rng.randint(2, 7)
        arcs = [(rng.randrange(n), rng.randrange(n), 0, rng.randint(0, 6), rng.randint(-9, 20)) for _ in range(rng.randint(1, 20))]
        first = fl.min_cost_flow(n, arcs)
        changed = [(*a[:4], a[4] + rng.randint(-6, 6)) for a in arcs]
        cost = lambda f: sum(a[4] * x for a, x in zip(changed, f))  # noqa: E731, B023
        again = fl.min_cost_flow(n, changed, start=first)[0]
        assert cost(again) == cost(fl.min_cost_flow(n, changed)[0])


def test_inputs_of_a_run(spark, tmp_path):
    (tmp_path / "chr1.fa").write_text(">x\n")
    good = {"mean": 200, "sd": 10.5, "read_len": 36, "least": 3}
    assert pipeline.check_inputs(spark, "all", good, ["chr1"], {"sequence": f"{tmp_path}/{{ref}}.fa"}) == []
    wrong = pipeline.check_inputs(spark, "both", {"mean": -1, "sd": 1, "read_len": 3.5}, ["chr1", "chr2"], {"sequence": f"{tmp_path}/{{ref}}.fa"})
    assert len(wrong) == 5 and "sequence of chr2 is missing" in wrong
    assert "no references" in pipeline.check_inputs(spark, "all", good, [], {})


def test_scratch_tables(spark, monkeypatch):
    since = scratch.mark()
    a = scratch.materialise(spark.range(5), "a")
    b = scratch.materialise(a, "b")
    scratch.drop_since(since, keep=1)
    assert b.count() == 5 and scratch.mark() == since + 1
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|not found|PATH_NOT_FOUND"):
        a.where("id > 1").count()

    class Conf:
        def get(self, *_):
            return None

    class Far:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(Conf)  # noqa: N815

        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(Far)


def test_runs_and_repeats_by_components(spark):
    rng = random.Random(8)
    rows = [(f"c{k % 2}", 10 * k + 1, e := rng.randrange(150), 5 + e % 40, 5 + e % 40, float(e % 5 - 2)) for k in range(500)]
    d = spark.createDataFrame(rows, "contig string, pos long, edge_id long, length long, decide long, diff double")
    want = []
    for c in ("c0", "c1"):
        path = [r for r in rows if r[0] == c]
        each = [dict((r[2], r[k]) for r in path) for k in (3, 4, 5)]
        want += [(c, *call) for call in ca.extract_runs([(r[1], r[2]) for r in path], *each, 30)]
    for at_once in (10**6, 20):
        assert sorted(tuple(r) for r in ca.call_runs(d, 30, at_once).collect()) == sorted(want) and len(want) > 40
    places = []
    for e in range(60):
        size, far = rng.randint(5, 30), rng.random() < 0.3
        for way in ("+", rng.choice("+-")):
            s = rng.randint(1, 9000) if far else 150 * e + rng.randint(1, 100)
            places.append((f"c{e % 2}", e, s, s + size - 1, way))
    p = spark.createDataFrame(places, "contig string, edge_id long, start long, end long, strand string")
    want = [(c, *r) for c in ("c0", "c1") for r in gr.refine([x[1:] for x in places if x[0] == c])]
    for at_once in (10**6, 5):
        assert sorted(tuple(r) for r in gr.refine_repeats(p, at_once).collect()) == sorted(want)


def test_full_blocks_of_arrays(spark):
    d = spark.range(64 << 15).select(F.lit("c").alias("chr"), (F.col("id") + 1).alias("pos"), F.col("id").cast("double").alias("v"))
    began = time.monotonic()
    got = binary.array_blocks(d, "v", 1 << 15).select("part", F.length("body").alias("n")).collect()
    assert sorted((r.part, r.n) for r in got) == [(k, 8 << 15) for k in range(64)] and time.monotonic() - began < 60
    twice = spark.createDataFrame([("c", 1, 2.0), ("c", 1, 3.0)], "chr string, pos long, v double")
    with pytest.raises(Exception, match="two values"):
        binary.dense_blocks(twice, "v", 4).collect()


def test_many_runs_in_a_piece(spark):
    d = spark.createDataFrame([(1, 1, "na" * 200_000)], "id long, start long, seq string")
    began = time.monotonic()
    got = de.letter_runs(d).agg(F.count(F.lit(1)), F.max("end")).first()
    assert tuple(got) == (200_000, 399_999) and time.monotonic() - began < 60


def _brute_windows(seqs, masks, size):
    out = []
    for k, s in seqs.items():
        hidden = {p for c, a, z in masks if c == k for p in range(a, z + 1)}
        for w in range(-(-len(s) // size)):
            part = [(p, s[p - 1]) for p in range(w * size + 1, min(len(s), (w + 1) * size) + 1)]
            out.append((k, w, len(part), sum(c in "gcGC" for _, c in part), sum(c in "atAT" for _, c in part), sum(c in "nN" or p in hidden for p, c in part)))
    return sorted(out)


def test_masked_windows(spark):
    """Windows over whole sequences and pieces of any length, with letters of several bytes, and masks that overlap, reach over windows and beyond both ends."""
    rng = random.Random(8)
    seqs = {k: "".join(rng.choice("acgtnNGé ") for _ in range(rng.choice([1, 4, 5, 6, 700, 40_000]))) for k in range(12)} | {12: "", 13: "n" * 11}
    masks = [(rng.randrange(16), a := rng.randint(-20, 900), a + rng.choice([-1, 0, 3, 30, 50_000])) for _ in range(40)]
    whole = spark.createDataFrame(list(seqs.items()), "id long, seq string")
    cut = spark.createDataFrame([(k, a + 1, s[a : a + 7001]) for k, s in seqs.items() for a in range(0, len(s), 7001)], "id long, start long, seq string")
    m = spark.createDataFrame(masks, "chr long, start long, end long")
    for size in (5, 500):
        want = _brute_windows(seqs, masks, size)
        for d in (whole, cut):
            got = de.masked_windows(d, m, size)
            assert sorted((r.id, r.win, r.len, r.gc, r.at, r.masked) for r in got.collect()) == want
        assert sorted((r.id, r.win, r.len, r.gc, r["at"]) for r in de.gc_windows(cut, size).collect()) == [r[:5] for r in want]
        known = {k: s.replace("n", "a").replace("N", "a") for k, s in seqs.items()}
        assert sorted((r.id, r.win) for r in de.unmasked(de.gc_windows(whole, size), m, size).collect()) == [r[:2] for r in _brute_windows(known, masks, size) if not r[5]]
    # the stretches of position_lambda say the same as the windows' sums
    lam = spark.createDataFrame([(b, 0.25 + b) for b in range(50)], "bin long, lam double")
    runs = de.position_lambda(de.gc_windows(whole), m.where("start <= end").unionByName(de.letter_runs(whole).withColumnRenamed("id", "chr")), lam).withColumn("n", F.col("end") - F.col("start") + 1)
    by = runs.groupBy(F.col("chr").alias("id")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("lam").isNotNull(), F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("lam").cast("decimal(18,6)") * F.col("n")).cast("double").alias("x"))
    assert sorted(map(tuple, by.collect())) == sorted(map(tuple, de.expected_in_windows(de.masked_windows(whole, m), lam).collect()))


def test_masked_windows_make_no_rows_of_runs(spark, monkeypatch):
    from genoflux.plans import catalogue

    monkeypatch.setattr(de, "letter_runs", None)
    for name in ("gc_bin_lambda_of_clean_windows", "expected_depth"):
        assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count()


def test_fasta_files_of_many_tasks(spark, tmp_path):
    """A file that several tasks write as parts is read as one, in the order of its lines, which are joined without a sort."""
    want, rows = {}, []
    for name in ("one", "two"):
        seq = "".join("ACGTn"[(k * k + len(name) * k) % 5] for k in range(3217))
        want[name] = seq
        rows += [(f"{name}.fa", 0, f">{name} a note\n".encode())] + [(f"{name}.fa", k + 1, (seq[i : i + 60] + "\n").encode()) for k, i in enumerate(range(0, len(seq), 60))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        binary.save_parts(spark.createDataFrame(rows, "name string, part long, body binary"), str(tmp_path / "x"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "x").glob("*/part-*"))) > 2
    p = text.read_fasta_pieces(spark, str(tmp_path / "x" / "*"))
    got = sorted((r.name, r.start, r.seq) for r in p.collect())
    assert {n: "".join(q for m, _, q in got if m == n) for n in want} == want
    assert all(want[n][at - 1 : at - 1 + len(q)] == q for n, at, q in got) and len({r.path for r in p.collect()}) == 2
    assert text.fasta_length(spark, str(tmp_path / "x" / "*")).first()[0] == 2 * 3217
    assert "SortMergeJoin" not in p._jdf.queryExecution().executedPlan().toString()
