import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from genoflux.functions import alignment as al
from genoflux.functions import sequence as sq


def one(spark, *cols):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())


def test_sequence(spark):
    L = F.lit
    assert one(spark, sq.revcomp(L("ACGTN")), sq.canonical(L("TTG")), sq.is_flipped(L("TTG")), sq.thousands(L(1234567))) == ("XACGT", "CAA", True, "1,234,567")
    assert one(spark, sq.hamming(L("ACGT"), L("AGGA")), sq.hamming_any(L("AAAA"), L("TTTT")), sq.base_code(L("g")), sq.base_code(L("N")), sq.code_base(L(3))) == (2, 0, 2, None, "T")
    assert one(spark, sq.chromosome_of(L("/w/chrdir/chr7.scov")), sq.bowtie_read_id(L("3+:<24,11910070,2>"))) == ("chr7", 3)


def test_alignment(spark):
    L = F.lit
    c = al.parse_cigar(L("10M3I2D"))
    assert one(spark, al.reference_end(L(5), c))[0] == 17
    assert one(spark, al.aligned_bases(L("ACGTACG"), al.parse_cigar(L("1S2M1D1I2N1P3M2H"))))[0] == "CG-TNN*ACG"
    assert one(spark, al.has_flag(L(16), "is_reverse"), al.set_flag(L(16), "is_reverse", False)) == (True, 0)
    assert one(spark, al.region_bin(L(0), L(1)), al.region_bin(L(0), L(1 << 29)), al.round_up_power(L(5)), al.round_up_power(L(8))) == (4681, 0, 8, 8)
    assert one(spark, F.array_contains(al.region_bins(L(100), L(200)), L(4681).cast("bigint")))[0]


def test_kmers_and_mask(spark):
    d = spark.createDataFrame([(1, "ACGTA"), (2, "AC"), (3, None)], "id long, seq string")
    assert sorted(r.kmer for r in sq.kmers(d, 3).collect()) == ["ACG", "CGT", "GTA"]
    m = spark.createDataFrame([("g", 1, "ABC"), ("g", 2, "ABD")], "g string, k int, s string")
    assert sorted(r.masked for r in sq.mask_same_columns(m, "g", "k", "s").collect()) == ["  C", "  D"]


def test_make_string_and_int(spark):
    values = [0.0, 1.0, -2.5, 123456.0, 1234567.0, 0.0001234567, 0.00001234, 1e20, -1e-7, 999999.5, 3.14159265, 1024.5, 1e-300]
    d = spark.createDataFrame([(x,) for x in values], "x double").select("x", sq.make_string(F.col("x")).alias("t"))
    assert all(r.t == "%g" % r.x for r in d.collect())
    texts = {"12": 12, " \t-7x": -7, "+3.9": 3, "": 0, "x1": 0, "- 1": 0, None: 0, "99999999999999999999": 0}
    d = spark.createDataFrame([(x,) for x in texts], "s string").select("s", sq.make_int(F.col("s")).alias("n"))
    assert {r.s: r.n for r in d.collect()} == texts


def test_counts_and_cover_of_kmers(spark):
    rng = random.Random(5)
    texts = ["", "abc", "aaaaaa"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for alphabet in ("ab", "abé", "a😀b") for _ in range(20)]
    texts.append("".join(map(chr, range(200, 60_000, 7))).encode("utf-8", "ignore").decode())
    for k in (3, 8):
        d = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
        want = Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1))
        counts = sq.kmer_counts(d, k)
        assert {r.kmer: r.n for r in counts.collect()} == want
        cover = []
        for n, t in enumerate(texts):
            on = [any(want[t[j : j + k]] > 3 for j in range(max(0, i - k + 1), min(i, len(t) - k) + 1)) for i in range(len(t))]
            starts = [j for j in range(len(t) - k + 1) if want[t[j : j + k]] > 3]
            runs = []
            for j in starts:
                if runs and j < runs[-1][1]:
                    runs[-1][1] = j + k
                else:
                    runs.append([j, j + k])
            assert sum(on) == sum(z - a for a, z in runs)
            cover += [(n, a + 1, z) for a, z in runs]
        assert sorted(map(tuple, sq.covered_by(d, counts.where("n > 3"), k).collect())) == sorted(cover)


class _Task:
    """Stands for a table: keeps the function that tasks would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        return self

    groupBy = agg = select  # noqa: N815


def test_memory_of_counting_kmers(spark, monkeypatch):
    """Eight million letters are counted in far less memory than numbers of eight bytes for each, several times over, would take."""
    task = _Task()
    task.sparkSession = None
    monkeypatch.setattr(sq, "_dealt", lambda *_: task)
    monkeypatch.setattr(sq, "ship", lambda _: None)
    sq.kmer_counts(task, 8)
    text = np.random.default_rng(1).choice(np.frombuffer(b"abcdefgh \n", np.uint8), 8 << 20).tobytes().decode()
    rows = pa.RecordBatch.from_arrays([pa.array([text[:5_000_000], text[5_000_000:]])], ["seq"])
    tracemalloc.start()
    n = sum(sum(b.column(1).to_pylist()) for b in task.run([rows]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(text) - 14 and peak < 200 << 20


def test_kmers_in_many_parts(spark, monkeypatch, tmp_path):
    """Places, counts and lists in parts of a few each, as long texts and lists have them, with letters that turn up late."""
    for name, value in {"AT_ONCE": 7, "COUNTED": 20, "PASSED": 3, "LISTED": 5, "TOGETHER": 60}.items():
        monkeypatch.setattr(sq, name, value)
    monkeypatch.setattr(sq, "ship", lambda _: None)
    rng = random.Random(6)
    for alphabet in ("ab", "abcé", "ab😀" + "".join(map(chr, range(300, 500)))):
        texts = ["".join(rng.choice(alphabet[:2]) for _ in range(rng.randint(0, 90))) for _ in range(9)] + ["".join(rng.choice(alphabet) for _ in range(200))]
        rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "seq"])
        for k in (1, 3, 8):
            task = _Task()
            task.sparkSession = None
            monkeypatch.setattr(sq, "_dealt", lambda *_: task)  # noqa: B023
            sq.kmer_counts(task, k)
            got = Counter()
            for b in task.run([rows.select(["seq"])]):
                got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
            want = Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1))
            assert got == want
            for least in (0, 2, 10**6):
                often = {x for x, n in want.items() if n > least}
                task.schema = {"id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "long"))}
                with monkeypatch.context() as m:
                    m.setattr("genoflux.scratch.new_path", lambda *_: str(tmp_path / f"{len(alphabet)}-{k}-{least}"))  # noqa: B023
                    sq.covered_by(SimpleNamespace(sparkSession=spark), spark.createDataFrame([(x,) for x in sorted(often)], "kmer string"), k)
                places = sorted((i, p) for b in task.run([rows]) for i, a, z in zip(*(c.to_pylist() for c in b.columns)) for p in range(a, z + 1))
                assert places == sorted({(n, i + j + 1) for n, t in enumerate(texts) for i in range(len(t) - k + 1) if t[i : i + k] in often for j in range(k)})
