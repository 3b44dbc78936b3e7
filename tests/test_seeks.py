import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from genoflux.functions import alignment as al
from genoflux.sources import bam, bam_index, binary, store, text

REFS = [("chr1", 3_000_000), ("chr2", 500_000), ("none", 100)]


class Counted:
    """A file that counts the bytes read of it."""

    total = 0

    def __init__(self, f):
        self.f = f

    def read(self, n=None):
        out = self.f.read() if n is None else self.f.read(n)
        Counted.total += len(out)
        return out

    def seek(self, at):
        self.f.seek(at)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()


def alignments(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ref = rng.choice([0, 0, 0, 1])
        size = rng.choice([30, 80, 80, 9000, 200_000 if ref == 0 else 300])
        pos = rng.randrange(REFS[ref][1] - size)
        cigar = [("M", 20), ("N", size - 40), ("M", 20)] if size > 60 else [("M", size), ("S", 2)]
        length = sum(k for t, k in cigar if t in "MS")
        rows.append((f"r{i}", ref, pos, 0, 9, 0, cigar, "A" * length, "I" * length, -1, -1, 0, b"NMZ1\0"))
    return sorted(rows, key=lambda r: (r[1], r[2]))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two sorted files with true bins."""
    where = tmp_path_factory.mktemp("bam")
    rows = alignments(30_000, 1)
    rows = [(*r[:5], bin_of(r[2], r[2] + sum(n for t, n in r[6] if t in "MN")), *r[6:]) for r in rows]
    for k, part in enumerate((rows[:20_000], rows[20_000:])):
        (where / f"part-{k}.bam").write_bytes(bam.encode(REFS, part))
    return str(where), rows


def bin_of(a, z):
    for shift, first in reversed(bam_index.LEVELS):
        if a >> shift == z - 1 >> shift:
            return first + (a >> shift)
    return 0


def overlapping(rows, ref, start, end):
    return sorted(r[0] for r in rows if REFS[r[1]][0] == ref and r[2] < end and r[2] + sum(n for t, n in r[6] if t in "MN") > start)


def test_region_reads_only_its_blocks(folder, monkeypatch):
    path, rows = folder
    for p, _ in store.listed(path, ".bam"):
        with store.opened(p) as f, open(p + ".bai", "wb") as out:
            out.write(bam_index.index_of(f))
    plain = store.opened
    monkeypatch.setattr(store, "opened", lambda p: Counted(plain(p)))
    size = sum(n for _, n in store.listed(path, ".bam"))
    rng = random.Random(2)
    for _ in range(40):
        ref = rng.choice(["chr1", "chr1", "chr2", "none"])
        start = rng.randrange(dict(REFS)[ref])
        end = start + rng.choice([1, 500, 20_000, 400_000])
        r = bam_index.RegionReader(path, ref, start, end)
        parts = r.partitions()
        Counted.total = 0
        got = sorted(x for p in parts for b in r.read(p) for x in b.column("name").to_pylist())
        assert got == overlapping(rows, ref, start, end)
        if end - start <= 500 and ref == "chr1" and start > 300_000:
            assert Counted.total < 0.35 * size  # long records pull in the bins above
    # filters become the region
    r = bam_index.RegionReader(path, None, 0, bam_index._ALL)
    kept = list(r.pushFilters([EqualTo(("ref_name",), "chr2"), GreaterThanOrEqual(("position",), 1000), LessThan(("position",), 1400)]))
    assert len(kept) == 3 and (r.ref, r.start, r.end) == ("chr2", 1000, 1400)
    parts = r.partitions()
    Counted.total = 0
    names = [x for p in parts for b in r.read(p) for x in b.column("name").to_pylist()]
    assert {x[0] for x in rows if x[1] == 1 and 1000 <= x[2] < 1400} <= set(names) and Counted.total < 0.3 * size


def test_index_written_by_tasks(spark, folder):
    path, rows = folder
    assert bam_index.write_index(spark, f"file://{path}").count() == 2 and os.path.getsize(f"{path}/part-0.bam.bai") > 100
    d = bam_index.read_indexed(spark, f"file://{path}", "chr1", 1_000_000, 1_050_000)
    assert sorted(r.name for r in d.collect()) == overlapping(rows, "chr1", 1_000_000, 1_050_000)
    every = bam_index.read_indexed(spark, f"file://{path}")
    assert every.count() == len(rows) and every.where("ref_name = 'chr2' and position < 1000").count() == sum(r[1] == 1 and r[2] < 1000 for r in rows)
    assert bam_index.read_indexed(spark, f"file://{path}", "none").count() == 0


def test_unsorted_file_has_no_index(tmp_path):
    rows = alignments(50, 3)
    (tmp_path / "x.bam").write_bytes(bam.encode(REFS, rows[::-1]))
    with store.opened(str(tmp_path / "x.bam")) as f, pytest.raises(ValueError, match="not sorted"):
        bam_index.index_of(f)


def test_files_of_tasks(spark, tmp_path):
    d = spark.range(4000).select(F.concat(F.lit("f"), F.col("id") % 7).alias("name"), F.col("id").alias("part"), F.concat(F.col("id").cast("string"), F.lit(";")).cast("binary").alias("body")).repartition(5)
    binary.save_files(d, f"file://{tmp_path}/whole")
    binary.save_parts(d, f"file://{tmp_path}/parts")
    for k in range(7):
        want = "".join(f"{i};" for i in range(k, 4000, 7))
        assert (tmp_path / f"whole/f{k}").read_text() == want
        assert "".join(p.read_text() for p in sorted((tmp_path / f"parts/f{k}").iterdir())) == want
    assert not [p for p in tmp_path.rglob("_temporary*")]
    bad = d.withColumn("body", F.when(F.col("part") == 3999, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("body")))
    with pytest.raises(Exception, match="broken"):
        binary.save_files(bad, f"file://{tmp_path}/none")
    assert not [p for p in (tmp_path / "none").rglob("*") if p.is_file()] if (tmp_path / "none").exists() else True


def test_record_ranges(spark, tmp_path):
    (tmp_path / "a").mkdir()
    x = np.arange(1, 50_001, dtype="<f8")
    for k, part in enumerate(np.split(x, [20_000, 20_001])):
        part.tofile(tmp_path / f"a/part-{k:05d}")
    path = f"file://{tmp_path}/a"
    assert [(r.pos, r.value) for r in binary.read_range(spark, path, "double", 19_999, 20_003).orderBy("pos").collect()] == [(i, float(i)) for i in range(19_999, 20_004)]
    assert binary.read_records(spark, path, "double").agg(F.sum("value"), F.max("pos")).first()[:] == (x.sum(), 50_000)
    assert [r.pos for r in binary.records_from(spark, path, "double", -2).orderBy("pos").collect()] == [49_999, 50_000]
    r = binary._RecordReader(str(tmp_path / "a"), "double", 1, None)
    list(r.pushFilters([GreaterThanOrEqual(("pos",), 20_001), LessThan(("pos",), 20_003)]))
    assert [(p.at, p.n) for p in r.partitions()] == [(20_000, 1), (20_001, 1)]
    assert binary.read_range(spark, path, "double", 60_000, 70_000).count() == 0


def test_lines_by_offsets(spark, tmp_path):
    rng = random.Random(4)
    lines = [f"key{k // 3} é {rng.random()}" for k in range(3000)]
    (tmp_path / "x.txt").write_text("\n".join(lines) + "\n")
    index = text.key_index(text.line_index(spark, f"file://{tmp_path}/x.txt"))
    keys = spark.createDataFrame([(f"key{k}",) for k in (0, 5, 5, 17, 998, 999, 1000, 5000)], "key string")
    got = sorted((r.key, r.value) for r in text.lines_at(index, keys).collect())
    want = sorted((x.split()[0], x) for x in lines if x.split()[0] in {"key0", "key5", "key17", "key998", "key999"})
    assert got == want


def test_positions_beyond_the_bins(spark, tmp_path):
    """Records at positions over 1 << 29, whose bins don't fit 16 bits."""
    at = [5, (1 << 29) - 3, 1 << 29, 1_196_000_000, (1 << 31) - 100]
    rows = [(f"r{i}", 0, p, 0, 60, bam.bin_of(p, p + 4), [("M", 4)], "ACGT", "IIII", -1, -1, 0, {}) for i, p in enumerate(at)]
    d = spark.createDataFrame(rows, "name string, ref_id int, position long, flag int, mapq int, bin int, cigar array<struct<type string, length int>>, bases string, quals string, mate_ref_id int, mate_position long, insert_size long, tags map<string,string>").coalesce(1)
    folder = str(tmp_path / "far")
    store.write_bodies(bam.bam_blocks(d, [("c", 100)]), folder)
    assert sorted((r.position, r.bin) for r in bam.read_records(spark, folder).collect()) == [(p, bam.bin_of(p, p + 4)) for p in at]
    bam_index.write_index(spark, folder)
    assert sorted(r.position for r in bam_index.read_indexed(spark, folder).collect()) == at
    assert [r.position for r in bam_index.read_indexed(spark, folder, "c", 1_196_000_002, 1_196_000_009).collect()] == [1_196_000_000]


def test_positions_beyond_a_record_s_fields(spark, tmp_path):
    """Positions, mates' positions and insert sizes of more than 32 bits, as 360 copies of a table have them."""
    at = [5, (1 << 31) - 1, 1 << 31, 7_178_400_000, (1 << 33) + 3]
    mate = [-1, 1 << 33, -1, 7, (1 << 31) - 1]
    size = [0, -(1 << 35), 4, -9, 1 << 31]
    tags = [{}, {"ZP": "a"}, {"NM": "1"}, {}, {"RG": "g", "NM": "2"}]
    rows = [(f"r{i}", 0, p, 0, 60, 0, [("M", 4)], "ACGT", "IIII", 0, m, z, t) for i, (p, m, z, t) in enumerate(zip(at, mate, size, tags))]
    d = spark.createDataFrame(rows, "name string, ref_id int, position long, flag int, mapq int, bin int, cigar array<struct<type string, length int>>, bases string, quals string, mate_ref_id int, mate_position long, insert_size long, tags map<string,string>").coalesce(1)
    d = d.withColumn("bin", al.region_bin(F.col("position"), F.col("position") + 4).cast("int"))
    folder = str(tmp_path / "far")
    store.write_bodies(bam.bam_blocks(d, [("c", 100)]), folder)
    want = list(zip(at, mate, size, tags, [bam.bin_of(p, p + 4) for p in at]))
    shown = lambda d: sorted(((r.position, r.mate_position, r.insert_size, r.tags, r.bin) for r in d.collect()), key=lambda r: r[0])
    assert shown(bam.read_records(spark, folder)) == want
    bam_index.write_index(spark, folder)
    whole = bam_index.read_indexed(spark, folder)
    assert shown(whole) == want
    assert [r.position for r in bam_index.read_indexed(spark, folder, "c", (1 << 31) + 3, 7_178_400_001).collect()] == [1 << 31, 7_178_400_000]
    assert [r.position for r in whole.where("ref_name = 'c' and position >= 3000000000 and position < 8000000000").collect()] == [7_178_400_000]
