import random

from pyspark.sql import functions as F

from genoflux.operators import graph as gr
from genoflux.operators import intervals as iv


def frame(spark, rows, schema="chr string, start long, end long"):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge(spark):
    d = frame(spark, [("chr1", 1, 5), ("chr1", 5, 8), ("chr1", 9, 10), ("chr1", 20, 25)])
    assert rows(iv.merge(d)) == [("chr1", 1, 8), ("chr1", 9, 10), ("chr1", 20, 25)]
    assert rows(iv.merge(d, 1)) == [("chr1", 1, 10), ("chr1", 20, 25)]
    assert rows(iv.merge(d, width=4)) == rows(iv.merge(d))
    assert rows(iv.merge(iv.merge(d, 1), 1)) == rows(iv.merge(d, 1))
    assert rows(iv.merge(d.where("false"))) == []


def test_merge_over_slices_against_brute_force(spark):
    rng = random.Random(11)
    for gap in (0, 3):
        given = [(rng.choice("ab"), s := rng.randint(0, 400), s + rng.choice([1, 2, 5, 60])) for _ in range(50)]
        want = []
        for c, s, e in sorted(given):
            if want and want[-1][0] == c and s <= want[-1][2] + gap:
                want[-1][2] = max(want[-1][2], e)
            else:
                want.append([c, s, e])
        for width in (5, 16, 1 << 20):
            assert rows(iv.merge(frame(spark, given), gap, width)) == [tuple(x) for x in want]


def test_neighbours_over_slices(spark):
    d = frame(spark, [("c", p, 10 * p) for p in (1, 2, 9, 30, 31)], "contig string, pos long, edge_id long")
    for width in (4, 10, 1 << 20):
        assert rows(gr.free_links(d, width).select("pos", "next_pos", "next_edge")) == [(1, 2, 20), (2, 9, 90), (9, 30, 300), (30, 31, 310)]
        got = rows(iv.with_previous(d, "contig", "pos", "edge_id", "prev", width).select("pos", "prev"))
        assert got == [(1, None), (2, 10), (9, 20), (30, 90), (31, 300)]


def test_complement(spark):
    d = frame(spark, [("c", 0, 1), ("c", 5, 5)])
    assert rows(iv.complement(d, 10)) == [("c", 2, 4), ("c", 6, 9)]


def test_best_overlap_modes(spark):
    q = frame(spark, [(1, "c", 10, 19), (2, "c", 100, 110)], "id long, chr string, start long, end long")
    db = frame(spark, [("c", 5, 12), ("c", 15, 30)])
    got = {m: {r["id"]: tuple(r)[4:] for r in iv.annotate(q, db, m).collect()} for m in iv.MODES}
    assert got["default"] == {1: (0.5,), 2: (0.0,)}
    assert got["full2"] == {1: (0.5, 0.3125, 2), 2: (0, 0, 0)}
    assert got["full3"] == {1: (0.5, 0.3125, 2, 5, 11), 2: (0, 0, 0, None, None)}
    assert got["full4"] == {1: (0.8, 0.3333, 2), 2: (0, 0, 0)}
    assert got["full5"][1] == (0.5, 0.3125, 2, "5\t12\t15\t30")
    assert got["full"][1] == (0.5, 0.3125, 2, 10, "0.3000\t0.3750")


def test_range_joins_against_brute_force(spark):
    rng = random.Random(4)
    made = lambda n: [(rng.choice("ab"), s := rng.randint(0, 90_000), s + rng.randint(0, 40_000), i) for i in range(n)]
    a, b = made(60), made(40)
    schema = "chr string, start long, end long, k long"
    da, db = frame(spark, a, schema), frame(spark, b, schema)
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    for width in (1000, iv.BIN, 1 << 20):
        assert sorted(tuple(r) for r in iv.overlap_join(da, db, width).select("k", "r_k").collect()) == want
    hit = {x for x, _ in want}
    assert {r.k for r in iv.overlap_anti(da, db).collect()} == {x[3] for x in a} - hit
    assert {r.k for r in iv.overlap_semi(da, db).collect()} == hit


def test_screen_and_locate(spark):
    links = frame(spark, [(1, "c", 100, 900, 0), (2, "c", 300, 900, 3), (3, "c", 10, 20, 1)], "id long, chr string, from long, to long, type long")
    breaks = frame(spark, [("c", 195, 205)])
    assert {r.id for r in iv.screen_links(links, breaks, 100).collect()} == {3}
    seg = frame(spark, [("c", 5, 1), ("c", 50_000, 2)], "chr string, start long, id long")
    pts = frame(spark, [("c", 4), ("c", 5), ("c", 49_999), ("c", 50_000), ("c", 10**6)], "chr string, pos long")
    assert iv.locate(pts.unionByName(pts), seg).count() == 2 * pts.count()
    assert rows(iv.locate(pts, seg).select("pos", "seg_id")) == sorted([(4, None), (5, 1), (49_999, 1), (50_000, 2), (10**6, 2)])


def test_fill_gaps_and_ids(spark):
    d = frame(spark, [("c", 5, 8), ("c", 20, 30)])
    got = rows(gr.dense_ids(gr.fill_gaps(d, frame(spark, [("c", 31)], "chr string, length long")), ["chr", "start"], "id").select("id", "start", "end", "kind"))
    assert got == [(0, 1, 4, "gap"), (1, 5, 8, "edge"), (2, 9, 19, "gap"), (3, 20, 30, "edge"), (4, 31, 31, "gap")]


def test_refinement_has_no_part_overlaps(spark):
    rng = random.Random(8)
    for _ in range(40):
        given = []
        for e in range(rng.randint(1, 6)):
            n = rng.randint(3, 30)
            given += [(e, s := rng.randint(0, 120), s + n - 1, rng.choice("+-")) for _ in range(2)]
        got = gr.refine(given)
        spots = sorted({(s, t) for _, s, t, _ in got})
        assert len(spots) == len(got)
        assert all(a[1] < b[0] for a, b in zip(spots, spots[1:]))
        assert {p for _, s, t, _ in got for p in range(s, t + 1)} == {p for _, s, t, _ in given for p in range(s, t + 1)}
        assert len({(e, t - s) for e, s, t, _ in got}) == len({e for e, *_ in got})


def test_cut_and_donor_arcs(spark):
    parts = frame(spark, [("c", 1, 100), ("c", 101, 200)])
    pts = frame(spark, [("c", 50), ("c", 101), ("c", 150)], "chr string, pos long")
    assert rows(gr.cut_at(parts, pts)) == [("c", 1, 49), ("c", 50, 100), ("c", 101, 149), ("c", 150, 200)]
    occ = frame(spark, [("c", 1, 0, "+"), ("c", 101, 1, "-")], "chr string, start long, edge_id long, strand string")
    links = frame(spark, [("c", 1, 101, 0)], "chr string, from long, to long, type long")
    assert rows(gr.donor_arcs(occ, links)) == [(0, 0, 3, 0)]
    assert rows(gr.signed_arcs(gr.donor_arcs(occ, links))) == [(1, -4)]
    assert gr.free_links(occ.select(F.col("chr").alias("contig"), F.col("start").alias("pos"), "edge_id")).count() == 1


def test_overlaps_of_long_and_short_intervals(spark):
    rng = random.Random(8)

    def some(n):
        out = []
        for i in range(n):
            start = rng.randrange(3_000_000)
            out.append((rng.choice("ab"), start, start + rng.choice([0, 5, 900, 70_000, 1_100_000, 2_000_000_000]), i))
        return out

    a, b = some(60), some(80)
    fields = "chr string, start long, end long, id int"
    left, right = spark.createDataFrame(a, fields), spark.createDataFrame(b, fields)
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    for long in (False, True):
        got = iv.overlap_join(left, right, 1 << 14 if long else 1 << 20, long)
        assert sorted((r.id, r.r_id) for r in got.select("id", "r_id").collect()) == want
        assert got.columns == ["chr", "start", "end", "id", "r_chr", "r_start", "r_end", "r_id"]
    whole = spark.createDataFrame([("a", 1, 200_000_000, 0)], fields)
    assert iv._placed(whole, "start", "end", 1 << 14, "_").count() < 70
    short = spark.range(200_000).select(F.lit("a").alias("chr"), (F.col("id") * 900).alias("start"), (F.col("id") * 900 + 50).alias("end"), F.col("id"))
    assert iv.overlap_join(short, whole, long=True).count() == 200_000


def test_ids_of_one_large_first_value(spark):
    """Numbers are made by ranges of the whole order: no task gets all rows of a first value."""
    d = spark.range(20_000).select(F.lit("c").alias("chr"), (F.col("id") * 7919 % 20_000).alias("pos"))
    got = gr.dense_ids(d.repartition(4), ["chr", "pos"], "id")
    assert got.where("id <> pos").count() == 0 and got.count() == 20_000
    assert "windowspecdefinition(chr" not in got._jdf.queryExecution().optimizedPlan().toString()
