from genoflux.operators import cluster as cl
from genoflux.operators import depth as de
from genoflux.operators import reads as rd
from genoflux.plans import pipeline
import pytest
from pyspark.sql import functions as F

MAPS = "read_id long, orientation string, ref_name string, ref_pos long"


def test_weights_and_coverage(spark):
    m = spark.createDataFrame([(0, "+", "a", 5), (0, "+", "b", 5), (1, "-", "a", 5), (2, "+", "a", 6)], MAPS)
    assert {(r.ref_name, r.ref_pos): r.cov for r in rd.coverage(m).collect()} == {("a", 5): 1.5, ("b", 5): 0.5, ("a", 6): 1.0}
    assert rd.coverage(m).agg(F.sum("cov")).first()[0] == 3.0  # mass: reads on kept references


def test_pair_distance_and_types(spark):
    m = []
    for t, (a, b) in enumerate((("+", "-"), ("-", "+"), ("+", "+"), ("-", "-"))):
        m += [(2 * t, a, "c", 1000), (2 * t + 1, b, "c", 1200)]
    got = {r.template: (r.type, r.dist) for r in rd.mate_pairs(spark.createDataFrame(m, MAPS), 36).collect()}
    assert got == {0: (0, 236), 2: (1, 308), 4: (2, 272), 6: (3, 272)}
    assert {r.read_id for r in rd.discordant_pairs(spark.createDataFrame(m, MAPS), 36, 200, 240, 300).collect()} == {4, 6}


def test_insert_sizes(spark):
    m = [(0, "+", "c", 100), (1, "-", "c", 264), (2, "+", "c", 100), (3, "-", "c", 268), (4, "+", "c", 1), (5, "-", "c", 9), (5, "-", "c", 10)]
    r = rd.insert_sizes(spark.createDataFrame(m, MAPS), 36, 0, 1000).first()
    assert (r["mean"], r["sd"], r["n"]) == (202.0, round(8**0.5, 6), 2)


def test_leader_clusters_and_summary(spark):
    schema = "chr string, type int, dist long, left_pos long, right_pos long, template long"
    rows = [(936, 1000, 1900, 2), (946, 1010, 1920, 4), (946, 1010, 1920, 6), (946, 1020, 1930, 4), (1500, 1030, 2494, 8), (936, 2000, 2900, 10)]
    d = spark.createDataFrame([("c", 0, *r) for r in rows], schema)
    r = cl.cluster_summary(cl.leader_clusters(d, 200, 20), 200).collect()
    assert [tuple(x)[:8] for x in r] == [("c", 1020, 1900, 0, 2, 20, 30, 943.5)]
    rows = [(2000, 1000, 2928, 2), (1990, 1050, 2890, 4), (2030, 1060, 2950, 6)]
    d = spark.createDataFrame([("c", 2, *r) for r in rows], schema)
    r = cl.cluster_summary(cl.leader_clusters(d, 200, 20), 200).collect()
    assert [tuple(x)[1:8] for x in r] == [(1060, 2950, 2, 3, 60, 60, 2006.666667)]


def test_spikes_join_over_slices(spark):
    d = spark.createDataFrame([("c", p, 20.0 if 3 <= p <= 12 else 5.0) for p in range(1, 21)], "chr string, pos long, cov double")
    for width in (4, 1 << 20):
        assert [tuple(r) for r in de.spikes(d, 0, 15, width).collect()] == [("c", 3, 12, "high")]
    assert [tuple(r) for r in de.pad_spikes(de.spikes(d, 0, 15), length=13).collect()] == [("c", 1, 13)]


def test_letter_runs_and_gc(spark):
    s = spark.createDataFrame([(1, "nnACgtNNacgNN"), (2, ""), (3, None)], "id long, seq string")
    assert sorted(tuple(r) for r in de.letter_runs(s).collect()) == [(1, 1, 2), (1, 7, 8), (1, 12, 13)]
    from pyspark.sql import Row

    d = spark.createDataFrame([Row(g=200, a=300), Row(g=500, a=0), Row(g=0, a=0)])
    assert [r[0] for r in d.select(de.gc_bin(F.col("g"), F.col("a"))).collect()] == [20, 49, None]


def test_lambda_fallback(spark):
    lam = spark.createDataFrame([(10, 0.5), (40, 0.7), (20, 0.0)], "bin long, lam double")
    got = {r.bin: r.lam for r in de.fill_lambda(lam).collect()}
    assert (got[0], got[10], got[20], got[25], got[26], got[45]) == (0.5, 0.5, 0.7, 0.7, 0.5, 0.7)


def test_stages(spark):
    m = [(i, "+-"[i % 2], "c", 100 + 300 * (i % 2) + 5 * i) for i in range(40)]
    maps = spark.createDataFrame(m, MAPS)
    breaks = spark.createDataFrame([("c", 1, 5)], "chr string, start long, end long")
    out = pipeline.stage1(maps, breaks, 36, 50, 5, 2)
    assert out["masks"].count() >= 1 and out["links"].count() >= 0
    raw = spark.createDataFrame([("c", 10, 2000, 2.5), ("c", 1, 9, 1.0)], "chr string, start long, end long, flow_diff double")
    depth = out["coverage"].withColumn("lam", F.lit(1.0))
    assert [tuple(r)[:4] for r in pipeline.stage2(raw, breaks, depth).collect()] == [("c", 10, 2000, "gain")]


def test_dense_rank(spark):
    d = spark.createDataFrame([(x,) for x in (5, 5, 100, -3, 7, 10**9)], "k long")
    for slices in (1, 3, 10_000):
        assert {r.k: r.n for r in rd.dense_rank(d, "k", "n", slices).collect()} == {-3: 1, 5: 2, 7: 3, 100: 4, 10**9: 5}


def test_leaders_of_a_deep_island():
    import random
    import time

    from genoflux.operators.cluster import leaders

    def plain(rows, kind, reach, tolerance):
        lead, out = [], []
        for i, (m, s, d) in enumerate(rows):
            lead = [j for j in lead if m - rows[j][0] <= reach]
            near = [j for j in lead if (abs(d - rows[j][2]) if kind in (0, 1) else abs((m - rows[j][0]) - (rows[j][1] - s))) < tolerance]
            out.append(near[0] if near else i)
            if not near:
                lead.append(i)
        return out

    rng = random.Random(3)
    for k in range(300):
        rows = sorted((rng.randint(0, 200), rng.randint(0, 400), rng.randint(-30, 400)) for _ in range(rng.randint(0, 80)))
        tolerance = rng.choice([0, 0.5, 1, 7, 30.5, 1000])
        assert leaders(rows, k % 4, 60, tolerance) == plain(rows, k % 4, 60, tolerance)
    rows = sorted((rng.randint(0, 100_000), rng.randint(0, 100_000), rng.randint(0, 10**7)) for _ in range(1_000_000))
    began = time.time()
    leaders(rows, 0, 200_000, 5)
    assert time.time() - began < 20


def test_references_as_long_as_the_parts(spark, tmp_path):
    """Lengths of references come from the tables, and a position beyond them is still an error."""
    from genoflux.plans import catalogue

    line = "l_orderkey long, l_suppkey long, l_partkey long, l_linestatus string"
    spark.createDataFrame([(1, 7, 1_200_000, "O")], line).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(1_200_000, 1_200_001).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    query = catalogue.queries()["coverage_within_lengths"]
    assert [tuple(r) for r in query(spark, str(tmp_path)).collect()] == [("chr2", 1_200_001, 1.0)]
    spark.createDataFrame([(2, 7, 1_200_001, "O")], line).write.mode("append").parquet(str(tmp_path / "lineitem.parquet"))
    with pytest.raises(Exception, match="beyond"):
        query(spark, str(tmp_path)).collect()
