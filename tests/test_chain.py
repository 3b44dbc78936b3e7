import random

import pytest
from compare import database, same
from pyspark.sql import functions as F

from genoflux.operators import depth as de
from genoflux.operators import flow as fl
from genoflux.plans import catalogue, chain

DATA = "/root/testdata/sf0.001"


def made(spark):
    """Contigs of 6,000 letters: x lacks its middle on one copy, y has it twice more, z has a stretch at two places, once turned round."""
    rng = random.Random(3)
    seqs = {c: "".join(rng.choice("acgt") for _ in range(6000)) for c in "xyz"}
    rows = []
    for c in "xyz":
        for p in range(1, 6001):
            inside = 2000 <= p < 4000
            for _ in range(rng.random() < 0.2 * (0.5 if inside and c == "x" else 2 if inside and c == "y" else 1)):
                rows.append((len(rows), c, p, "+"))
    maps = spark.createDataFrame(rows, "read_id long, ref_name string, ref_pos long, orientation string")
    breaks = spark.createDataFrame([("x", 5000, 5100), ("w", 1, 9)], "chr string, start long, end long")
    links = spark.createDataFrame([("x", 2000, 4000, 0), ("y", 2000, 4000, 1), ("z", 100, 9000, 0), ("z", 3000, 3600, 2)], "chr string, from long, to long, type int")
    pairs = spark.createDataFrame([(0, "z", 1000, 1300, "+"), (0, "z", 4000, 4300, "-"), (1, "z", 1200, 1500, "+"), (1, "z", 2200, 2500, "+")], "edge_id long, contig string, start long, end long, strand string")
    return maps, breaks, spark.createDataFrame(list(seqs.items()), "id string, seq string"), links, pairs


def test_run_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    given, o = made(spark), chain.Options(high=50, least=200)

    def fails(*_):
        raise RuntimeError("no solver")

    with monkeypatch.context() as m:
        m.setattr(fl, "solve", fails)
        with pytest.raises(RuntimeError, match="no solver"):
            chain.run_chain(spark, *given, options=o, folder=f"file://{tmp_path}/run")
    calls, s = chain.run_chain(spark, *given, options=o, folder=f"file://{tmp_path}/run")
    assert s.made == ["solution", "copies", "raw_calls", "calls"]
    rows = {(r.chr, r.start, r.end): r for r in calls.collect()}
    assert rows["x", 2000, 3999].call == "loss" and rows["y", 2000, 3999].call == "gain" and rows["x", 2000, 3999].doc_ratio < 0.7 < 1.4 < rows["y", 2000, 3999].doc_ratio
    solved = s.tables["solution"]
    assert fl.violations(solved).count() == 0 and fl.imbalance(solved).where("net <> 0").count() == 0
    path = s.tables["graph"]
    # every contig is covered once, in order; both places of a repeat have its pieces
    for c, parts in {r["contig"]: r["x"] for r in path.groupBy("contig").agg(F.sort_array(F.collect_list(F.struct("pos", "end", "edge_id", "strand"))).alias("x")).collect()}.items():
        assert [p.pos for p in parts] == [1] + [p.end + 1 for p in parts[:-1]] and parts[-1].end == 6000
        if c == "z":
            edges = {(p.pos, p.end): (p.edge_id, p.strand) for p in parts}
            assert edges[1000, 1199][0] == edges[4101, 4300][0] and edges[1301, 1500][0] == edges[2301, 2500][0] and edges[1200, 1300][0] == edges[2200, 2300][0] == edges[4000, 4100][0]
    again, s = chain.run_chain(spark, *given, options=o, folder=f"file://{tmp_path}/run")
    assert s.made == [] and again.count() == calls.count()


def test_full_calls_equal_sql(spark):
    a, b = same(catalogue.queries()["full_calls"](spark, DATA), database(DATA), catalogue.oracle_sql()["full_calls"])
    assert a == b and {x[0] for x in a} == {"gain", "loss"}


def test_letter_runs(spark):
    rng = random.Random(1)
    texts = ["", "n", "nnnn", "a", "an", "na", "NnaN"] + ["".join(rng.choice("nNac é") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    want = sorted((i, m.start() + 1, m.end()) for i, t in enumerate(texts) for m in __import__("re").finditer("[nN]+", t))
    d = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    assert sorted(map(tuple, de.letter_runs(d).collect())) == want
    cut = spark.createDataFrame([(i, k + 1, t[k : k + 7]) for i, t in enumerate(texts) for k in range(0, len(t), 7)], "id long, start long, seq string")
    assert sorted(map(tuple, de.letter_runs(cut).collect())) == want
