import math

import numpy as np
import pytest

from genoflux.llm import cross_polytope as m

SCHEMA = "vec_id long, embedding array<float>, label int, q string, v string, ids string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "q", "v", "i") for i, v in rows], SCHEMA).repartition(3)


def exact(rows, top):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    return {i: sorted(((-float((q * v).sum()), j) for j, v in ok if j != i and len(v) == len(q)))[:top] for i, q in ok if i % 5 == 0}


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 32))
    x = centres[rng.integers(0, 8, 600)] + rng.normal(size=(600, 32)) * 0.8
    x *= rng.uniform(0.3, 3, (600, 1))  # lengths differ
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = exact(rows, 10)
    got = {}
    for r in m.search(table(spark, rows), "vec_id % 5 = 0", 10).collect():
        got.setdefault(r.query_id, []).append(r)
    hit = 0
    for q, w in want.items():
        rs = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, len(rs) + 1)) and q not in {r.vec_id for r in rs}
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        known = dict((j, s) for s, j in exact(rows, 600)[q]) if q == 0 else {}
        assert all(abs(-known.get(r.vec_id, -r.score) - r.score) < 1e-9 for r in rs)
        hit += len({r.vec_id for r in rs} & {j for _, j in w})
    assert hit >= 0.9 * 10 * len(want)


def test_equal_vectors_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 4)
    rng = np.random.default_rng(2)
    base = [rng.normal(size=8).tolist() for _ in range(20)]
    rows = [(i, base[0] if i % 3 == 0 else base[i % 20]) for i in range(150)]
    got = {}
    for r in m.search(table(spark, rows), "vec_id % 5 = 0", 6, tables=10, probes=32).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q, w in exact(rows, 6).items():
        assert [v for _, v in sorted(got[q])] == [j for _, j in w]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (5, [0.9, 0.1]), (5, [0.9, 0.1]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (10, [inf, 1.0]), (15, [None, 1.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0, 3.0]), (7, [-1.0, 0.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in m.search(table(spark, rows), "vec_id % 5 = 0", 3, tables=4, probes=8).collect())
    assert got == [(0, 1, 5), (0, 2, 7), (5, 1, 0), (5, 2, 7)]
    assert m.search(table(spark, []), "vec_id % 5 = 0").count() == 0


def recall(spark, rows, top):
    want, got = exact(rows, top), {}
    for r in m.search(table(spark, rows), "vec_id % 5 = 0", top).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(got.get(q, ())) == len(w) for q, w in want.items())  # no query gets fewer than there are
    return sum(len(got[q] & {j for _, j in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_with_one_long_vector(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 10
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert recall(spark, rows, 10) >= 0.9  # both classes are hashed
    monkeypatch.setattr(m, "SMALL", 4096)
    assert recall(spark, rows, 10) == 1  # all searched exactly
    monkeypatch.setattr(m, "SMALL", 100)  # the long one is searched exactly, the others by hash
    assert recall(spark, rows, 10) >= 0.9


@pytest.mark.parametrize("n", [1, 2, 21, 30, 45])
@pytest.mark.parametrize("small", [0, 4096])
def test_few_rows(spark, monkeypatch, n, small):
    monkeypatch.setattr(m, "SMALL", small)
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(n).normal(size=(n, 64)))]
    got = {}
    for r in m.search(table(spark, rows), "vec_id % 20 = 0").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: len(g) for q, g in got.items()} == {q: min(20, n - 1) for q in range(0, n, 20) if n > 1}
    if small:
        assert {q: [v for _, v in sorted(g)] for q, g in got.items()} == {q: [j for _, j in w] for q, w in exact(rows, 20).items() if q % 20 == 0 and n > 1}


def test_blocks():
    counts = {(64, 0, 0): np.array([5, 0, 3, 25, 1, 9, 2, 2]), (64, 0, -1): np.array([31])}
    b = m.Blocks(counts, {}, 10, None)
    assert b.parts[64, 0, -1].tolist() == [4] and b.parts[64, 0, 0].tolist() == [1, 1, 1, 3, 1, 1, 1, 1]
    assert b.first[64, 0, 0].tolist() == [4, 4, 4, 5, 8, 8, 9, 9] and len(b.of) == 10 and b.of[4:] == [(64, 0, 0)] * 6
    r, block = b.queries((64, 0, -1), np.ones((2, 64)))
    assert r.tolist() == [0] * 4 + [1] * 4 and block.tolist() == [0, 1, 2, 3] * 2


def test_ids_that_vectors_share(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (1, [1.0, 0.1])]
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in m.search(table(spark, rows), "vec_id % 5 = 0", 2).collect())
    assert got == [(0, 1, 1, 1.0), (0, 1, 2, 1.0), (0, 2, 1, 0.1), (0, 2, 2, 0.1)]


def test_queries_with_few_candidates_see_all(spark, monkeypatch):
    monkeypatch.setattr(m, "SMALL", 0)
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(5).normal(size=(60, 64)))]
    got = {}
    for r in m.search(table(spark, rows), "vec_id % 5 = 0", 40, tables=1, probes=1).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [v for _, v in sorted(g)] for q, g in got.items()} == {q: [j for _, j in w] for q, w in exact(rows, 40).items()}


@pytest.mark.parametrize("n", [500, 2000])
def test_recall_of_small_tables_through_the_tables(spark, n):
    assert m.SMALL == 0
    x = np.random.default_rng(n).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, [(i, v.tolist()) for i, v in enumerate(x)], 20) >= 0.9
