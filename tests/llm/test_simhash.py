import random
import re

import odd
import xxhash

from genoflux.llm import simhash as m
from genoflux.operators.components import components


def fp(text, k=4):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius):
    up = {i: i for i in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_odd_documents(spark):
    rows = [(d, fp(t)) for d, t, *_ in odd.rows()]
    name = groups({f: f for _, f in rows}, 4)
    least = {}
    for d, f in rows:
        if d is not None:
            least[name[f]] = min(d, least.get(name[f], d))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    r = m.near_duplicates(odd.docs(spark)).collect()
    assert sorted(((x.doc_id, x.fp & (2**64 - 1), x.component_id) for x in r), key=key) == sorted(((d, f, least.get(name[f])) for d, f in rows), key=key)
    assert any(x.doc_id is None and x.component_id is not None for x in r) and any(x.component_id is None for x in r)
    assert m.near_duplicates(odd.none(spark)).count() == 0


def test_rows_without_id_connect_nothing(spark):
    rng = random.Random(8)
    x, y, z = (" ".join(str(rng.randint(0, 9999)) for _ in range(80)) for _ in range(3))
    d = spark.createDataFrame([(5, x), (None, x), (9, y), (None, y), (4, x), (4, z), (None, z)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in m.near_duplicates(d).collect())
    assert got == [(0, 4), (0, 4), (0, 9), (4, 4), (4, 4), (5, 4), (9, 9)]


def test_balls_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(m, "AT_ONCE", 5000)  # many slices of a bucket
    rng = random.Random(3)
    fps = {}
    for c in range(12):
        base = rng.getrandbits(64)
        for _ in range(8):
            f = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                f ^= 1 << b
            fps.setdefault(f, len(fps))
    signed = lambda f: f - 2**64 if f >> 63 else f
    d = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for radius in (2, 4):
        want = groups({signed(f): f for f in fps}, radius)
        least = {}
        for f, c in want.items():
            least[c] = min(f, least.get(c, f))
        got = {signed(f): signed(f) for f in fps}
        got.update({r.node: r.component for r in components(m.near_links(d, radius)).collect()})
        assert got == {f: least[c] for f, c in want.items()}


def test_values_are_made_once(monkeypatch):
    import numpy as np

    f = np.array([random.Random(5).getrandbits(64) for _ in range(40)], np.uint64)
    for at_once in (m.AT_ONCE, 300):
        monkeypatch.setattr(m, "AT_ONCE", at_once)
        made = [(v, w) for p in range(4) for vs, ws in m._values(f, 2, p, 2) for v, w in zip(vs.tolist(), ws.tolist())]
        assert len(made) == len(set(made)) == 40 * 2081 and all((v ^ int(f[w])).bit_count() <= 2 for v, w in made)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
