import random
from collections import Counter

import numpy as np
import odd
import public_tokenizers
import pytest

from genoflux.llm import token_counts as m
from genoflux.llm.tokenizers import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(text, rule):
    e = byte_bpe(PATH)
    raw = text.encode()
    owner = []
    for line, part in enumerate(raw.split(b"\n")):
        owner += [line] * (len(part) + 1)
    n, over, at = Counter(), Counter(), 0
    for i in e.encode_ordinary(text):
        size = len(e.decode_single_token_bytes(i))
        mine = owner[at : at + size]
        to = {"first": mine[0], "last": mine[-1], "most": max(sorted(set(mine)), key=mine.count)}[rule]
        n[to] += 1
        over[to] += len(set(mine)) > 1
        at += size
    lines = raw.count(b"\n") + (not raw.endswith(b"\n") or not raw)
    return [(k, n[k], over[k]) for k in range(lines)]


@pytest.mark.parametrize("rule", m.RULES)
def test_documents(spark, rule):
    crossing = [(900, "a\n\n\nb\n\n  c d\n"), (901, "\n"), (902, "x\n\n"), (903, "é\n\n\n\n中")]
    given = [(d, t) for d, t, *_ in odd.rows() if d is not None] + crossing
    d = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.section, r.n_tokens, r.n_crossing) for r in m.section_tokens(d, PATH, rule).collect())
    assert got == sorted((i, *x) for i, t in given for x in brute(t or "", rule))
    assert any(r[3] for r in got)


def test_odd_tables(spark):
    assert m.section_tokens(odd.docs(spark), PATH).count() > len(odd.rows())
    assert m.section_tokens(odd.none(spark), PATH).count() == 0
    with pytest.raises(ValueError):
        m.section_tokens(odd.docs(spark), PATH, "both")


def test_attribute_by_hand():
    n, over = m.attribute(np.array([0, 3]), np.array([3, 9]), np.array([0, 4, 8]), 10, "most")
    assert n.tolist() == [1, 1, 0] and over.tolist() == [0, 1, 0]


@pytest.mark.parametrize("rule", m.RULES)
def test_given_fields(spark, rule):
    e, rng = byte_bpe(PATH), random.Random(3)
    rows = []
    for d, t, *_ in odd.rows():
        if d is not None:
            n = len(t or "")
            spans = [(a, a + rng.randint(0, 40)) for a in (rng.randint(-2, n + 3) for _ in range(rng.randint(0, 5)))]
            rows.append((d, t, spans))
    rows += [(901, "no fields at all", None), (902, "a null field é中", [(0, 4), None, (9, None)]), (903, None, [(0, 3)])]
    got = {}
    d = spark.createDataFrame(rows, "doc_id long, text string, fields array<struct<start:int,end:int>>").repartition(3)
    for r in m.section_tokens(d, PATH, rule, "fields").collect():
        got.setdefault((r.doc_id, rows_of(r)), 0)
        got[r.doc_id, rows_of(r)] += 1
    want = {}
    for d_id, t, spans in rows:
        t, owner = t or "", []
        spans = [s if s and None not in s else (0, 0) for s in spans or []]
        held, own, at = [m.OUTSIDE] * len(t), {}, 0
        for k in sorted(range(len(spans)), key=lambda i: (spans[i][0], i)):
            a = min(max(spans[k][0], at), len(t))
            z = max(a, min(spans[k][1], len(t)))
            own[k] = (a, z)
            held[a:z] = [k] * (z - a)
            at = max(at, z) if a < z else at
        for c, k in zip(t, held):
            owner += [k] * len(c.encode())
        n, over, at = Counter(), Counter(), 0
        for i in e.encode_ordinary(t):
            mine = owner[at : (at := at + len(e.decode_single_token_bytes(i)))]
            runs = [k for j, k in enumerate(mine) if j == 0 or mine[j - 1] != k]
            sizes = Counter()
            to = {"first": mine[0], "last": mine[-1]}.get(rule)
            if to is None:
                sizes, j = [], 0
                for k in runs:
                    size = 0
                    while j < len(mine) and mine[j] == k:
                        size, j = size + 1, j + 1
                    sizes.append(size)
                to = runs[sizes.index(max(sizes))]
            n[to] += 1
            over[to] += len(runs) > 1
        for k in ([m.OUTSIDE] if n[m.OUTSIDE] else []) + sorted(own):
            a, z = own.get(k, (0, len(t)))
            key = (d_id, (k, a, z, len(t[:a].encode()), len(t[:z].encode()), n[k], over[k]))
            want[key] = want.get(key, 0) + 1
    assert got == want


def rows_of(r):
    return r.section, r.start_char, r.end_char, r.start_byte, r.end_byte, r.n_tokens, r.n_crossing
