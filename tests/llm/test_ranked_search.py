import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import odd
import pytest
from compare import database, same

from genoflux.llm import ranked_search as m

DATA = Path("/root/testdata/sf0.001")
ITEMS = "item_id long, text string, rank int, score string, docs long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def brute(docs, items, top=10):
    each = [(d, Counter(terms(t))) for d, t in docs]
    each = [(d, c) for d, c in each if c]
    n, total = len(each), sum(sum(c.values()) for _, c in each)
    df = Counter(t for _, c in each for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in each:
            norm = 100 - 75 + 75 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * norm)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, k, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def queries(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2) for r in rows], ITEMS)


@pytest.mark.parametrize("size,docs,cluster", [(m.SEGMENT_BYTES, m.SEGMENT_DOCS, m.CLUSTER), (2000, 9, 2), (1 << 20, 20, 4), (1, 1, 1)])
def test_odd_documents(spark, size, docs, cluster):
    rows = odd.rows()
    rng = random.Random(size)
    items = [(k, " ".join(rng.choices((rng.choice(rows)[1] or "none").split() or ["x"], k=rng.randint(1, 25)))) for k in range(40)]
    items += [(100, None), (101, ""), (102, "nowhere"), (None, "the of"), (5, "the the THE alpha"), (5, "the the THE alpha"), (103, "été ß 中文 É"), (104, "#tag, end.")]
    index = m.build_index(odd.docs(spark), size, docs, cluster)
    assert got(m.search(index, queries(spark, items))) == brute([r[:2] for r in rows], items)


def test_blocks_and_first_thresholds(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(m, "FIRST", 4)
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join(rng.choices(words[(k % 10) * 30 : (k % 10) * 30 + 40], k=rng.randint(1, 60)))) for k in range(800)]
    docs += [(k, docs[3][1]) for k in range(2000, 2300)] + [(1, docs[3][1])] * 5  # ties
    items = [(k, " ".join(rng.choices(words, k=12))) for k in range(20)] + [(50, docs[3][1]), (51, docs[7][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(m.search(m.build_index(d, 1 << 20, 32, 8), queries(spark, items))) == brute(docs, items)


def test_empty_tables(spark):
    some = queries(spark, [(1, "a b")])
    assert m.search(m.build_index(odd.none(spark)), some).count() == 0
    assert m.search(m.build_index(odd.docs(spark)), queries(spark, [])).count() == 0
    assert m.search(m.build_index(spark.createDataFrame([(1, None), (2, " .")], "doc_id long, text string")), some).count() == 0


def test_bisection_puts_like_documents_together():
    rng = np.random.default_rng(2)
    n, topics = 256, 8
    topic = rng.permutation(np.arange(n) % topics)
    doc = np.repeat(np.arange(n), 20)
    term = topic[doc] * 50 + rng.integers(0, 50, len(doc))
    key = np.unique(doc * 1000 + term)
    order, starts = m.bisect(key // 1000, key % 1000, n, 32)
    assert sorted(order.tolist()) == list(range(n)) and starts.tolist() == list(range(0, n + 1, 32))
    pure = [np.bincount(topic[order[a:z]]).max() / (z - a) for a, z in zip(starts, starts[1:])]
    assert np.mean(pure) > 0.9
    assert m.bisect(key[:0], key[:0], 0)[0].tolist() == []


def test_clusters_are_passed_over(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(f"t{k % 16}x{rng.randint(0, 60)}" for _ in range(40))) for k in range(1024)]
    rng.shuffle(docs)
    rows = m.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    items = [(k, docs[k][1]) for k in range(3)]
    block = m.Block(items)
    df = Counter()
    for r in rows:
        here, at = m._found(np.frombuffer(r.terms, np.uint64), block.terms)
        for u, x in zip(here.tolist(), np.frombuffer(r.df, np.int32)[at].tolist()):
            df[u] += x
    block.weigh(1024, 1024 * 40, df)
    s = m.Searcher(block, 10, np.zeros(3, np.int64))
    for r in rows:
        s.segment(r.asDict())
    assert s.clusters == 32 and s.visited <= 12
    item, score, doc = s.best.rows
    assert [(items[i][0], d, x) for i, x, d in zip(item.tolist(), score.tolist(), doc.tolist())] == [(i, d, x) for i, _, d, x in sorted(brute(docs, items))]


def test_query_equals_sql(spark):
    if not DATA.is_dir():
        pytest.skip("no tables here")
    a, b = same(m.op13_ranked_search(spark, str(DATA)), database(str(DATA)), m.SQL["op13_ranked_search"])
    assert a == b and len(a) == 400
