import random
import re

import odd
import pytest
import xxhash

from genoflux.llm import similar_texts as m


def grams(text, k=5):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def signed(h):
    return h - 2**64 if h >> 63 else h


def order(r):
    """doc_id, null last, then the hash of the text."""
    return r[0] is None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))


def one_of_each(rows, similarity=0.8):
    """The first row of each group of texts, by comparing all with all."""
    texts = sorted({r[1] or "" for r in rows})
    sets, up = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n >= similarity * (len(sets[i]) + len(sets[j]) - n):
                up[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for r in sorted(rows, key=order):
        best.setdefault(find(texts.index(r[1] or "")), r)
    return sorted(best.values(), key=order)


def made(seed=4):
    """Texts with some words of a chain of texts changed: overlaps from 0.6 to 1."""
    rng = random.Random(seed)
    word = lambda: rng.choice("aeiou") + str(rng.randint(0, 3000))
    rows = []
    for _ in range(30):
        w = [word() for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, 6)):
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.1 else " \n".join(w), "en", "s", 1))
            for _ in range(max(1, int(len(w) * rng.uniform(0, 0.025)))):
                w[rng.randrange(len(w))] = word()
    return rows


def test_groups_of_near_copies(spark):
    rows = made()
    want = one_of_each(rows)
    got = {r.doc_id for r in m.one_of_each(odd.docs(spark, rows)).select("doc_id").collect()}
    lost = got - {r[0] for r in want}
    assert {r[0] for r in want} <= got and len(lost) <= 0.1 * (len(rows) - len(want)) and len(want) < 0.8 * len(rows)


def test_odd_documents(spark):
    rows = odd.rows() + [(None, odd.rows()[4][1], "en", None, 1), (5, "another text with the id of another row", "en", "s", 1), (5, odd.rows()[9][1], "en", "s", 1)]
    out = m.one_of_each(odd.docs(spark, rows))
    assert out.columns == odd.docs(spark).columns
    want = one_of_each(rows)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=order) == [(r[0], r[1]) for r in want] and len(want) < len(rows)
    assert m.one_of_each(odd.none(spark)).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w), "en", "s", 1))
    assert [r.doc_id for r in m.one_of_each(odd.docs(spark, rows)).collect()] == [0]


@pytest.mark.parametrize("n", [1, 1000, 200_000, 10**7, 10**10])
def test_tables(n):
    bits, half, tables = m.tables_for(n, 0.8)
    assert 16 <= bits <= 64 and tables <= 40 and n * sum(m.comb(bits, k) for k in range(2 * half + 1)) / 2**bits < 12


@pytest.mark.parametrize("family", [100, 600, 1500])
def test_pairs_within_families_of_one_template(spark, family):
    """Texts of 400 words that overlap by some 0.77 across, so that no links are there, but for pairs that overlap by 0.93."""
    rng = random.Random(family)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    rows = []
    for i in range(family // 2):
        w = list(base)
        for p in rng.sample(range(0, 395, 5), 6):
            w[p] = f"own{i}x{p}"
        rows.append((len(rows), " ".join(w), "en", "s", 1))
        for p in rng.sample(range(2, 395, 5), 3):
            w[p] = f"twin{i}x{p}"
        rows.append((len(rows), " ".join(w), "en", "s", 1))
    a, b, c = grams(rows[0][1]), grams(rows[1][1]), grams(rows[2][1])
    assert len(a & b) / len(a | b) > 0.9 and len(a & c) / len(a | c) < 0.79
    got = {r.doc_id for r in m.one_of_each(odd.docs(spark, rows)).select("doc_id").collect()}
    pairs = sum(not ({i, i + 1} <= got) for i in range(0, len(rows), 2))
    print(family, pairs / (len(rows) // 2))
    assert pairs >= 0.95 * (len(rows) // 2)


@pytest.mark.parametrize("grams", [m.GRAMS, 20_000])
def test_crowded_family_as_by_brute_force(spark, monkeypatch, grams):
    """Pairs that overlap by some 0.81 among 300 texts of one template that overlap by some 0.77, beside a large group of near copies of it: one block of texts, and many."""
    monkeypatch.setattr(m, "GRAMS", grams)
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    rows = []
    for i in range(150):
        w = list(base)
        for p in rng.sample(range(0, 395, 5), 6):
            w[p] = f"own{i}x{p}"
        rows.append((len(rows), " ".join(w), "en", "s", 1))
        for p in rng.sample(range(2, 395, 5), 8):
            w[p] = f"twin{i}x{p}"
        rows.append((len(rows), " ".join(w), "en", "s", 1))
    for i in range(100):
        w = base[:200] + [f"other{k}" for k in range(200)]
        w[rng.randrange(400)] = f"copy{i}"
        rows.append((len(rows), " ".join(w), "en", "s", 1))
    want = [r[0] for r in one_of_each(rows)]
    assert sorted(r.doc_id for r in m.one_of_each(odd.docs(spark, rows)).select("doc_id").collect()) == want and 50 < len(want) < 300


def test_pairs_that_do_not_go_on_stay_tied():
    """Whatever pairs a bucket leaves out, their texts are tied by what it marks."""
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(2, 60))
        rest = rng.integers(0, 2**63, n).astype(np.uint64)
        found = np.unique([x * n + y for x, y in np.sort(rng.integers(0, n, (int(rng.integers(0, 90)), 2)), axis=1).tolist() if x < y]).astype(np.int64)
        v = np.sort(rng.integers(0, 1 + n // 10, 2 * n).astype(np.uint64))
        w = np.concatenate([np.sort(rng.integers(0, n, int((v == x).sum()))) for x in np.unique(v)])
        kept = m._tried(found, rest)
        less, links = m._marked(found, kept, m._crowded(v, w, n), n)
        tied = np.concatenate([kept[less], links])
        label = m._tied(tied[:, 0], tied[:, 1], n)
        gone = np.setdiff1d(found, kept[:, 0] * n + kept[:, 1])
        assert (label[gone // n] == label[gone % n]).all()
        for x in np.unique(v):
            makers = w[v == x]
            assert len(makers) <= m.FEW or len(np.unique(label[makers])) == 1


def rows_of_joins(spark, since: int, kind: str) -> tuple[int, int]:
    """(rows that joins of this kind made in the executions from a number on, number of executions so far)."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for k in range(runs.size()):
        run = runs.apply(k).executionId()
        if run < since:
            continue
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for i in range(nodes.size()):
            node = nodes.apply(i)
            if "Join" not in node.name() or kind not in node.desc():
                continue
            for j in range(node.metrics().size()):
                metric = node.metrics().apply(j)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    made += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return made, max([since, *(runs.apply(k).executionId() + 1 for k in range(runs.size()))])


def test_ties_of_groups_do_not_grow_with_their_members(spark):
    """A large group of near copies meets in many buckets of each table: its texts are named by their groups once, not once for each pair of a bucket."""
    rng = random.Random(11)
    base, rows = [f"w{rng.randint(0, 10**6)}" for _ in range(150)], []
    for i in range(700):
        w = list(base)
        for _ in range(rng.randint(1, 3) if i < 600 else rng.randint(4, 8)):
            w[rng.randrange(150)] = f"x{i}y{rng.randint(0, 9)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    _, since = rows_of_joins(spark, 0, "LeftOuter")
    got = sorted(r.doc_id for r in m.one_of_each(odd.docs(spark, rows)).collect())
    made, _ = rows_of_joins(spark, since, "LeftOuter")
    assert got == [r[0] for r in one_of_each(rows)] and 0 < made <= 3 * len(rows)


def test_ties_of_a_bucket_are_those_of_its_marks():
    """As few links of groups as tie what the marked pairs and links of a bucket tie, each to the least group."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(0, 40, (2, int(rng.integers(0, 60))))
        least, other = m._stars(a, b)
        full, few = m._tied(a, b, 40), m._tied(least, other, 40)
        assert (full == few).all() and len(other) == len(set(other.tolist())) == int((full != np.arange(40)).sum()) and (full[other] == least).all()
