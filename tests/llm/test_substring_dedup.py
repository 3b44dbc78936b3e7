import random
import re

import odd
import xxhash

from genoflux.llm import bytekit
from genoflux.llm import substring_dedup as m


def signed(h):
    return h - 2**64 if h >> 63 else h


def brute(rows, window):
    seen, out = {}, []
    h = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    for d, _, t in sorted((-(2**63) if d is None else d, h(t or ""), t or "") for d, t, *_ in rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        mark = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[p : p + window]), (d, t, p)) != (d, t, p):
                mark[p : p + window] = [True] * window
        out.append((d, len(w), sum(mark), " ".join(x for x, y in zip(w, mark) if not y)))
    return sorted(out)


def got(df):
    return sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


def test_odd_documents(spark):
    assert got(m.drop_repeats(odd.docs(spark))) == brute(odd.rows(), 20)
    assert m.drop_repeats(odd.none(spark)).count() == 0


def test_rows_without_or_with_shared_ids(spark):
    own = [" ".join(f"{k}w{i}" for i in range(40)) for k in "abcdefg"]
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None, f"{passage} x {passage} {own[0]}"), (None, own[1]), (5, f"{own[2]} {own[2]}"), (5, own[3]), (5, own[3]), (None, f"{own[4]} {passage}"), (None, own[4]), (7, f"{own[5]} {passage}"), (7, f"{passage} {own[6]}")]
    want = brute(rows, 20)
    assert got(m.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == want
    kept = {t for *_, t in want}
    assert own[1] in kept and own[3] in kept and own[2] in kept


def test_words_that_cancel_out_in_polynomials(spark):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(19))
    turn = " ".join("xy"[bin(i).count("1") % 2] for i in range(20))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, turn), (4, turn.translate(str.maketrans("xy", "yx"))), (5, f"{a} {tail}")]
    assert got(m.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 20)
    assert [r[2] for r in brute(rows, 20)] == [0, 0, 0, 0, 20]


def test_batches_and_buckets(spark, monkeypatch):
    for k, v in (("LEAST", 50), ("ENTRIES", 1), ("MANY", 10), ("BUCKET", 500), ("LARGE", 1000)):
        monkeypatch.setattr(m, k, v)
    assert got(m.drop_repeats(odd.docs(spark))) == brute(odd.rows(), 20)


def test_spans(spark):
    rows = odd.rows()
    text = {(d, t or ""): re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t, *_ in rows}
    n = 0
    for r in m.drop_repeats(odd.docs(spark), carry=["doc_id", "text"]).collect():
        w = text[r.doc_id, r.text or ""]
        gone = {p for s in r.spans for p in range(s.start, s.start + s.length)}
        assert len(gone) == r.n_removed and " ".join(x for p, x in enumerate(w) if p not in gone) == r.kept
        ends = [s.start + s.length for s in r.spans]
        assert all(s.length >= 20 for s in r.spans) and all(a < s.start for a, s in zip(ends, r.spans[1:]))
        n += len(r.spans)
    assert n > 3


def test_carried_columns(spark):
    r = m.drop_repeats(odd.docs(spark), carry=["doc_id", "places", "text", "_text"])
    assert r.columns == ["doc_id", "places", "text", "_text", "n_words", "n_removed", "spans", "kept"]
    assert sorted((x.doc_id or 0, x.text or "", x.places) for x in r.collect()) == sorted((d or 0, t or "", "places"[:1]) for d, t, *_ in odd.rows())


def test_random_repeats(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET", 1000)
    rng = random.Random(9)
    pieces = [" ".join(rng.choice("abc") for _ in range(rng.randint(3, 30))) for _ in range(12)]
    rows = [(i, " \n".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))) for i in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(m.drop_repeats(d)) == brute(rows, 20)


def test_words_and_hashes():
    import numpy as np

    texts = ["a b", "", "  x\ty ", "a b x y", "é é z"]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0] + [len(r) for r in raw])
    w = bytekit.Words(np.frombuffer(b"".join(raw), np.uint8), off)
    assert w.count.tolist() == [2, 0, 2, 4, 2] and w.pos.tolist() == [0, 1, 0, 1, 0, 1, 2, 3, 0, 1]
    h = w.hashes()
    assert h[:4].tolist() == h[4:8].tolist() and len(set(h[:4].tolist())) == 4
    at, g = w.grams(h, 2)
    assert len(at) == 6 and g[0] == g[2]
    a = np.array([1, 2**40, 5], "<u8")
    assert bytekit.from_planes(bytekit.planes(a), 3, "<u8").tolist() == a.tolist()
