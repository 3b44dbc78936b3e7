import re
from collections import Counter, defaultdict

import odd
import pytest

from genoflux.llm import line_dedup as ld
from genoflux.llm import quality_rules as qr

WORD = r"[^\x20\x09-\x0D]+"


def norm(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" \t\n\x0b\x0c\r")


def counts(rows, copies_once=False):
    """Pages with each line of a host, and of the host: by doc_id and text, or by text."""
    pages, total = defaultdict(set), defaultdict(set)
    for d, t, _, host, _ in rows:
        if host is not None and t is not None:
            page = t if copies_once else (d, t)
            total[host].add(page)
            for x in {norm(x) for x in t.split("\n")} - {""}:
                pages[host, x].add(page)
    return pages, total


@pytest.mark.parametrize("copies_once", [False, True])
def test_drop_boilerplate(spark, copies_once):
    rows = odd.rows() + [(900 + i, "copied line\nand its tail", "en", "src9", 1) for i in range(4)] + [(910 + i, f"own {i}", "en", "src9", 1) for i in range(30)]
    pages, total = counts(rows, copies_once)
    want = []
    for d, t, _, host, _ in rows:
        gone = [len(pages.get((host, norm(x)), ())) >= 3 and len(pages[host, norm(x)]) > 0.1 * len(total[host]) for x in (t or "").split("\n")] if host is not None and t is not None else [False] * len((t or "").split("\n"))
        kept = None if t is None else "\n".join(x for x, g in zip(t.split("\n"), gone) if not g)
        want.append((d, kept, 0 if t is None else len(gone), sum(gone)))
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    got = ld.drop_boilerplate(odd.docs(spark, rows), 0.1, 3, copies_once)
    assert "n_lines" in got.columns and set(odd.docs(spark).columns) <= {*got.columns}
    res = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()]
    assert sorted(res, key=key) == sorted(want, key=key)
    assert any(w[3] for w in want) and [w[3] for w in want if w[0] == 900] == [0 if copies_once else 2]
    assert ld.drop_boilerplate(odd.none(spark)).count() == 0


def test_banner_of_a_small_host(spark):
    rows = [(i, f"Banner here\nown {i}", "en", "small", 1) for i in range(9)] + [(20, "alone", "en", "one", 1)]
    got = {(r.doc_id, r.text) for r in ld.drop_boilerplate(odd.docs(spark, rows)).collect()}
    assert got == {(i, f"own {i}") for i in range(9)} | {(20, "alone")}


def test_shuffled_and_broadcast_agree(spark, monkeypatch):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    a = sorted((tuple(r) for r in ld.drop_boilerplate(odd.docs(spark), 0.1, 3).select("doc_id", "text", "n_dropped").collect()), key=key)
    monkeypatch.setattr(ld, "BROADCAST_ROWS", -1)
    assert sorted((tuple(r) for r in ld.drop_boilerplate(odd.docs(spark), 0.1, 3).select("doc_id", "text", "n_dropped").collect()), key=key) == a


def base(t):
    w = re.findall(WORD, t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    cover = {p for i, x in enumerate(tri) if n[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark, monkeypatch):
    rows = odd.rows() + [(800, "a b c\na b c\n\n a b c\n" + "x y z " * 20, "en", "src0", 1), (801, "p q r s p q r s t", "en", "src0", 1)]
    rows += [(810 + i, " ".join(f"b{k}" for k in range(60)) + f"\nown{i}", "en", "src0", 1) for i in range(6)]
    pages, total = counts([(d, t or "", a, h, b) for d, t, a, h, b in rows])
    for limit, share, floor in ((4, 1.0, 1), (500, 0.2, 1), (500, 0.0, 7)):
        want = []
        for d, t, _, host, _ in rows:
            b = base(t or "")
            most = max(floor, min(limit, share * len(total.get(host, ()))))
            lost = sum(len(norm(x).split(" ")) for x in (t or "").split("\n") if norm(x) and len(pages.get((host, norm(x)), ())) > most)
            failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
            want.append((d is None, d or 0, *b, b[0] - lost, failed, not failed and b[0] - lost >= 0.8 * b[0]))
        for packed in (qr.PACKED_WORDS, 0):
            monkeypatch.setattr(qr, "PACKED_WORDS", packed)
            r = qr.judge(odd.docs(spark, rows), limit, 0.8, share, floor).collect()
            assert sorted((x.doc_id is None, x.doc_id or 0, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.n_left_words, x.base_failed, x.kept) for x in r) == sorted(want)
        monkeypatch.undo()
        assert limit > 4 or any(not w[-1] and not w[-2] for w in want) and any(w[-1] for w in want)
    assert qr.judge(odd.none(spark)).count() == 0


def test_windows_of_one_hash_are_compared_by_words(spark):
    # a hash of nothing: all windows fall on one number and only their words tell them apart
    real = qr.covered("w")._jc.toString()
    rows = [(i, " ".join(t)) for i, t in enumerate([list("abcabc"), list("abcdefgh"), list("xyzxyzxyz"), ["a"] * 9, list("abcdabceabcf"), list("ab")])]
    sql = []
    keep, qr.F.expr = qr.F.expr, lambda x: sql.append(x)
    try:
        qr.covered("w")
    finally:
        qr.F.expr = keep
    blind = sql[0].replace("xxhash64(w[i], w[i + 1], w[i + 2])", "0L")
    assert real and blind != sql[0]
    d = spark.createDataFrame(rows, "i int, t string").selectExpr("i", "t", "split(t, ' ') as w").selectExpr("i", "t", f"{blind} as blind", f"{sql[0]} as n")
    for r in d.collect():
        assert r.blind == r.n == base(r.t)[4]


def test_native_plans(spark):
    for d in (qr.judge(odd.docs(spark)), ld.drop_boilerplate(odd.docs(spark))):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_rules_at_their_own_limit(spark):
    line = " ".join(f"b{k}" for k in range(60))
    hosts = {"a": (6, 100, True), "b": (5, 100, False), "c": (13, 600, True), "d": (12, 600, False)}  # more than 5, or 2 %
    rows, i = [], 0
    for h, (with_line, pages, _) in hosts.items():
        for k in range(pages):
            rows.append((i, f"{line}\nown{i}" if k < with_line else " ".join(f"o{i}x{j}" for j in range(61)), "en", h, 1))
            i += 1
    rows += [(100_000 + k, f"{line}\nlast", "en", "copies", 1) for k in range(600)]  # copies are documents
    name = {r[0]: r[3] for r in rows if line in r[1]}
    for r in qr.judge(odd.docs(spark, rows)).collect():
        h = name.get(r.doc_id)
        lost = 61 if h == "copies" else 60 if h and hosts[h][2] else 0
        assert (r.n_words, r.n_left_words, r.base_failed, r.kept) == (61, 61 - lost, False, not lost)


@pytest.mark.parametrize("end", ["\u2028", "\u2029", "\x85", "\r"])
def test_other_line_separators_are_characters(spark, end):
    rows = [(i, f"head{end} line is here\n" + f"own words {i} " * 20, "en", "host", 1) for i in range(10)]
    rows += [(10 + i, f"head{end}line is here\n" + f"own words {i} " * 20, "en", "host", 1) for i in range(10)]
    rows += [(20 + i, f"else {i}", "en", "host", 1) for i in range(240)]
    left = {r.doc_id: r.n_words - r.n_left_words for r in qr.judge(odd.docs(spark, rows), limit=12, share=1.0).collect()}
    gone = {r.doc_id: r.n_dropped for r in ld.drop_boilerplate(odd.docs(spark, rows), 0.05, 12).collect()}
    same = end == "\r"  # a blank like others
    assert all(left[i] == (0 if not same else 4) and gone[i] == int(same) for i in range(20))
