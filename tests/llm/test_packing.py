import random
import struct
from collections import defaultdict

import odd
import public_tokenizers
from tokenizers import Tokenizer

from genoflux.llm import packing as m
from genoflux.llm.tokenizers import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library():
    rng = random.Random(1)
    pool = "abcXYZ 'sst'reΣσςİıÅé0123½²٣!?.,<|endoftext|>\n\t\x85\xa0 ǅ中文😀éÀA B\x1c\x00'll"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["don't 's 'S it's''s !'s x'll'd", "", " "] + [t or "" for _, t, *_ in odd.rows()]
    own = word_bpe(PATH).encode(texts)
    assert [x.tolist() for x in own] == [e.ids for e in reference().encode_batch(texts, add_special_tokens=False)]


def test_every_id_once_and_no_padding(spark):
    given = odd.rows()
    t = reference()
    want = sorted(struct.pack(f"<{len(i)}I", *i) for i in ([*t.encode(x or "", add_special_tokens=False).ids, 2] for _, x, *_ in given))
    pieces = m.pack_documents(odd.docs(spark), PATH, room=256, group_docs=20).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        seq[p.sequence_id].append(p)
        by[(p.doc_id, p.doc_tokens)].append(p)
    for ps in seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256 and (at == 256 or at & (at - 1) == 0)
    whole = []
    for ps in by.values():  # repeated rows share a name: take their pieces in turn
        rest = sorted(ps, key=lambda p: p.start)
        while rest:
            at, got = 0, b""
            while at < ps[0].doc_tokens:
                k = next(i for i, p in enumerate(rest) if p.start == at)
                p = rest.pop(k)
                got += p.ids
                at += p.length
            whole.append(got)
    assert sum(map(len, whole)) == sum(map(len, want))
    assert sorted(map(len, whole)) == sorted(map(len, want))
    assert m.pack_documents(odd.none(spark), PATH).count() == 0


def test_pack_group():
    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.randint(1, 300) for _ in range(rng.randint(1, 40))]
        out = m.pack_group(lengths, 64)
        assert sorted(i for d, s, n, *_ in out for i in [(d, k) for k in range(s, s + n)]) == [(d, k) for d, n in enumerate(lengths) for k in range(n)]
        fill = defaultdict(int)
        for _, _, n, q, at in out:
            assert at == fill[q]
            fill[q] += n
        assert all(f <= 64 and f & (f - 1) == 0 for f in fill.values())


def test_tournament_is_first_fit():
    rng = random.Random(5)
    t, room = m.Tournament(30, 100), [100] * 30
    for _ in range(30):
        n = rng.randint(1, 100)
        want = next(i for i, r in enumerate(room) if r >= n)
        room[want] -= n
        assert t.put(n) == want


def test_very_many_equal_rows_are_many_groups(spark):
    d = spark.createDataFrame([(None, "one and the same")] * 3000 + [(i, f"text {i}") for i in range(1000)], "doc_id long, text string").repartition(4)
    got = m.pack_documents(d, PATH, group_docs=100).collect()
    rows = {}
    for r in got:
        rows.setdefault(r.sequence_id >> 32, []).append(r)
    assert sum(r.start == 0 for r in got) == 4000 and len(rows) > 30 and max(len(x) for x in rows.values()) < 250
