import random

import numpy as np
import odd
import public_tokenizers
import pytest

from genoflux.llm import piece_agenda as m

PATH = public_tokenizers.path("piece_bpe_32k.model")
POOLS = [
    "ab 'sll", "  \n\ta", "the and of ing  tion▁", "ab1 2é中😀́ \x85\xa0", "a", " ", "=-", "▁ ", "你好吗的是 ", "\x00\x01 ​﻿�", "<s></s><unk><0x41> ", "ßÀ ÿñ", "привет мир ", "ﬁ①Å ",
    "hello world international unbelievably ",
]


def random_texts(n, seed, most=120):
    rng = random.Random(seed)
    for _ in range(n):
        pool = rng.choice(POOLS)
        yield "".join(rng.choice(pool) for _ in range(rng.randint(0, most)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_agendas_equal_the_library(seed):
    p = m.PieceModel(PATH)
    texts = list(random_texts(1500, seed)) + ["a" * 3000, " " * 3000, "=" * 999, "ab" * 700 + " " + "the" * 300]
    got = p.encode(texts)
    for t, ids in zip(texts, got):
        want = p.library.encode(t)
        assert ids.tolist() == want and p.decode(ids) == p.library.decode(want)
        if t:
            assert np.frombuffer(p.agenda(p.normal(t)), np.int32).tolist() == want  # a heap over the whole text, without cuts


def test_windows_and_forgotten_segments(monkeypatch):
    monkeypatch.setattr(m, "WINDOW", 7)
    monkeypatch.setattr(m, "KEPT", 5)
    monkeypatch.setattr(m, "LONG", 4)
    p = m.PieceModel(PATH)
    for t in random_texts(400, 9):
        assert p.encode([t])[0].tolist() == p.library.encode(t)


def test_decoding_of_any_ids():
    p, rng = m.PieceModel(PATH), random.Random(4)
    for _ in range(2000):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(3, 258), rng.randint(130, 258), 259, 28705, 0, 1, 2]) for _ in range(rng.randint(1, 9))]
        assert p.decode(np.array(ids)) == p.library.decode(ids)


def test_documents(spark):
    p = m.PieceModel(PATH)
    want = sorted((d is None, d or 0, p.library.encode(t or ""), p.library.decode(p.library.encode(t or ""))) for d, t, *_ in odd.rows())
    for check in (False, True):
        got = m.encode_documents(odd.docs(spark), PATH, check).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids), r.decoded) for r in got) == want
    assert m.encode_documents(odd.none(spark), PATH).count() == 0


def test_check_fails_on_a_difference(spark, monkeypatch):
    p = m.piece_model(PATH)
    monkeypatch.setattr(p, "decode", lambda ids: "x")
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some text"])], ["doc_id", "text"])
    with pytest.raises(ValueError, match="differ"):
        list(m._run(PATH, True)([batch]))


def test_segments_are_held_against_the_library():
    p = m.PieceModel(PATH)
    assert p.apart
    p.check = True
    texts = list(random_texts(1500, 11)) + ["a" * 3000, "\n\n x\n", "word " * 50]
    assert [x.tolist() for x in p.encode(texts)] == [p.library.encode(t) for t in texts]
    with pytest.raises(ValueError, match="differ"):
        p.compare({"▁the": np.array([5], np.int32).tobytes()})
