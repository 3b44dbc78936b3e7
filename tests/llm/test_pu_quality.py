import zlib
from pathlib import Path

import numpy as np
import odd
import pytest

from genoflux.llm import pu_quality as m

DATA = Path("/root/testdata/sf0.001")
LABELS = "doc_id long, quality int, toxic int, text string"


def made(rng, junk):
    w = [rng.choice(["the", "of", "and", "river", "stone", "walks", "under"]) + rng.choice(["", "s", "ing", "ed"]) for _ in range(rng.integers(20, 200))]
    return " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w) + "."


def test_learns_on_held_out_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, made(rng, i % 6 == 0), "en", "s", 1, *odd.EXTRA) for i in range(1500)]
    labels = [(i, int(i % 6 != 0), 0, "clash") for i in range(0, 1500, 2)]
    docs = spark.createDataFrame(rows, odd.SCHEMA)
    model = m.learn(docs, spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: r._score for r in m.score_documents(docs.drop("_score"), model, ["doc_id"]).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= m.CUT) == (i % 6 != 0) for i in held]) > 0.97


def test_prior_and_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0, "t"), (2, 0, None, "t"), (3, None, 0, "t"), (None, 1, 0, "t"), (999, 1, 1, "t"), (1, 1, 0, "t")], LABELS)
    model = m.learn(odd.docs(spark), labels)
    r = m.score_documents(odd.docs(spark).drop("_score", "_text"), model, ["doc_id", "text", "x"]).collect()
    assert len(r) == len(odd.rows()) and all(0 <= x._score <= 1 for x in r)
    assert m.learn(odd.docs(spark), labels.where("false")) is None
    assert m.learn(odd.none(spark), labels) is None
    assert {x._score for x in m.score_documents(odd.docs(spark).drop("_score"), None, ["doc_id"]).collect()} == {0.5}
    assert m.score_documents(odd.none(spark).drop("_score"), model, ["doc_id"]).count() == 0


def test_features_of_whole_texts():
    texts = [(t or "").encode() for _, t, *_ in odd.rows()]
    off = np.cumsum([0] + [len(t) for t in texts])
    x = m.features(np.frombuffer(b"".join(texts), np.uint8), off)
    assert x.shape == (len(texts), m.FEATURES) and np.isfinite(x).all()
    for i in (0, 7, len(texts) - 1):
        alone = m.features(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])]))
        assert np.allclose(alone[0], x[i])


def test_risk_is_not_negative_at_the_end():
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (300, m.FEATURES)), np.concatenate([rng.normal(1, 1, (210, m.FEATURES)), rng.normal(-1, 1, (90, m.FEATURES))])
    model = m.fit(p, u, 0.7, steps=300)
    assert model.score(p).mean() > 0.8 and model.score(rng.normal(-1, 1, (200, m.FEATURES))).mean() < 0.3


def test_query(spark):
    if not DATA.is_dir():
        pytest.skip("no tables here")
    r = m.op8_pu_quality(spark, str(DATA)).collect()
    assert len(r) == 200 and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and x.predicted == int(x.score >= 0.3) for x in r)


def test_prior_from_positives_and_unlabelled_rows_alone():
    rng = np.random.default_rng(6)
    for share in (0.5, 0.8):
        raw = [made(rng, rng.random() > share).encode() for _ in range(1500)]
        good = [made(rng, False).encode() for _ in range(700)]
        x, p = (m.features(np.frombuffer(b"".join(r), np.uint8), np.cumsum([0] + [len(t) for t in r])) for r in (raw, good))
        assert abs(m.estimate_prior(p, x) - share) < 0.1


def test_bad_labels_are_not_used(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, made(rng, i % 6 == 0), "en", "s", 1, *odd.EXTRA) for i in range(300)], odd.SCHEMA)
    good = [(i, 1, 0, "clash") for i in range(0, 300, 2) if i % 6]
    a, b = (m.learn(docs, spark.createDataFrame(x, LABELS)) for x in (good, good + [(i, 0, 0, "clash") for i in range(0, 300, 6)]))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_ngrams():
    raw = [b"", b"ab", b"abcd", b"abcabc"]
    x = m.ngrams(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    assert not x[:2].any() and (x[2] > 0).sum() == 2 and (x[3] > 0).sum() == 3 and np.allclose((x[2:] ** 2).sum(axis=1), 1)
    assert ((x[2] > 0) & (x[3] > 0)).sum() >= 1


@pytest.mark.parametrize("most", [100, 1000])
def test_repeated_rows_keep_the_bound(spark, monkeypatch, most):
    """20,000 rows of one good id, and few others."""
    seen = {}
    plain = m.fit
    monkeypatch.setattr(m, "fit", lambda p, u, *a, **k: seen.update(p=len(p), u=len(u)) or plain(p, u, *a, **k))
    hot = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    rng = np.random.default_rng(1)
    rows = [(hot, "the river under stones walks on.", "en", "s", 1, *odd.EXTRA)] * 20_000 + [(hot, made(rng, False), "en", "s", 1, *odd.EXTRA) for _ in range(300)]
    rows += [(1000 + i, made(rng, i % 2 == 0), "en", "s", 1, *odd.EXTRA) for i in range(1500)]
    docs = spark.createDataFrame(rows, odd.SCHEMA).repartition(4)
    m.learn(docs, spark.createDataFrame([(hot, 1, 0, "t")], LABELS), most)
    assert seen["p"] == min(most, 301) and seen["u"] == min(most, 301 + sum(zlib.crc32(str(1000 + i).encode()) % 5 > 0 for i in range(1500)))
