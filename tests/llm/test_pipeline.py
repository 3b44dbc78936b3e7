"""Every stage of the pipeline, on all that the stage before kept, against a plain version of it."""

import struct
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from test_lines import counts, norm
from test_packing import reference
from test_similar_texts import one_of_each
from test_substring_dedup import brute

import corpus_pipeline as p
from genoflux.llm import pu_quality as pu
from genoflux.llm.cluster import read

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no tables here")


def rows(df):
    return sorted(tuple(r) for r in df.select(*p.COLUMNS).collect())


def test_stages(spark):
    sf = str(DATA)
    docs = read(spark, sf, "documents").select(*p.COLUMNS)
    # copies of a text, a page line of a host, a repeated passage and a repeated row on top of the given ones
    more = [(10_000 + i, f"Our common page line\nOnly here: {' '.join(f'w{i}x{k}' for k in range(60))}", "en", "src3", 1) for i in range(15)]
    more += [(10_100 + i, more[0][1], "en", "src4", 1) for i in range(3)] + [more[2]]
    more += [(10_200 + i, f"{' '.join(f'v{i}y{k}' for k in range(50))} {' '.join(f'pass{k}' for k in range(30))} end{i}", "en", "src5", 1) for i in range(4)]
    d = p.materialise(docs.unionByName(spark.createDataFrame(more, docs.schema)), "test")

    model = pu.learn(d, read(spark, sf, "labels"))
    one = lambda t: pu.features(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))
    want = [r for r in rows(d) if model.score(one(r[1]))[0] >= pu.CUT]
    d = p.materialise(p.STAGES[0][1](spark, d, sf), "test")
    assert rows(d) == want and len(want) > 150

    pages, total = counts(want, True)
    often = lambda h, x: len(pages.get((h, norm(x)), ())) >= 2 and len(pages[h, norm(x)]) > 0.05 * len(total[h])
    after = []
    for i, t, a, h, n in want:
        kept = [x for x in t.split("\n") if not often(h, x)]
        if len(kept) < len(t.split("\n")):
            t = "\n".join(kept)
            n = len(t)
            if not t.strip(" "):
                continue
        after.append((i, t, a, h, n))
    d = p.materialise(p.STAGES[1][1](spark, d, sf), "test")
    assert rows(d) == sorted(after) and after != want

    want = one_of_each(after)
    d = p.materialise(p.STAGES[2][1](spark, d, sf), "test")
    assert rows(d) == want and len(want) < len(after)

    kept = {i: (gone, text) for i, _, gone, text in brute(want, 20)}
    after = sorted((i, kept[i][1] if kept[i][0] else t, a, h, len(kept[i][1]) if kept[i][0] else n) for i, t, a, h, n in want if not kept[i][0] or kept[i][1])
    d = p.materialise(p.STAGES[3][1](spark, d, sf), "test")
    assert rows(d) == after and after != want

    t = reference()
    ids = {r[0]: [*t.encode(r[1], add_special_tokens=False).ids, 2] for r in after}
    pieces, seen = defaultdict(list), defaultdict(int)
    for x in p.STAGES[4][1](spark, d, sf).collect():
        pieces[x.doc_id].append(x)
        seen[x.sequence_id] += x.length
        part = ids[x.doc_id][x.start : x.start + x.length]
        assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == x.ids_crc32 and x.doc_tokens == len(ids[x.doc_id])
    assert {i: sum(x.length for x in v) for i, v in pieces.items()} == {i: len(v) for i, v in ids.items()}
    assert max(seen.values()) <= 4096


def test_rows_without_own_ids_are_documents(spark):
    rng = np.random.default_rng(3)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 5000, 120))
    x, y, passage = text(), text(), " ".join(f"p{k}" for k in range(30))
    own = [text() for _ in range(6)]
    # 5 and 9 have a copy each among the rows without id; the others of those and of id 7 are clean
    given = [(5, x), (9, y), (None, x), (None, y), *((None, t) for t in own[:3]), (7, own[3]), (7, own[4]), (7, own[4]), (None, own[5] + " " + passage), (None, text() + " " + passage)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = p.materialise(p.near_copies(spark, d, ""), "test")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted({*given} - {(None, x), (None, y)}, key=key)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == want
    out = sorted(((r.doc_id, r.text) for r in p.passages(spark, kept, "").collect()), key=key)
    cut = [i for i, t in out if (i, t) not in want]
    assert len(out) == len(want) and cut == [None] and sum(passage in t for _, t in out) == 1
