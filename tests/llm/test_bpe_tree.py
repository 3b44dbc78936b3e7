import random
from pathlib import Path

import odd
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from genoflux.llm import bpe_tree as m
from genoflux.llm.tokenizers import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("leaf,window", [(1, 1), (2, 1), (5, 2), (8, 4), (16, 8)])
def test_tree_equals_whole(leaf, window):
    e, rng = byte_bpe(PATH), random.Random(leaf)
    pools = ["ab 'sll", "  \n\ta", "'re've x'll", "ab1 2é中😀́ \x85\xa0", "!?'s  ", "a", "  ", "hello world the and of ing  12'\n"]
    for _ in range(800):
        pool = rng.choice(pools)
        x = "".join(rng.choice(pool) for _ in range(rng.randint(0, 120)))
        assert m.TreeEncoder(e, leaf, window).encode(x).tolist() == e.encode_ordinary(x)


def test_documents(spark):
    e = byte_bpe(PATH)
    want = sorted((d is None, d or 0, e.encode_ordinary(t or ""), (t or "").encode()) for d, t, *_ in odd.rows())
    for leaf in (50, m.LEAF):
        got = m.encode_documents(odd.docs(spark), PATH, leaf).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids), bytes(r.decoded)) for r in got) == want
    assert m.encode_documents(odd.none(spark), PATH).count() == 0


def test_most_documents_are_joined():
    path = Path("/root/testdata/sf0.001/documents.parquet")
    if not path.exists():
        pytest.skip("no tables here")
    texts = [t or "" for t in pq.read_table(path, columns=["text"]).column(0).to_pylist()]
    e = byte_bpe(PATH)
    tree, joined = m.TreeEncoder(e), 0
    for t in texts:
        before = tree.joins
        assert tree.encode(t).tolist() == e.encode_ordinary(t)
        joined += tree.joins > before
    assert joined >= 0.6 * len(texts) and joined == sum(len(t) > m.LEAF for t in texts)
