import zlib
from collections import defaultdict

import odd

from genoflux.llm import sharding as m


def test_law_groups_slots(spark):
    r = m.shard_documents(odd.docs(spark), 5).collect()
    given = odd.rows()
    assert sorted((x.doc_id is None, x.doc_id or 0, x["size"], x.text_crc32) for x in r) == sorted((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in given)
    slots, shards = defaultdict(list), defaultdict(set)
    for x in r:
        slots[x.shard].append(x.slot)
        shards[(x.text_crc32, x["size"])].add(x.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    assert all(len(s) == 1 for s in shards.values())
    assert m.shard_documents(odd.none(spark), 5).count() == 0


def test_even(spark):
    d = spark.range(4000).selectExpr("id as doc_id", "repeat('x', cast(pmod(hash(id), 300) as int) * 2) || id as text")
    loads = [x["b"] for x in m.shard_documents(d, 7).groupBy("shard").sum("size").withColumnRenamed("sum(size)", "b").collect()]
    assert len(loads) == 7 and max(loads) - min(loads) <= 16


def test_place_levels_like_the_heap():
    classes = [(900, 3, 900.0), (50, 500, 50.0), (7, 4, 7.0)]
    bulk = m.place(classes, 6)
    loads, one = [0.0] * 6, []
    for _, n, each in classes:
        given = [0] * 6
        for _ in range(n):
            i = loads.index(min(loads))
            given[i] += 1
            loads[i] += each
        one.append(given)
    total = [sum((b[1][i] - (b[1][i - 1] if i else 0)) * c[2] for b, c in zip(bulk, classes)) for i in range(6)]
    assert sorted(total) == sorted(loads)
    assert [b[1][-1] for b in bulk] == [3, 500, 4]
