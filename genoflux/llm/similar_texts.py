"""Texts whose sets of word shingles overlap by a given similarity, by SimHash balls in several tables.

One fingerprint of 64 bits tells texts of similarity 0.8 apart: they differ in some ten bits. So a text gets a signature of
some hundred bits, cut into as many fingerprints as it takes for two texts of that similarity to be close in one of them
with 95 % chance. In each table all values within half the radius of a fingerprint are made and equal values meet, as in
`simhash`. Few texts at a value are all tried with one another, many are sorted by other bits of their signatures, in several ways, and
tried with their neighbours and with the first two. Of the pairs that agree in 64 other bits a bucket passes on the nearest of each text and a
spanning forest, nearest first, so that a large group of near copies makes some four links for each member. These are
compared by their whole signatures, and those that stay by the shingles themselves.

Once these links have made groups, the buckets are gone through again, with the group of each text. Where a bucket has passed on less than all pairs it ties the groups
of its members together, by a row for each group at most and none inside a group; texts of groups tied together are compared in full, by their shingles, block by block.
"""

from __future__ import annotations

from math import acos, ceil, comb, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from genoflux.operators.components import components

from .bytekit import U64, binary_parts, from_planes, mix, planes, release
from .cluster import materialise, ship
from .simhash import PER_BUCKET, SEED, _colliding, _flips, _forest, _values

#: Chance of missing a pair of just the similarity asked for; standard errors that signatures may be off.
MISSED, ERRORS = 0.05, 2.5
#: Makers of a value that are all tried with one another; beyond it orders by other bits, and neighbours in each that are tried. Pairs of each
#: fingerprint that a bucket passes on beside its forest.
FEW, TURNS, NEXT, NEAREST = 16, 4, 4, 3
#: Overlap of texts that agree so well in 64 bits that they are hardly less alike.
CLEAR = 0.95
#: Shingles of a block of texts that are compared with one another, and with those of another block, in one task.
GRAMS = 1 << 19
_STEP = 0x9E3779B97F4A7C15


def apart(similarity: float) -> float:
    """Share of bits in which texts of this overlap (of sets of equal size) differ."""
    return acos(2 * similarity / (1 + similarity)) / pi


def tables_for(n: int, similarity: float) -> tuple[int, int, int]:
    """(bits, half, tables) for n texts: bits grow with log n, so that chance neighbours in a table stay few."""
    own, p = ceil(log2(n + 2)), apart(similarity)
    bits, half = (max(16, own + 10), 1) if own <= 22 else (min(64, own + 16), 2)
    close = sum(comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(2 * half + 1))
    return bits, half, ceil(log(MISSED) / log(1 - close))


def shingles(text: bytes, words: int, digest) -> np.ndarray:
    """Hashes of the different shingles of a text, A-Z in lower case; a text without words has one, of nothing."""
    w = text.lower().split()
    line = b" ".join(w)
    if len(w) <= words:
        return np.array([digest(line, SEED)], np.uint64)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    end = np.cumsum(size) - 1
    at = end - size + 1
    return np.unique(np.array([digest(line[a:z], SEED) for a, z in zip(at[: len(w) - words + 1].tolist(), end[words - 1 :].tolist())], np.uint64))


def signature(h: np.ndarray, longs: int) -> np.ndarray:
    """Bits set in over half of the hashes, of each of several hashes made of each."""
    out = np.zeros(longs, np.uint64)
    for k in range(longs):
        votes = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 16):
            x = mix(h[i : i + (1 << 16)] + U64(_STEP * (k + 1) % 2**64))
            votes += np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(votes * 2 > len(h)).view(">u8")[0]
    return out


def _texts(b, of):
    buf, off = binary_parts(b.column(b.schema.get_field_index("text")))
    raw, off = buf.tobytes(), off.tolist()
    return [of(raw[i:j]) for i, j in zip(off[:-1], off[1:])]


def _lists(x: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(a) for a in x], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*x, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)))


def _signed(words: int, longs: int, keep: list[str]):
    def run(batches):
        import xxhash

        for b in batches:
            sig = _texts(b, lambda t: signature(shingles(t, words, xxhash.xxh64_intdigest), longs))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), _lists(sig)], [*keep, "sig"])
        release()

    return run


def _sets(words: int, keep: list[str]):
    def run(batches):
        import xxhash

        for b in batches:
            grams = _texts(b, lambda t: shingles(t, words, xxhash.xxh64_intdigest))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), _lists(grams)], [*keep, "grams"])
        release()

    return run


def _cut(sig: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Fingerprints of each table (columns) from signatures."""
    each = np.unpackbits(sig.astype(">u8").view(np.uint8).reshape(len(sig), -1), axis=1)
    power = U64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
    return np.stack([(each[:, t * bits : (t + 1) * bits] * power).sum(axis=1, dtype=np.uint64) for t in range(tables)], axis=1)


_CELLS = "cell long, n int, body binary"


def _sent(bits: int, half: int, tables: int, key_bits: int, longs: int):
    """Each fingerprint, with 64 other bits of its signature and the numbers (node and others) beside it, once for each bucket of its table that some of its
    values fall in, as columns of a batch and bucket."""
    masks = np.concatenate(_flips(key_bits, half)).astype(np.int64)

    def send(sig, *numbers):
        fp = _cut(sig, bits, tables)
        rows = [[], [], []]
        for t in range(tables):
            key = (fp[:, t] >> U64(bits - key_bits)).astype(np.int64)
            cell = (key[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(cell, kind="stable")
            who = order // len(masks)
            rest = sig[:, (t * bits // 64 + 2) % longs]
            for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(cell[order])) + 1):
                k = who[part]
                body = [planes(x[k].astype("<u8")) for x in (fp[:, t], rest)] + [planes(x[k].astype("<i8")) for x in numbers]
                for r, x in zip(rows, (t << key_bits | int(cell[order[part[0]]]), len(k), b"".join(body))):
                    r.append(x)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], ["cell", "n", "body"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append((b.column(0).flatten().to_numpy().view(np.uint64).reshape(-1, longs), *(c.to_numpy() for c in b.columns[1:])))
                n += b.num_rows
            if n >= 1 << 15:
                yield send(*(np.concatenate(x) for x in zip(*held)))
                held, n = [], 0
        if held:
            yield send(*(np.concatenate(x) for x in zip(*held)))
        release()

    return run


def _neighbours(v: np.ndarray, w: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of makers to try: all those of a value that has few; of a value that has many each with the first two and with those next to it
    when they are sorted by the other bits, from several bits on: a near copy agrees in the leading ones in one of these orders or another."""
    first = np.r_[True, v[1:] != v[:-1]]
    at = np.flatnonzero(first)
    size = np.diff(np.r_[at, len(v)])
    group = np.cumsum(first) - 1
    many = (size > FEW)[group]
    pairs = []

    def step(group: np.ndarray, w: np.ndarray, most: int) -> None:
        for d in range(1, most + 1):
            same = group[d:] == group[:-d]
            if not same.any():
                break
            pairs.append((w[:-d][same], w[d:][same]))

    step(group[~many], w[~many], FEW)
    if many.any():
        g, m = group[many], w[many]
        for lead in (at, at + 1):
            pairs.append((np.repeat(w[lead[size > FEW]], size[size > FEW]), m))
        for turn in range(0, 64, 64 // TURNS):
            bits = rest[m] if not turn else (rest[m] << U64(turn)) | (rest[m] >> U64(64 - turn))
            order = np.lexsort((bits, g))
            step(g[order], m[order], NEXT)
    none = np.zeros(0, w.dtype)
    return np.concatenate([none, *(a for a, _ in pairs)]), np.concatenate([none, *(b for _, b in pairs)])


def _near(a: np.ndarray, b: np.ndarray, rest: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs as first * n + second whose other bits agree well enough."""
    p = apart(similarity)
    near = (a != b) & (np.bitwise_count(rest[a] ^ rest[b]) <= 64 * (p + 3 * sqrt(p * (1 - p) / 64)))
    return np.unique(np.minimum(a, b)[near] * len(rest) + np.maximum(a, b)[near])


def _tried(found: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Of pairs (first * n + second) a forest, from the nearest on, which has a nearest one of each member, and the NEAREST nearest of each member that has none as near
    as CLEAR: what turns out not to be similar later must not stand in for what is."""
    n = len(rest)
    a, b = found // max(1, n), found % max(1, n)
    off = np.bitwise_count(rest[a] ^ rest[b]).astype(np.int64)
    one, other, both = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([off, off])
    order = np.lexsort((other, both, one))
    start = np.searchsorted(one[order], np.arange(n))
    place = np.arange(len(order)) - start[one[order]]
    doubtful = np.ones(n, bool)
    doubtful[one[order[place == 0]]] = both[order[place == 0]] > 64 * apart(CLEAR)
    best = order[(place < NEAREST) & doubtful[one[order]]] % max(1, len(a))
    order = np.lexsort((b, a, off))
    tree = _forest(np.stack([a[order], b[order]], axis=1), n, True)
    code = np.concatenate([found[best], tree[:, 0] * n + tree[:, 1]])
    code = np.unique(code)
    return np.stack([code // max(1, n), code % max(1, n)], axis=1)


def _crowded(v: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Links (first * n + second) from the first maker of a value that has many to each of them: not all pairs of these are tried."""
    at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    size = np.diff(np.r_[at, len(v)])
    many = size > FEW
    lead, m = np.repeat(w[at[many]], size[many]), w[np.repeat(many, size)]
    return np.unique(np.minimum(lead, m) * n + np.maximum(lead, m))


def _tied(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of 0..n-1 the least that each reaches over links a, b."""
    label = np.arange(n)
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _marked(found: np.ndarray, kept: np.ndarray, crowd: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs that go on (kept, two columns) tie members of which some pair doesn't, and links that tie together what else has met at crowded
    values: any pair that doesn't go on has its texts tied by marked pairs and these links. found, crowd: first * n + second."""
    label = _tied(kept[:, 0], kept[:, 1], n)
    x, y = crowd // max(1, n), crowd % max(1, n)
    gone = np.setdiff1d(found, kept[:, 0] * n + kept[:, 1])
    less = np.zeros(n, bool)
    less[label[np.concatenate([x, y, gone // max(1, n)])]] = True
    _, one = np.unique(np.minimum(label[x], label[y]) * n + np.maximum(label[x], label[y]), return_index=True)
    one = one[label[x[one]] != label[y[one]]]
    return less[label[kept[:, 0]]], np.stack([x[one], y[one]], axis=1)


def _bucket(key, table, numbers: int, bits: int, half: int, key_bits: int, similarity: float) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket the numbers of its fingerprints, in the order of the first (node), their other bits, in which leading bits they are off the bucket's, the near ones
    of the pairs tried at its values, and links as `_crowded` has them (both first * n + second)."""
    columns = [[] for _ in range(2 + numbers)]
    for n, cell in zip(table.column("n").to_pylist(), table.column("body")):
        raw = cell.as_buffer()
        for k, c in enumerate(columns):
            c.append(from_planes(raw[8 * n * k : 8 * n * (k + 1)], n, "<u8"))
    columns = [np.concatenate(c).astype(np.uint64) for c in columns]
    order = np.argsort(columns[2].view(np.int64))
    f, rest, *given = (c[order] for c in columns)
    own = int(key[0].as_py()) & ((1 << key_bits) - 1)
    found, crowd = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for v, w, _ in (_colliding(*x) for x in _values(f, key_bits, own, half, bits)):
        if len(v):
            found.append(_near(*_neighbours(v, w, rest), rest, similarity))
            crowd.append(_crowded(v, w, len(rest)))
    return [x.view(np.int64) for x in given], rest, (f >> U64(bits - key_bits)) ^ U64(own), np.unique(np.concatenate(found)), np.unique(np.concatenate(crowd))


def _pairs(*how):
    """Pairs of a bucket that go on. Two fingerprints with the same leading bits, but not those of the bucket, meet in the bucket of their own as well, so that their pair
    goes on from there, or is marked there."""

    def run(key, table):
        (nodes,), rest, off, found, _ = _bucket(key, table, 1, *how)
        kept = _tried(found, rest)
        kept = kept[(off[kept[:, 0]] != off[kept[:, 1]]) | (off[kept[:, 0]] == 0)]
        return pa.table({"a": pa.array(nodes[kept[:, 0]], pa.int64()), "b": pa.array(nodes[kept[:, 1]], pa.int64())})

    return run


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links a, b between numbers as few as tie the same together, each to the least that it reaches: what several buckets say of a number then often agrees."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = _tied(at[: len(a)], at[len(a) :], len(names))
    other = label != np.arange(len(names))
    return names[label[other]], names[other]


def _ties(*how):
    """Links between groups of which a bucket has members that meet and has not passed on all pairs, as few as tie these groups together."""

    def run(key, table):
        (_, group), rest, _, found, crowd = _bucket(key, table, 2, *how)
        kept = _tried(found, rest)
        less, links = _marked(found, kept, crowd, len(rest))
        a, b = group[np.concatenate([kept[less], links])].T
        a, b = _stars(a[a != b], b[a != b])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def text_key() -> list[Column]:
    """128 bits of the text (null as empty)."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(7), text).alias("_h2")]


_ROW = "row struct<none: boolean, id: bigint, _h1: bigint, _h2: bigint>"
_KEYS = ["_k0", "_k1", "_k2", "_k3"]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with what tells rows apart: whether doc_id is null, doc_id, and the text's key."""
    key = [F.col("doc_id").isNull().alias("_k0"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_k1")]
    return docs.select("*", *key, *(c.alias(k) for c, k in zip(text_key(), _KEYS[2:])))


def _row(name: str) -> list[Column]:
    return [F.col(f"{name}.{c}").alias(k) for c, k in zip(("none", "id", "_h1", "_h2"), _KEYS)]


def _gram_sets(texts: DataFrame, nodes: DataFrame, met: DataFrame, words: int, tag: str) -> DataFrame:
    """Rows of met (node, further numbers) with the shingles of their texts."""
    keep = met.columns
    met = materialise(met.join(nodes.select("node", *_row("row")), "node"), f"{tag}-met")
    # each text comes from one row, so that copies don't meet here
    whole = _keyed(texts.select("doc_id", "text")).select(*_KEYS, F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(met, _KEYS).dropDuplicates(_KEYS)
    return materialise(whole.select(*keep, "text").mapInArrow(_sets(words, keep), f"{', '.join(f'{k} long' for k in keep)}, grams array<long>"), f"{tag}-grams")


def _met(nodes: DataFrame, by, similarity: float, bits: int, half: int, tables: int) -> DataFrame:
    """Distinct links (a, b) that `by` (_pairs, _ties) finds in the buckets of nodes (sig, node and other numbers)."""
    n, key_bits = nodes.count(), 4
    while key_bits < bits - 2 and n * sum(comb(key_bits, k) for k in range(half + 1)) > PER_BUCKET << key_bits:
        key_bits += 1
    sent = nodes.mapInArrow(_sent(bits, half, tables, key_bits, -(-bits * tables // 64)), _CELLS)
    return sent.groupBy("cell").applyInArrow(by(bits, half, key_bits, similarity), "a long, b long").distinct()


def similar_links(texts: DataFrame, nodes: DataFrame, words: int, similarity: float, bits: int, half: int, tables: int) -> DataFrame:
    """Links (a, b) between nodes (node, row, sig) whose texts overlap by `similarity` at least; texts has those rows."""
    longs = -(-bits * tables // 64)
    pairs = materialise(_met(nodes.select("sig", "node"), _pairs, similarity, bits, half, tables), "similar-tried")
    p = apart(similarity)
    most = int(64 * longs * (p + ERRORS * sqrt(p * (1 - p) / (64 * longs))))
    sig = nodes.select("node", "sig")
    pairs = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    off = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    pairs = materialise(pairs.where(off <= most).select("a", "b"), "similar-pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    grams = _gram_sets(texts, nodes, ends, words, "similar")
    both = pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.where(shared >= similarity * (F.size("ga") + F.size("gb") - shared)).select("a", "b")


def _all_pairs(similarity: float):
    """Links of groups, as few as join them, of a pair of blocks: each text of the one against those of the other of its cluster, or of its own block."""

    def run(key, table):
        i, j = (k.as_py() for k in key)
        table = table.sort_by([("cluster", "ascending"), ("block", "ascending"), ("component", "ascending")])
        cluster, block, group = (table.column(c).to_numpy() for c in ("cluster", "block", "component"))
        grams = table.column("grams").combine_chunks()
        size = grams.value_lengths().to_numpy()
        _, g, held = np.unique(grams.flatten().to_numpy(), return_inverse=True, return_counts=True)
        twice = held[g] > 1  # what one text has is shared by no pair
        at = np.r_[0, np.cumsum(twice)][np.r_[0, np.cumsum(size, dtype=np.int64)]]
        g = g[twice]
        mark = np.zeros(len(held), np.uint8)
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        links = []
        edges = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1], True])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            second = lo + int(np.searchsorted(block[lo:hi], j)) if i != j else lo
            for x in range(lo, second if i != j else hi):
                y = second if i != j else x + 1
                if not (group[y:hi] != group[x]).any():
                    continue
                own = g[at[x] : at[x + 1]]
                mark[own] = 1
                shared = np.r_[0, np.cumsum(mark[g[at[y] : at[hi]]], dtype=np.int64)]
                mark[own] = 0
                shared = shared[at[y + 1 : hi + 1] - at[y]] - shared[at[y:hi] - at[y]]
                for c in np.unique(group[y:hi][shared >= similarity * (size[x] + size[y:hi] - shared)]).tolist():
                    a, b = find(int(group[x])), find(c)
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        links.append((int(group[x]), c))
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def rest_links(texts: DataFrame, nodes: DataFrame, words: int, similarity: float, bits: int, half: int, tables: int) -> DataFrame | None:
    """Links (a, b) between groups that join all those with similar texts among the groups of nodes (node, row, sig, component) that buckets tie together, as they have
    not passed on all pairs of them; None if no groups are tied.

    Nodes lie in the order of clusters (groups tied together) and groups, cut into blocks of GRAMS shingles. Each pair of blocks that a cluster reaches is
    one call, but for blocks inside one group. That is all pairs across the groups of a cluster: its square in time, two blocks in memory.
    """
    tied = materialise(_met(nodes.select("sig", "node", "component"), _ties, similarity, bits, half, tables), "similar-open")
    if tied.isEmpty():
        return None
    clusters = components(tied).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    grams = _gram_sets(texts, nodes, nodes.join(clusters, "component").select("node", "component", "cluster"), words, "similar-rest")
    order = ["cluster", "component", "node"]
    d = grams.select(*order, F.size("grams").cast("long").alias("n")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    d = materialise(d.withColumn("task", F.shiftright("at", 33)), "similar-rest-order")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = d.groupBy("task").agg(F.sum("n").alias("n")).select("task", before(W.orderBy("task")).alias("start"))  # a row a task
    d = d.withColumn("inside", before(W.partitionBy("task").orderBy("at"))).join(F.broadcast(start), "task")
    d = d.select(*order, F.floor((F.col("start") + F.col("inside")) / GRAMS).alias("block"))
    span = lambda by: d.groupBy(by).agg(F.min("block").alias(f"{by}_first"), F.max("block").alias(f"{by}_last"))
    d = d.join(span("component"), "component").join(span("cluster"), "cluster")
    others = F.filter(F.sequence("cluster_first", "cluster_last"), lambda k: (k <= F.col("component_first")) | (k >= F.col("component_last")))
    d = d.select("node", "block", F.explode(others).alias("other")).join(grams, "node")
    d = d.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cluster", "component", "grams")
    return d.groupBy("i", "j").applyInArrow(_all_pairs(similarity), "a long, b long")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of similar texts of docs: that of smallest doc_id (null after all), then of smallest text hash.

    Two texts are linked if the sets of their shingles of `words` words (A-Z in lower case; a shorter text is one shingle) overlap by
    `similarity` at least (shared over all), and a group is what links reach. Equal texts, and texts without words (null, empty, blank), are
    one group each. Rows that share a doc_id, or have none, are told apart by their texts; columns are passed on. A pair of just that similarity
    meets in some table with 95 % chance, nearer ones more surely. Where very many other texts are almost as near to both as they to each other (texts of
    one template) a bucket doesn't pass on all pairs; such texts are compared all with all afterwards, but for those already in one group. Copies of a text make no pairs.
    """
    spark = docs.sparkSession
    ship(spark)
    bits, half, tables = tables_for(docs.count(), similarity)
    longs = -(-bits * tables // 64)
    rows = _keyed(docs.select("doc_id", "text")).select(F.struct(*(F.col(k).alias(c) for k, c in zip(_KEYS, ("none", "id", "_h1", "_h2")))).alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = materialise(rows.mapInArrow(_signed(words, longs, ["row"]), f"{_ROW}, sig array<long>"), "similar-rows")
    each = rows.groupBy("row._h1", "row._h2").agg(F.min("row").alias("row"), F.first("sig").alias("sig"))
    nodes = materialise(each.select("row", "sig", F.monotonically_increasing_id().alias("node")), "similar-nodes")
    groups = components(materialise(similar_links(docs, nodes, words, similarity, bits, half, tables), "similar-links"))
    known = materialise(nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "similar-groups")
    named = known.select("row", F.col("component").alias("c"))
    rest = rest_links(docs, known, words, similarity, bits, half, tables)
    if rest is not None:
        more = components(materialise(rest, "similar-rest-links"))
        named = named.join(more, named["c"] == more["node"], "left").select("row", F.coalesce("component", "c").alias("c"))
    kept = named.groupBy("c").agg(F.min("row").alias("row")).select(*_row("row"))
    # the join and the choice of one row share their partitioning, so that texts are dealt out once
    return _keyed(docs).join(kept, _KEYS, "left_semi").dropDuplicates(_KEYS).select(*docs.columns)
