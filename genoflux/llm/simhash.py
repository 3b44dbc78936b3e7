"""SimHash near-duplicates: fingerprints whose balls of half the radius meet.

Two fingerprints differ in at most 2r bits exactly if some 64-bit value differs from both in at most r. So every
fingerprint stands for all values within r = 2 bits (2,081 of them), equal values are brought together, and
fingerprints at one value are linked. The shuffle doesn't carry the values: a bucket holds those with
certain leading bits, a fingerprint is sent once to each bucket that some of its values fall in, and the bucket makes them.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoflux.operators.components import components

from .bytekit import U64, binary_parts, release
from .cluster import materialise, read, ship

#: Fingerprints that a bucket gets, and values that it holds at once.
PER_BUCKET, AT_ONCE = 1 << 15, 1 << 22
SEED = 42


def fingerprint(text: bytes, words: int, digest) -> int:
    """Bits set in over half of the shingles' hashes; no word: zero."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return digest(b" ".join(w), SEED)
    line = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    end = np.cumsum(size) - 1
    at = end - size + 1
    n = len(w) - words + 1
    h = np.array([digest(line[a:z], SEED) for a, z in zip(at[:n].tolist(), end[words - 1 :].tolist())], np.uint64)
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > n).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches):
        import xxhash

        for b in batches:
            buf, off = binary_parts(b.column(1))
            raw, off = buf.tobytes(), off.tolist()
            f = np.fromiter((fingerprint(raw[i:j], words, xxhash.xxh64_intdigest) for i, j in zip(off[:-1], off[1:])), np.uint64, len(off) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["doc_id", "fp"])
        release()

    return run


def _flips(bits: int, most: int) -> list[np.ndarray]:
    """For each number of flips up to `most`, the masks over the lowest `bits` bits."""
    return [np.array([sum(1 << i for i in c) for c in combinations(range(bits), k)] or [], np.uint64) for k in range(most + 1)]


def _forest(links: np.ndarray, n: int, ordered: bool = False) -> np.ndarray:
    """Of links between 0..n-1 as few as keep the same together: the first ones that do."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, (a, b) in enumerate(links.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(i if ordered else (a, b))
    return links[kept].reshape(-1, 2) if ordered else np.array(kept, np.int64).reshape(-1, 2)


def _values(f: np.ndarray, bits: int, prefix: int, half: int, width: int = 64):
    """Of each fingerprint of `width` bits, the values at most `half` bits off that begin with the `bits` bits of prefix, and its number.

    More than AT_ONCE of them come in several runs, split by further leading bits: each value is made once, and equal ones in one run.
    """
    stack = [(bits, prefix, np.arange(len(f)))]
    while stack:
        bits, prefix, who = stack.pop()
        low = width - bits
        own = ((f[who] >> U64(low)) ^ U64(prefix)) if low < 64 else np.zeros(len(who), U64)
        far = np.bitwise_count(own).astype(np.int64)
        near = far <= half
        who, own, far = who[near], own[near], far[near]
        counts = np.cumsum([comb(low, k) for k in range(half + 1)])
        if len(who) > 1 and low and int(counts[half - far].sum()) > AT_ONCE:
            stack += [(bits + 1, prefix << 1 | x, who) for x in (0, 1)]
            continue
        masks, moved = _flips(low, half), f[who] ^ (own << U64(low) if low < 64 else own)
        values, makers = [], []
        for k in range(half + 1):
            m = np.concatenate(masks[: half - k + 1])
            v = moved[far == k, None] ^ m[None, :]
            values.append(v.ravel())
            makers.append(np.broadcast_to(who[far == k, None], v.shape).ravel())
        yield np.concatenate(values), np.concatenate(makers)


def _colliding(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values with more than one maker and their makers, sorted, and where each value begins."""
    s = np.sort(v)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return v[:0], w[:0], np.zeros(0, np.int64)
    at = np.searchsorted(twice, v)
    at[at == len(twice)] = 0
    hit = twice[at] == v
    v, w = v[hit], w[hit]
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    return v, w, np.flatnonzero(np.r_[True, v[1:] != v[:-1]])


def _meet(key_bits: int, half: int):
    def run(key, table):
        f = np.sort(table.column("fp").to_numpy().view(np.uint64))
        links = []
        for v, w, at in (_colliding(*x) for x in _values(f, key_bits, int(key[0].as_py()), half)):
            if len(v):
                lead = np.repeat(w[at], np.diff(np.r_[at, len(v)]))
                pair = np.unique(lead * len(f) + w)
                a, b = pair // len(f), pair % len(f)
                near = (a != b) & (np.bitwise_count(f[a] ^ f[b]) <= 2 * half)
                links.append(_forest(np.stack([a[near], b[near]], axis=1), len(f)))
        kept = _forest(np.concatenate(links), len(f)) if links else np.zeros((0, 2), np.int64)
        f = f.view(np.int64)
        return pa.table({"a": pa.array(f[kept[:, 0]], pa.int64()), "b": pa.array(f[kept[:, 1]], pa.int64())})

    return run


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of every row of docs; A-Z in lower case, words as runs of characters other than 0x20 and 0x09-0x0D."""
    ship(docs.sparkSession)
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))
    return d.mapInArrow(_fingerprints(words), "doc_id long, fp long")


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) that join fingerprints (distinct fp) at most `radius` (even) bits apart, as few as each bucket needs."""
    half = radius // 2
    n, key_bits = fps.count(), 6
    while key_bits < 30 and n * sum(comb(key_bits, k) for k in range(half + 1)) > PER_BUCKET << key_bits:
        key_bits += 1
    masks = np.concatenate(_flips(key_bits, half)).astype(np.int64).tolist()
    key = F.shiftrightunsigned("fp", 64 - key_bits)
    sent = fps.select("fp", F.explode(F.transform(F.lit(masks), lambda m: key.bitwiseXOR(m))).alias("bucket"))
    return sent.groupBy("bucket").applyInArrow(_meet(key_bits, half), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs: fingerprints at most `radius` bits apart are linked, and
    component_id is the smallest doc_id that links reach.

    Null and empty texts have fingerprint zero and are linked like others; texts with fewer words than a shingle are
    one shingle. The nodes are fingerprints, so copies make no pairs, and rows without a doc_id, or that share one, connect nothing but what
    their texts do; a component in which no row has a doc_id has none. Repeated rows are repeated. A task holds one text of any length, with
    some 40 bytes of memory for each of its bytes.
    """
    d = materialise(fingerprints(docs, words), "simhash-rows")
    fps = materialise(d.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    groups = components(materialise(near_links(fps, radius), "simhash-links"), 60)
    node = fps.join(groups, fps["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    node = materialise(node, "simhash-groups")
    name = node.groupBy("component").agg(F.min("least").alias("component_id"))
    named = node.join(name, "component").select(F.col("fp").alias("_fp"), "component_id")
    return d.join(named, d["fp"] == named["_fp"]).select("doc_id", "fp", "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(read(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash_near_dedup": op5_simhash_near_dedup}
SQL: dict[str, str] = {}
