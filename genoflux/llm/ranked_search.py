"""Ranked search by terms: segments of documents reordered by recursive bisection, visited cluster by cluster as far as bounds ask for."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytekit import Words, binary_parts, release
from .cluster import materialise, read, ship

#: A segment of the index has so many bytes of text or documents at most (a longer text is one by itself); a cluster so many documents. Plan only.
SEGMENT_BYTES, SEGMENT_DOCS, CLUSTER = 4 << 20, 4096, 32
#: Rounds of swaps at each level of the bisection.
SWAPS = 6
#: Items of a block of the query set, which is sent to all tasks: so many, and bytes of their texts (a longer item is a block by itself).
BLOCK_ITEMS, BLOCK_BYTES = 256, 1 << 17
#: First thresholds come from about so many segments; every threshold that some documents reach is a valid one for all. Plan only.
FIRST = 32
TOP = 10
#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII.
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_NO_ID = np.iinfo(np.int64).max


def terms(texts: pa.Array) -> Words:
    """The terms of each text, A-Z lower-cased."""
    buf, off = binary_parts(texts)
    return Words(_LOWER[buf], off, NO_TERM)


def bisect(doc: np.ndarray, term: np.ndarray, n: int, least: int = CLUSTER, swaps: int = SWAPS) -> tuple[np.ndarray, np.ndarray]:
    """An order of documents 0 to n-1 that puts like ones together, and where clusters of at most `least` of them begin in it.

    doc, term: the postings. Each set of documents is halved; then documents are swapped between the halves, those first that most
    shorten the lists' gaps (sum of degree * log2(size / (degree + 1)) of each term on either side), until none gain; halves
    are halved again. All sets of a level are handled at once.
    """
    order, starts = np.arange(n), np.array([0, n] if n else [0])
    common = np.bincount(term, minlength=1)[term] > 1 if len(term) else np.zeros(0, bool)
    doc, term = doc[common], term[common].astype(np.int64)
    while n and np.diff(starts).max() > least:
        size = np.diff(starts)
        half = np.where(size > least, (size + 1) // 2, size)
        other = size - half
        node = np.repeat(np.arange(len(size)), size)
        place = np.arange(n) - np.repeat(starts[:-1], size)
        side = np.empty(n, bool)
        side[order] = place >= half[node]
        at_node = np.empty(n, np.int64)
        at_node[order] = node
        _, cell = np.unique(at_node[doc] * (int(term.max(initial=0)) + 1) + term, return_inverse=True)
        cells = int(cell.max(initial=-1)) + 1
        cell_node = np.zeros(cells, np.int64)
        cell_node[cell] = at_node[doc]
        left, right = half[cell_node].astype(float), np.maximum(other[cell_node], 1).astype(float)
        total = np.bincount(cell, minlength=cells)
        pairs = np.arange(int(other.sum())) - np.repeat(np.cumsum(other) - other, other)
        base = np.repeat(starts[:-1], other)
        to_right = np.repeat(half, other)
        for _ in range(swaps):
            b = np.bincount(cell, side[doc], cells)
            a = total - b
            now = _gaps(a, left) + _gaps(b, right)
            gain_a = now - _gaps(a - 1, left) - _gaps(b + 1, right)
            gain_b = now - _gaps(a + 1, left) - _gaps(b - 1, right)
            gain = np.bincount(doc, np.where(side[doc], gain_b[cell], gain_a[cell]), n)
            order = np.lexsort((-gain, side, at_node))
            x, y = order[base + pairs], order[base + to_right + pairs]
            swap = gain[x] + gain[y] > 1e-9
            if not swap.any():
                break
            side[x[swap]], side[y[swap]] = True, False
        order = np.lexsort((side, at_node))
        starts = np.unique(np.concatenate([starts, starts[:-1] + half]))
    return order, starts


def _gaps(degree: np.ndarray, size: np.ndarray) -> np.ndarray:
    degree = np.maximum(degree, 0)
    return degree * np.log2(size / (degree + 1))


_INDEX = "part int, seq int, docs long, total long, doc_ids binary, nulls binary, lengths binary, clusters binary, terms binary, df binary, at binary, tf binary, tf_bytes int"


def _segment(ids: pa.Array, texts: pa.Array, part: int, seq: int, least: int) -> pa.RecordBatch:
    w, n = terms(texts), len(ids)
    names, inverse = np.unique(w.hashes(), return_inverse=True)
    key, tf = np.unique(inverse * n + w.doc if n else inverse, return_counts=True)
    term, doc = key // max(n, 1), key % max(n, 1)
    order, starts = bisect(doc, term, n, least)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    again = np.argsort(term * n + rank[doc])
    size = 1 if tf.max(initial=0) < 256 else 4
    out = {
        "doc_ids": np.asarray(ids.fill_null(0), np.int64)[order], "nulls": np.asarray(ids.is_null())[order], "lengths": w.count[order].astype(np.int64), "clusters": starts.astype(np.int32),
        "terms": names, "df": np.bincount(term, minlength=len(names)).astype(np.int32), "at": rank[doc[again]].astype(np.int32), "tf": tf[again].astype(f"u{size}"),
    }
    row = {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "docs": pa.array([int((w.count > 0).sum())]), "total": pa.array([int(w.count.sum())])}
    return pa.RecordBatch.from_pydict(row | {k: pa.array([v.tobytes()], pa.binary()) for k, v in out.items()} | {"tf_bytes": pa.array([size], pa.int32())})


def _build(most_bytes: int, most_docs: int, least: int):
    def run(batches):
        part, seq, held, size, n = TaskContext.get().partitionId(), 0, [], 0, 0

        def close():
            t = pa.Table.from_batches(held).combine_chunks()
            return _segment(*(t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0) for c in ("doc_id", "text")), part, seq, least)

        for b in batches:
            _, off = binary_parts(b.column(1))
            a = 0
            while a < b.num_rows:
                z = min(b.num_rows, a + most_docs - n, int(np.searchsorted(off, off[a] + most_bytes - size, "right")) - 1)
                if z <= a and held:  # the next one does not fit
                    yield close()
                    seq, held, size, n = seq + 1, [], 0, 0
                    continue
                z = max(z, a + 1)
                held.append(b.slice(a, z - a))
                size, n, a = size + int(off[z] - off[a]), n + z - a, z
        if held:
            yield close()
        release()

    return run


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES, segment_docs: int = SEGMENT_DOCS, cluster: int = CLUSTER) -> DataFrame:
    """The index of documents (doc_id, text): one row a segment, with its documents in an order that puts like ones together, the bounds of
    its clusters, its terms (64 bits of hash each) and their postings. Written once to the shared folder; every task makes its own segments, nothing is shuffled.

    Null and empty texts are documents without terms; rows without a doc_id, and repeated ones, are documents of their own.
    """
    ship(docs.sparkSession)
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return materialise(d.mapInArrow(_build(segment_bytes, segment_docs, cluster), _INDEX), "search-index")


class Block:
    """Items of the query set: their terms with repeats, and what the whole index says of these."""

    def __init__(self, items: list[tuple]):
        self.items = [i for i, _ in items]
        w = terms(pa.array([t or "" for _, t in items], pa.string()))
        self.terms, inverse = np.unique(w.hashes(), return_inverse=True)
        each = Counter(zip(w.doc.tolist(), inverse.tolist()))
        self.item = np.array([q for q, _ in each], np.int64)
        self.term = np.array([u for _, u in each], np.int64)
        self.times = np.array(list(each.values()), np.int64)
        self.docs = self.total = 0

    def weigh(self, docs: int, total: int, df: dict[int, int]) -> None:
        self.docs, self.total = docs, total
        weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df.get(u, 0) + 1))) if u in df else 0 for u in range(len(self.terms))], np.int64)
        self.weight = weight[self.term] * self.times


def _found(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `wanted` are among the sorted names, and where."""
    at = np.searchsorted(names, wanted)
    at[at == len(names)] = 0
    here = np.flatnonzero(names[at] == wanted) if len(names) else np.zeros(0, np.int64)
    return here, at[here]


def _degrees(block: Block):
    def run(batches):
        df = np.zeros(len(block.terms), np.int64)
        for b in batches:
            for names, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                here, at = _found(np.frombuffer(names, np.uint64), block.terms)
                df[here] += np.frombuffer(count, np.int32)[at]
        here = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(here), "df": pa.array(df[here])})

    return run


class Best:
    """The TOP best documents so far of each item of a block."""

    def __init__(self, n: int, top: int, least: np.ndarray):
        self.n, self.top, self.least = n, top, least.copy()
        self.rows = [np.zeros(0, np.int64)] * 3  # item, score, doc_id

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(x) for x in zip(self.rows, (item, score, doc)))
        order = np.lexsort((doc, -score, item))
        item = item[order]
        first = np.searchsorted(item, np.arange(self.n))
        place = np.arange(len(item)) - first[item]
        keep = place < self.top
        self.rows = [item[keep], score[order][keep], doc[order][keep]]
        full = self.rows[0][place[keep] == self.top - 1]
        self.least[full] = np.maximum(self.least[full], self.rows[1][place[keep] == self.top - 1])


class Searcher:
    """Visits the clusters of one segment after another for all items of a block, those of high bounds first.

    A cluster's bound for an item is the sum over its terms of weight times the largest share that a document of the cluster has. A cluster whose bound is below the
    score of the item's last document so far is not looked at for it, and a segment is left as soon as no item has a cluster to look at: exact, as
    equal bounds are looked at for the sake of ties, which go by doc_id.
    """

    def __init__(self, block: Block, top: int, least: np.ndarray):
        self.block, self.best = block, Best(len(block.items), top, least)
        # sums of doubles are exact up to 2**53
        most = np.bincount(block.item, block.weight.astype(float), len(block.items)).max(initial=0) * 1e6
        self.kind = np.float64 if most < 2**53 else np.int64
        self.visited = self.clusters = 0

    def segment(self, row: dict) -> None:
        b = self.block
        clusters = np.frombuffer(row["clusters"], np.int32).astype(np.int64)
        if len(clusters) < 2 or not b.total:
            return
        here, at = _found(np.frombuffer(row["terms"], np.uint64), b.terms)
        df = np.frombuffer(row["df"], np.int32).astype(np.int64)
        off = np.cumsum(df) - df
        many = df[at]
        pick = np.arange(int(many.sum())) + np.repeat(off[at] - (np.cumsum(many) - many), many)
        doc = np.frombuffer(row["at"], np.int32)[pick].astype(np.int64)
        tf = np.frombuffer(row["tf"], f"u{row['tf_bytes']}")[pick].astype(np.int64)
        term = np.repeat(np.arange(len(here)), many)
        norm = 25 + 75 * np.frombuffer(row["lengths"], np.int64) * b.docs // b.total
        share = 1_000_000_000 * tf // (1000 * tf + 8 * norm[doc])
        cluster = np.searchsorted(clusters, doc, "right") - 1
        n = len(clusters) - 1
        self.clusters += n
        if not len(here):
            return
        place = np.full(len(b.terms), -1)
        place[here] = np.arange(len(here))
        mine = place[b.term] >= 0
        weight = np.zeros((len(b.items), len(here)), self.kind)
        weight[b.item[mine], place[b.term[mine]]] = b.weight[mine]
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (cluster[1:] != cluster[:-1])]))
        most = np.zeros((len(here), n), self.kind)
        most[term[first], cluster[first]] = np.maximum.reduceat(share, first)
        bound = (weight @ most).astype(np.int64)
        least = self.best.least
        order = np.argsort(-(bound / np.maximum(least, 1)[:, None]).max(0), kind="stable")
        later = np.maximum.accumulate(bound[:, order[::-1]], axis=1)[:, ::-1]
        by_cluster = np.argsort(cluster, kind="stable")
        edge = np.searchsorted(cluster[by_cluster], np.arange(n + 1))
        ids = np.where(np.frombuffer(row["nulls"], bool), _NO_ID, np.frombuffer(row["doc_ids"], np.int64))
        for k, c in enumerate(order.tolist()):
            if not (later[:, k] >= np.maximum(least, 1)).any():
                break
            asked = np.flatnonzero(bound[:, c] >= np.maximum(least, 1))
            if not len(asked):
                continue
            self.visited += 1
            p = by_cluster[edge[c] : edge[c + 1]]
            own, column = np.unique(term[p], return_inverse=True)
            shares = np.zeros((len(own), int(clusters[c + 1] - clusters[c])), self.kind)
            shares[column, doc[p] - clusters[c]] = share[p]
            score = (weight[np.ix_(asked, own)] @ shares).astype(np.int64)
            i, d = np.nonzero(score >= np.maximum(least[asked], 1)[:, None])
            if len(i):
                self.best.add(asked[i], score[i, d], ids[clusters[c] + d])


def _visit(block: Block, top: int, least: np.ndarray):
    def run(batches):
        s = Searcher(block, top, least)
        for b in batches:
            for k in range(b.num_rows):
                s.segment({c: b.column(c)[k].as_py() for c in b.schema.names})
        item, score, doc = s.best.rows
        kind = pa.int64()
        yield pa.RecordBatch.from_pydict({"item": pa.array(item), "item_id": pa.array([block.items[q] for q in item.tolist()], kind), "doc_id": pa.array(doc, mask=doc == _NO_ID), "score": pa.array(score)})

    return run


_ROWS = "item long, item_id long, doc_id long, score long"
_READ = ["docs", "doc_ids", "nulls", "lengths", "clusters", "terms", "df", "at", "tf", "tf_bytes"]


def _ranked(found: DataFrame, top: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def _blocks(items: DataFrame):
    held, size = [], 0
    for r in items.select(items["item_id"].cast("long"), items["text"]).toLocalIterator():
        n = len((r[1] or "").encode())
        if held and (len(held) == BLOCK_ITEMS or size + n > BLOCK_BYTES):
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += n
    if held:
        yield held


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of highest score above 0 for each row of items (item_id, text), equal scores by ascending
    doc_id, null ids last. Scores are the integers of the contract: sums of weight times share over an item's terms with repeats.

    Items are taken in blocks of at most BLOCK_ITEMS and BLOCK_BYTES, and the index is read once for each block. Tasks read their segments and
    hand on `top` documents an item at most; thresholds from FIRST segments or so let the others pass over most of their clusters.
    """
    spark = index.sparkSession
    ship(spark)
    n, docs, total = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    done = []
    for held in _blocks(items):
        if done:  # written, so that no two blocks are held
            done[-1] = materialise(done[-1], "search-block")
        block = Block(held)
        df = index.select("terms", "df").mapInArrow(_degrees(block), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        block.weigh(docs, total, {r["term"]: r["df"] for r in df})
        least = np.zeros(len(block.items), np.int64)
        if n > 2 * FIRST:
            some = index.where(F.pmod(F.xxhash64("part", "seq"), F.lit(n // FIRST)) == 0).select(*_READ)
            for r in _ranked(some.mapInArrow(_visit(block, top, least), _ROWS), top).where(F.col("rank") == top).select("item", "score").collect():
                least[r["item"]] = r["score"]
        found = index.select(*_READ).mapInArrow(_visit(block, top, least), _ROWS)
        done.append(_ranked(found, top).select("item_id", "rank", "doc_id", "score"))
    if not done:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
QUERIES = {"op13_ranked_search": op13_ranked_search}
SQL = {
    "op13_ranked_search": f"""
with d as (select row_number() over () as r, doc_id, unnest({_TERMS}) as term from documents),
tf as (select r, doc_id, term, count(*) as tf from d group by all),
len as (select r, count(*) as n from d group by r),
g as (select count(*) as docs, sum(n)::bigint as total from len),
df as (select term, count(*) as df from tf group by term),
i as (select q, item_id, term, count(*) as times from (select row_number() over () as q, item_id, unnest({_TERMS}) as term from benchmark) group by all),
w as (select q, item_id, term, times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint as w from i join df using (term), g),
s as (select q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::bigint as score
      from w join tf using (term) join len using (r), g group by all)
select item_id, rank, doc_id, score
from (select item_id, row_number() over (partition by q order by score desc, doc_id nulls last)::int as rank, doc_id, score from s where score > 0) where rank <= 10"""
}
