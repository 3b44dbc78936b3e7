"""Exact substring removal by fixed-block anchors.

A window of 20 words holds a whole block of 10 words that starts at a multiple of 10 in its document, wherever the
window starts. So blocks at multiples of 10 (the index) are probed with every rolling run of 10 words of every
document; a hit is then extended to all windows of 20 words that contain it, and those are compared by a cryptographic digest of
their words. A maximal repeat is a run of windows that occur earlier, and goes as a whole.

Hits are not extended pair by pair: a passage in a third of all documents would make pairs without end, and the first
occurrence of a block need not be that of the windows around it. Each window finds its own first occurrence instead.

Rows of the first shuffle are not words but columns of hashes for a batch and bucket. A batch sends each hash once,
so that a passage or a run that a third of all documents share costs each batch one entry; batches grow with the number
of buckets, so that a row has some 64 entries, up to about 1 TB of text. There MOST entries bound a batch, and with the number of buckets rows get shorter:
some 7 entries at 10 TB and one at 100 TB, with as much more work for each entry.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytekit import U64, Words, binary_parts, from_planes, mix, planes, release, slices
from .cluster import materialise, read, ship

#: Bytes of text that are hashed together, and that a bucket of hashes stands for (the second beyond MANY buckets).
BATCH, BUCKET, LARGE, MANY = 1 << 20, 5 << 20, 16 << 20, 4096
#: Entries for each bucket that a batch gathers before it sends them, and least and most of all.
ENTRIES, LEAST, MOST = 64, 1 << 18, 1 << 22
#: In place of a null doc_id: the smallest.
NO_ID = -(2**63)
_ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("n", pa.int32()), ("body", pa.binary())])
SENT = "bucket int, kind tinyint, n int, body binary"
FOUND = "block int, n int, body binary"
PLACES = "_id long, places binary"


def _runs(batches, columns):
    """(doc ids, words, record batch, range of its rows) for runs of documents of about BATCH bytes."""
    for b in batches:
        buf, off = binary_parts(b.column(columns.index("text")))
        ids = b.column(columns.index("_id")).to_numpy(zero_copy_only=False)
        for i, j in slices(off, BATCH):
            yield ids[i:j], Words(buf[off[i] : off[j]], off[i : j + 1] - off[i]), b, i, j
    release()


def _by_block(blocks: int, ids: np.ndarray, pos: np.ndarray):
    """(block, number, columns) of places in documents, dealt to blocks by document."""
    block = (mix(ids.astype(np.int64).view(np.uint64)) % U64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []:
        yield int(block[part[0]]), len(part), planes(ids[part].astype("<i8")) + planes(pos[part].astype("<u4"))


def _send(buckets: int, h: np.ndarray, flag: np.ndarray, ids: np.ndarray, pos: np.ndarray, wide: np.ndarray | None, local) -> pa.RecordBatch:
    """Entries by bucket, and places that need no answer (kind 1), which go where answers about their documents go."""
    rows = [[], [], [], []]
    b = (h % U64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cut = np.flatnonzero(np.diff(b[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        q = h[part] // U64(buckets)
        body = planes(q.astype("<u4") if wide is None else q) + flag[part].astype(np.uint8).tobytes() + planes(ids[part].astype("<i8")) + planes(pos[part].astype("<u4"))
        for r, x in zip(rows, (int(b[part[0]]), 0, len(part), body + (planes(wide[part].astype("<u8")) if wide is not None else b""))):
            r.append(x)
    for block, n, body in local:
        for r, x in zip(rows, (block, 1, n, body)):
            r.append(x)
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(rows, _ROW)], schema=_ROW)


def _receive(table: pa.Table, wide: bool):
    """Entries of a bucket: hash, flag, doc_id, position, further hash bits; and the rows that only pass through."""
    kind = table.column("kind").to_numpy()
    n, body = table.column("n").to_numpy(), table.column("body")
    size = 8 if wide else 4
    parts = [[], [], [], [], []]
    for i in np.flatnonzero(kind == 0):
        k, raw, at = int(n[i]), body[int(i)].as_buffer(), 0
        for p, dtype in zip(parts, (f"<u{size}", "u1", "<i8", "<u4", *(["<u8"] if wide else []))):
            step = k * np.dtype(dtype).itemsize
            p.append(from_planes(raw[at : at + step], k, dtype))
            at += step
    ones = table.filter(pa.array(kind == 1)).select(["bucket", "n", "body"]).rename_columns(["block", "n", "body"])
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts], ones


def _answer(blocks: int, ids: np.ndarray, pos: np.ndarray, ones: pa.Table) -> pa.Table:
    rows = list(_by_block(blocks, ids, pos))
    own = [pa.array([r[k] for r in rows], ones.schema.field(k).type) for k in range(3)]
    return pa.concat_tables([pa.Table.from_arrays(own, schema=ones.schema), ones])


def _places(table):
    """Places of a block by document."""
    n = table.column("n").to_numpy()
    ids, pos = [np.zeros(0, "<i8")], [np.zeros(0, "<u4")]
    for k, cell in zip(n.tolist(), table.column("body")):
        raw = cell.as_buffer()
        ids.append(from_planes(raw[: 8 * k], k, "<i8"))
        pos.append(from_planes(raw[8 * k : 12 * k], k, "<u4"))
    ids, pos = np.concatenate(ids), np.concatenate(pos)
    order = np.lexsort((pos, ids))
    ids, pos = ids[order], pos[order]
    cut = np.flatnonzero(np.diff(ids)) + 1
    lists = [p.tobytes() for p in np.split(pos, cut)] if len(ids) else []
    return pa.table({"_id": pa.array(ids[np.r_[0, cut]] if len(ids) else [], pa.int64()), "places": pa.array(lists, pa.binary())})


def _gathered(parts, most: int):
    """Tuples of arrays, put together until they have `most` entries."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p[0])
        if n >= most:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _probe(window: int, block: int, buckets: int, most: int):
    def probes(batches):
        for ids, w, *_ in _runs(batches, ["_id", "text"]):
            at, h = w.grams(w.hashes(), block)
            long = w.count[w.doc[at]] >= window
            at, h = at[long], h[long]
            yield h, ids[w.doc[at]], w.pos[at]

    def run(batches):
        for h, ids, pos in _gathered(probes(batches), most):
            order = np.argsort(h, kind="stable")
            s = h[order]
            new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
            first = order[new]
            size = np.diff(np.r_[np.flatnonzero(new), len(s)])
            many = size > 1
            anchor = pos % block == 0
            anchored = np.bitwise_or.reduceat(anchor[order], np.flatnonzero(new)) if len(s) else anchor
            again = np.zeros(len(s), bool)
            again[order] = np.repeat(many, size)
            local = _by_block(buckets, ids[again], pos[again])
            # in document order, for which the columns compress best
            back = np.argsort(first, kind="stable")
            first, anchored, many = first[back], anchored[back], many[back]
            yield _send(buckets, h[first], anchored | many << 1, ids[first], pos[first], None, local)

    return run


def _hits(buckets: int):
    return lambda table: _hits_of(buckets, table)


def _hits_of(buckets: int, table: pa.Table) -> pa.Table:
    (h, flag, ids, pos, _), ones = _receive(table, False)
    order = np.argsort(h, kind="stable")
    s = h[order]
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    n = np.diff(np.r_[at, len(s)])
    anchored = np.bitwise_or.reduceat(flag[order], at) & 1 > 0 if len(s) else np.zeros(0, bool)
    hit = order[np.repeat((n > 1) & anchored, n)]
    hit = hit[flag[hit] & 2 == 0]  # the others' batch knows already
    return _answer(buckets, ids[hit], pos[hit], ones)


def _positions(cell: bytes | None) -> np.ndarray:
    return np.frombuffer(cell or b"", "<u4").astype(np.int64)


def _marks(w: Words, lists, size: int) -> np.ndarray:
    """True at the words that lie in runs of `size` words from the given positions of each document."""
    step = np.zeros(len(w.at) + size + 1, np.int64)
    for d, cell in enumerate(lists):
        if cell:
            at = np.unique(_positions(cell)) + w.doc_at[d]
            at = at[at + size <= w.doc_at[d + 1]]
            step[at] += 1
            step[at + size] -= 1
    return np.cumsum(step)[: len(w.at)] > 0


def _digests(w: Words, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b of the n words from each place, as two numbers."""
    line, ends = w.line()
    line = memoryview(line)
    raw = b"".join(blake2b(line[a:z], digest_size=16).digest() for a, z in zip(ends[at].tolist(), (ends[at + n] - 1).tolist()))
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _first_of(h: np.ndarray, h2: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different digest stands first in document and place, and the places that have one earlier.

    Equal to the first in document and place is a repeated row, not a later occurrence."""
    order = np.lexsort((pos, ids, h2, h))
    s, s2 = h[order], h2[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (s2[1:] != s2[:-1])] if len(s) else np.zeros(0, bool)
    first = order[new]
    lead = np.repeat(first, np.diff(np.r_[np.flatnonzero(new), len(s)])) if len(s) else order
    return first, order[(ids[lead] != ids[order]) | (pos[lead] != pos[order])]


def _extend(window: int, block: int, buckets: int, most: int):
    def windows(batches):
        for ids, w, b, i, j in _runs(batches, ["_id", "text", "places"]):
            seed = np.zeros(len(w.at) + window, np.int64)
            for d, cell in enumerate(b.column(2).slice(i, j - i).to_pylist()):
                p = _positions(cell) + w.doc_at[d]
                seed[p[p < w.doc_at[d + 1]]] = 1
            at = np.flatnonzero(w.pos + window <= np.repeat(w.count, w.count))
            sums = np.concatenate([[0], np.cumsum(seed)])
            at = at[sums[at + window - block + 1] > sums[at]]  # a hit starts inside, with room for its block
            yield *_digests(w, at, window), ids[w.doc[at]], w.pos[at]

    def run(batches):
        for h, h2, ids, pos in _gathered(windows(batches), most):
            first, late = _first_of(h, h2, ids, pos)
            first, late = np.sort(first), np.sort(late)
            yield _send(buckets, h[first], np.zeros(len(first), np.uint8), ids[first], pos[first], h2[first], _by_block(buckets, ids[late], pos[late]))

    return run


def _later(buckets: int):
    return lambda table: _later_of(buckets, table)


def _later_of(buckets: int, table: pa.Table) -> pa.Table:
    (h, _, ids, pos, h2), ones = _receive(table, True)
    late = _first_of(h, h2, ids, pos)[1]
    return _answer(buckets, ids[late], pos[late], ones)


def _keep(window: int):
    def run(batches):
        for _, w, b, i, j in _runs(batches, ["_id", "text", "places"]):
            gone = _marks(w, b.column(2).slice(i, j - i).to_pylist(), window)
            line, ends = w.line()
            size = np.diff(ends) * ~gone
            kept = np.frombuffer(line, np.uint8)[np.repeat(~gone, np.diff(ends))].tobytes()
            ends = np.concatenate([[0], np.cumsum(size)])[w.doc_at]
            kept = [kept[a : max(a, z - 1)].decode("utf-8", "replace") for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
            n_gone = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.doc_at])
            # maximal repeats: runs of words that go, each in one document
            first = gone & ~np.concatenate([[False], gone[:-1] & (w.doc[1:] == w.doc[:-1])]) if len(gone) else gone
            at = np.flatnonzero(first)
            size = np.add.reduceat(gone, at, dtype=np.int64) if len(at) else at
            spans = pa.StructArray.from_arrays([pa.array(w.pos[at]), pa.array(size)], ["start", "length"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, w.doc_at).astype(np.int32)), spans)
            columns = [b.column(3).slice(i, j - i), pa.array(w.count), pa.array(n_gone), spans, pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "n_words", "n_removed", "spans", "kept"])

    return run


def _text_key() -> list[Column]:
    """128 bits of the text, for telling rows that share a doc_id apart."""
    return [F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(7), "text").alias("_h2")]


def numbered(d: DataFrame) -> tuple[DataFrame, int]:
    """d (doc_id, text, ...) with _id, and the bytes of its texts.

    Rows are one document if doc_id and text are equal. _id: doc_id (null: the least) where it tells all documents apart, else their
    number in the order of doc_id and a hash of the text.
    """
    key = F.coalesce("doc_id", F.lit(NO_ID)).alias("_key")
    each = d.select(key, *_text_key(), F.octet_length("text").alias("n")).groupBy("_key").agg(F.min("_h1").alias("a"), F.max("_h1").alias("z"), F.sum("n").alias("n"))
    size, shared = each.agg(F.sum("n"), F.max(F.col("a") != F.col("z"))).first()
    if not shared:
        return d.withColumn("_id", key), size or 0
    order = d.select(key, *_text_key()).distinct().sort("_key", "_h1", "_h2").withColumn("_id", F.monotonically_increasing_id())
    order = materialise(order, "substring-order")
    return d.select("*", key, *_text_key()).join(order, ["_key", "_h1", "_h2"]).drop("_key", "_h1", "_h2"), size or 0


def drop_repeats(docs: DataFrame, window: int = 20, carry: list[str] | None = None) -> DataFrame:
    """Columns `carry` (doc_id alone if not given) with n_words, n_removed, spans, kept, for every row of docs.

    Words are maximal runs of characters other than 0x20 and 0x09-0x0D. A word goes if a window of `window` words
    over it occurs earlier too: in a document of smaller doc_id, or earlier in its own. spans: the maximal runs of
    words that go (start, from 0, and length); kept: the other words, joined by one space. Null and empty texts have no words. A null doc_id is smaller than all others. Rows of
    one doc_id (or without) and different texts are documents of their own, in the order of a hash of the text; rows that are equal in both are
    one document and don't remove each other at the same place. Columns that aren't carried are ignored. A task holds one text of any
    length, with some 30 bytes of memory for each of its bytes.
    """
    spark = docs.sparkSession
    ship(spark)
    block = window // 2
    row = F.struct(*(docs[c] for c in carry or ["doc_id"])).alias("_row")
    d, size = numbered(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"), row))
    buckets = max(8, -(-size // BUCKET))
    if buckets > MANY:
        buckets = max(MANY, -(-size // LARGE))
    most = min(MOST, max(LEAST, ENTRIES * buckets))
    sent = d.select("_id", "text").mapInArrow(_probe(window, block, buckets, most), SENT)
    found = sent.groupBy("bucket").applyInArrow(_hits(buckets), FOUND)
    hits = materialise(found.groupBy("block").applyInArrow(_places, PLACES), "substring-hits")
    sent = d.join(hits, "_id").select("_id", "text", "places").mapInArrow(_extend(window, block, buckets, most), SENT)
    found = sent.groupBy("bucket").applyInArrow(_later(buckets), FOUND)
    late = materialise(found.groupBy("block").applyInArrow(_places, PLACES), "substring-late")
    whole = d.join(late, "_id", "left").select("_id", "text", "places", "_row")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    more = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.StringType())]
    out = whole.mapInArrow(_keep(window), T.StructType([whole.schema["_row"], *more]))
    return out.select("_row.*", "n_words", "n_removed", "spans", "kept")


def op3_anchor_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drop_repeats(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op3_anchor_substring_dedup": op3_anchor_substring_dedup}
_OP3 = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), win as (
  select doc_id, p, md5(array_to_string(list_slice(w, p, p + 19), ' ')) as k from (select doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) as p from d)
), late as (
  select doc_id, p from (select *, row_number() over (partition by k order by doc_id, p) as nth from win) where nth > 1
), gone as (
  select distinct doc_id, unnest(range(p, p + 20)) as i from late
), word as (
  select doc_id, i, x, g.i is not null as removed from (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from d) left join gone g using (doc_id, i)
), kept as (
  select doc_id, count(*) filter (where removed) as n_removed, string_agg(x, ' ' order by i) filter (where not removed) as kept from word group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join kept using (doc_id)
"""
SQL = {"op3_anchor_substring_dedup": _OP3}
