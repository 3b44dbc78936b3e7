"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytekit import release
from .cluster import read, ship

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Tournament:
    """First bin with room for a piece: a complete binary tree whose inner nodes hold the larger room below."""

    def __init__(self, leaves: int, room: int):
        self.n = 1 << max(0, leaves - 1).bit_length()
        self.t = [room] * (2 * self.n)

    def put(self, size: int) -> int:
        t, i = self.t, 1
        if t[1] < size:
            return -1
        while i < self.n:
            i *= 2
            if t[i] < size:
                i += 1
        leaf = i - self.n
        t[i] -= size
        while i > 1:
            i //= 2
            t[i] = max(t[2 * i], t[2 * i + 1])
        return leaf


def pack_group(lengths: list[int], room: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of documents with these numbers of tokens.

    Whole runs of `room` tokens are sequences of their own. The rests go by first-fit decreasing. Then the
    emptiest sequences are taken apart and their pieces cut to fill what is open elsewhere; of the one that may
    stay open, the tokens are cut into sequences whose lengths are powers of two, which need no padding.
    """
    full, rest = [], []
    for d, n in enumerate(lengths):
        whole = n // room * room
        full += [(d, s, room) for s in range(0, whole, room)]
        if n > whole:
            rest.append((n - whole, d, whole))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree = Tournament(max(1, len(rest)), room)
    bins: dict[int, list] = {}
    for n, d, s in rest:
        bins.setdefault(tree.put(n), []).append((d, s, n))
    held = sorted(bins.values(), key=lambda b: (-sum(p[2] for p in b), b[0]))
    open_ = [room - sum(p[2] for p in b) for b in held]
    i, j = 0, len(held) - 1
    while i < j:
        if open_[i] == 0:
            i += 1
        elif not held[j]:
            j -= 1
        else:
            d, s, n = held[j].pop()
            cut = min(n, open_[i])
            held[i].append((d, s, cut))
            open_[i] -= cut
            open_[j] += n
            if cut < n:
                held[j].append((d, s + cut, n - cut))
                open_[j] -= n - cut
    sequences = [[p] for p in full] + [b for b in held if b]
    if sequences and (last := sum(p[2] for p in sequences[-1])) < room:
        pieces = sequences.pop()[::-1]
        for k in range(last.bit_length() - 1, -1, -1):
            size, part = 1 << k, []
            while last >> k & 1 and size:
                d, s, n = pieces.pop()
                cut = min(n, size)
                part.append((d, s, cut))
                size -= cut
                if cut < n:
                    pieces.append((d, s + cut, n - cut))
            if part:
                sequences.append(part)
    out = []
    for q, pieces in enumerate(sequences):
        at = 0
        for d, s, n in pieces:
            out.append((d, s, n, q, at))
            at += n
    return out


def _encode(tokenizer: str, end: int, groups: int):
    def run(batches):
        import xxhash
        from pyspark import TaskContext

        from . import tokenizers

        hash_of = lambda x: xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1
        part, seen = TaskContext.get().partitionId(), {}
        enc = tokenizers.word_bpe(tokenizer)
        for b in batches:
            texts = b.column(2).to_pylist()
            ids = [np.append(x, np.uint32(end)).astype("<u4").tobytes() for x in enc.encode(texts)]
            # equal rows would all be dealt to one group: those that a task has seen are dealt anew
            dealt = []
            for h, row in zip(b.column(0).to_pylist(), zip(b.column(1).to_pylist(), map(hash_of, texts))):
                k = seen.get(row, 0)
                seen[row] = k + 1
                dealt.append((h if not k else hash_of(f"{h} {part} {k}")) % groups)
            yield pa.RecordBatch.from_arrays([pa.array(dealt, pa.int64()), b.column(1), pa.array(ids, pa.binary())], ["group", "doc_id", "ids"])
        release()

    return run


def _pack(room: int):
    def run(key, table):
        table = table.combine_chunks()
        ids = table.column("ids").to_pylist()
        docs = table.column("doc_id").to_pylist()
        # by content, so that the order in which rows arrive doesn't matter
        order = sorted(range(len(ids)), key=lambda i: (docs[i] is None, docs[i] or 0, ids[i]))
        out = pack_group([len(ids[i]) // 4 for i in order], room)
        d, s, n, q, at = (list(x) for x in zip(*out))
        base = key[0].as_py() << 32
        own = [order[i] for i in d]
        return pa.table({
            "doc_id": pa.array([docs[i] for i in own], pa.int64()), "start": pa.array(s, pa.int64()), "length": pa.array(n, pa.int64()),
            "doc_tokens": pa.array([len(ids[i]) // 4 for i in own], pa.int64()), "sequence_id": pa.array([base + x for x in q], pa.int64()),
            "offset": pa.array(at, pa.int64()), "ids": pa.array([ids[i][4 * a : 4 * (a + k)] for i, a, k in zip(own, s, n)], pa.binary()),
        })

    return run


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 4096, end: int = 2, group_docs: int = 512, seed: str = "pack") -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of every document's tokens and end token.

    ids: the piece's token ids, little-endian unsigned 32-bit. Documents are dealt at random (a hash of id and
    text) to groups of about group_docs, each packed by itself; a group is one task's memory. A null or empty
    text is its end token alone. Repeated rows are packed as often as they occur, and dealt to groups of their own, however many they are. No
    rows: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    groups = max(1, round(docs.count() / group_docs))
    text = F.coalesce(docs["text"], F.lit(""))
    d = docs.select(
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", text), 1).alias("group"),
        docs["doc_id"].cast("long").alias("doc_id"),
        text.alias("text"),
    )
    ids = d.mapInArrow(_encode(tokenizer, end, groups), "group long, doc_id long, ids binary")
    return ids.groupBy("group").applyInArrow(_pack(room), PIECES)


def op2_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    d = pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return d.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op2_ffd_packing": op2_ffd_packing}
SQL: dict[str, str] = {}
