"""Repair of conversations' structure: the cheapest edits that make roles alternate, by a dynamic programme over many conversations at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import materialise, parts, read, ship

#: Rows and bytes of text of a piece. A longer conversation is several, which are solved apart and joined. Plan only.
PIECE, PIECE_BYTES = 4096, 8 << 20
#: Conversations that are solved side by side hold so many turns in all, padded to the longest of their bucket.
CELLS = 1 << 18
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: States: nothing yet, after a system row, after a user's, after an assistant's. From each the next role is settled: user, user, assistant, user.
_NEXT = np.array([2, 2, 3, 2])
#: What it takes to end in each state.
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
_FAR = 1 << 40
OK, TRUNCATED, DUPLICATE, BLANK = range(4)
_BLANKS, _STOPS = "\\x20\\x09-\\x0D", ".!?"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of conversations with faults put in, each row's by crc32 of `conv_id:turn`, remainder by 20:
    0 is gone, 1 has no text, 2 no `.!?`, 3 comes twice, 4 is the user's. Nulls count as one space, but turn and conv_id stay null."""
    name = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    d = rows.select(
        rows["conv_id"].alias("conv_id"), rows["turn"].cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).alias("_k")
    )
    text = F.when(F.col("_k").isin(0, 1), "").when(F.col("_k") == 2, F.regexp_replace("text", f"[{_STOPS}]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_k") == 0).alias("gone"), times.alias("_t")).drop("_t")


# The dynamic programme. A row is a code: its fault, and 4 times its role's initial (0 s, 1 u, 2 a, 3 another).


def backward(fault: np.ndarray, who: np.ndarray, size: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs to go, [turn, conversation, state]. fault, who: [turn, conversation], of which the first `size` turns count; end: costs after all rows."""
    steps, n = fault.shape
    out = np.empty((steps + 1, n, 4), np.int64)
    out[steps] = end
    for t in range(steps - 1, -1, -1):
        b, f, w = out[t + 1], fault[t][:, None], who[t][:, None]
        cut = np.where(f == OK, 0, np.where(f == TRUNCATED, CUT_OFF, _FAR))
        on = b[:, _NEXT]
        x = np.minimum(DELETE + b, cut + on + np.where(w == _NEXT - 1, 0, REROLE))
        x[:, 0] = np.minimum(x[:, 0], np.where(w[:, 0] == 0, cut[:, 0] + b[:, 1], _FAR))
        for _ in range(2):  # no more than two rows come in at one place
            x = np.minimum(x, INSERT + x[:, _NEXT])
        out[t] = np.where((t < size)[:, None], x, b)
    return out


def trace(fault: np.ndarray, who: np.ndarray, size: np.ndarray, cost: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cheapest edits from `state` on, of equal ones the least in order of their letters: letters and settled roles (1 user, 2 assistant, 0 as it was),
    [conversation, edit], 0 past the end, and the states at the end. Rows may come in after the last one only where `last` says so."""
    n = len(size)
    c, t, s = np.arange(n), np.zeros(n, np.int64), state.astype(np.int64).copy()
    letters, roles = [], []
    live = c[(size > 0) | (last & (_END[s] > 0))]
    while len(live):
        a, k, z = t[live], live, s[live]
        row, now, nx = a < size[k], cost[a, k, z], _NEXT[s[live]]
        b = np.minimum(a + 1, len(cost) - 1)
        at = np.minimum(a, max(len(fault) - 1, 0))
        f, w = (fault[at, k], who[at, k]) if len(fault) else (np.full(len(k), BLANK), np.full(len(k), 3))
        cut = np.where(f == OK, 0, np.where(f == TRUNCATED, CUT_OFF, _FAR))
        first = row & (z == 0) & (w == 0) & (cut + cost[b, k, 1] == now)
        delete = row & (DELETE + cost[b, k, z] == now)
        insert = ~delete & (INSERT + cost[a, k, nx] == now)
        keep = ~delete & ~insert & (first | row & (w == nx - 1) & (cut + cost[b, k, nx] == now))
        letter, role = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        letter[k] = np.select([delete, insert, keep], [ord("D"), ord("I"), ord("K")], ord("R"))
        role[k] = np.where(delete | keep, 0, nx - 1)
        s[k] = np.where(delete, z, np.where(keep & (w == 0), 1, nx))
        t[k] += ~insert
        letters.append(letter)
        roles.append(role)
        live = k[(t[k] < size[k]) | (last[k] & (_END[s[k]] > 0))]
    none = np.zeros((0, n), np.uint8)
    return np.array(letters or none).T.reshape(n, -1), np.array(roles or none).T.reshape(n, -1), s


def buckets(size: np.ndarray):
    """Numbers of conversations of about one length (within a factor of two), CELLS turns in all at most but for a longer one alone."""
    order = np.argsort(size, kind="stable")
    a = 0
    while a < len(order):
        z = a + 1
        while z < len(order) and size[order[z]] <= max(4, 2 * size[order[a]]) and (z + 1 - a) * size[order[z]] <= CELLS:
            z += 1
        yield order[a:z]
        a = z


def _tensor(codes: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Faults and initials [turn, conversation] of conversations whose codes begin at `at`."""
    turn = np.arange(int(size.max(initial=0)))[:, None]
    code = codes[np.minimum(at + turn, max(len(codes) - 1, 0))] if len(codes) else np.zeros((0, len(at)), np.uint8)
    return code & 3, code >> 2


class Solved:
    """Edits of conversations (or pieces): letters, settled roles and number of edits of each, costs and last states."""

    def __init__(self, codes: np.ndarray, off: np.ndarray, end: np.ndarray, state: np.ndarray, last: np.ndarray):
        n = len(off) - 1
        size = np.diff(off)
        self.cost, self.state = np.zeros(n, np.int64), np.zeros(n, np.int64)
        found: list[tuple[bytes, np.ndarray]] = [(b"", np.zeros(0, np.uint8))] * n
        for k in buckets(size):
            fault, who = _tensor(codes, off[:-1][k], size[k])
            cost = backward(fault, who, size[k], end[k])
            letters, roles, self.state[k] = trace(fault, who, size[k], cost, state[k], last[k])
            self.cost[k] = cost[0, np.arange(len(k)), state[k]]
            for i, a, b in zip(k.tolist(), letters, roles):
                m = int(np.count_nonzero(a))
                found[i] = (a[:m].tobytes(), b[:m])
        self.audit = [x.decode() for x, _ in found]
        self.letters = np.frombuffer(b"".join(x for x, _ in found), np.uint8)
        self.roles = np.concatenate([np.zeros(0, np.uint8), *(x for _, x in found)])
        self.count = np.array([len(x) for x, _ in found], np.int64)

    def messages(self, roles: pa.Array, texts: pa.Array) -> pa.ListArray:
        """The repaired rows of each conversation, of the rows of all in order."""
        row = np.cumsum(self.letters != ord("I")) - 1
        stays = self.letters != ord("D")
        new = self.letters == ord("I")
        take = pa.array(np.where(new, 0, row)[stays], mask=new[stays])
        settled = pa.DictionaryArray.from_arrays(pa.array(np.maximum(self.roles[stays].astype(np.int8) - 1, 0)), ["user", "assistant"]).cast(pa.string())
        role = pc.if_else(pa.array(self.roles[stays] > 0), settled, roles.take(take))
        ends = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], np.cumsum(self.count)])]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([role, texts.take(take).fill_null("")], ["role", "text"]))


def _matrices(codes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """[piece, from, to]: what each piece costs from one state to another, rows that come in after its last one apart."""
    n, size = len(off) - 1, np.diff(off)
    out = np.empty((n, 4, 4), np.int64)
    for k in buckets(size):
        fault, who = _tensor(codes, off[:-1][k], size[k])
        for to in range(4):
            end = np.where(np.arange(4) == to, 0, _FAR) * np.ones((len(k), 1), np.int64)
            out[k, :, to] = backward(fault, who, size[k], end)[0]
    return np.minimum(out, _FAR)


# Rows of conversations in order, to pieces


def _codes(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Code and digest (role and text) of each row; a row is a duplicate if its conversation has one like it before. conv: number of each row's conversation."""
    blank = pc.invert(pc.match_substring_regex(texts, f"[^{_BLANKS}]"))
    ended = pc.match_substring_regex(texts, rf"[{_STOPS}][{_BLANKS}]*\z")
    digest = [hashlib.blake2b(f"{len(r)}:{r}{t}".encode(), digest_size=16).digest() for r, t in zip(roles.to_pylist(), texts.to_pylist())]
    seen: set[tuple[int, bytes]] = set()
    again = np.zeros(len(digest), bool)
    for i, x in enumerate(zip(conv.tolist(), digest)):
        again[i] = x in seen
        seen.add(x)
    fault = np.where(np.asarray(blank), BLANK, np.where(again, DUPLICATE, np.where(np.asarray(ended), OK, TRUNCATED)))
    first = pc.utf8_slice_codeunits(roles, 0, 1).to_pylist()
    who = np.array(["sua".find(c) if c else -1 for c in first], np.int64).reshape(-1)
    return (fault + 4 * np.where(who < 0, 3, who)).astype(np.uint8), digest


def _illegal(codes: np.ndarray, conv: np.ndarray, n: int) -> np.ndarray:
    """Pairs of neighbours, by conversation, other than su, ua and au."""
    w = codes >> 2
    if len(w) < 2:
        return np.zeros(n, np.int64)
    wrong = (conv[1:] == conv[:-1]) & ~_follows(w[:-1], w[1:])
    return np.bincount(conv[1:][wrong], minlength=n)


def _follows(a, b):
    return ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_MESSAGES = "array<struct<role:string,text:string>>"


def _pieces(kind: str, piece_rows: int, piece_bytes: int):
    """Sorted rows of a partition, as whole conversations with their edits, or as pieces (`edge`) of those that may go on in another task or are long."""

    def whole_or_piece(t: pa.Table, starts: np.ndarray, edge: np.ndarray, part: int, seq: int) -> pa.RecordBatch:
        n = len(starts)
        number = np.repeat(np.arange(n), np.diff(np.append(starts, t.num_rows)))
        here = ~np.asarray(t["gone"])
        ids = t["conv_id"].combine_chunks().take(pa.array(starts))
        t, number = t.filter(pa.array(here)), number[here]
        roles, texts, turns = (t[c].combine_chunks() for c in ("role", "text", "turn"))
        size = np.bincount(number, minlength=n)
        off = np.concatenate([[0], np.cumsum(size)])
        codes, digest = _codes(number, roles, texts)
        # turns are in order, nulls first
        some = np.asarray(turns.is_valid())
        at, turn = number[some], np.asarray(turns.drop_null(), np.int64)
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (turn[1:] != turn[:-1])])[: len(at)]
        distinct = np.bincount(at[new], minlength=n)
        any_turn = np.bincount(at, minlength=n) > 0
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low[at[::-1]], high[at] = turn[::-1], turn
        s = Solved(codes, off, np.tile(_END, (n, 1)), np.zeros(n, np.int64), np.ones(n, bool))
        counts = {k: np.bincount(number[(codes & 3) == f], minlength=n) for k, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
        counts |= {"illegal": _illegal(codes, number, n), "cost": s.cost, "gaps": np.where(any_turn, high - low + 1 - distinct, 0)}
        raw = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.StructArray.from_arrays([roles, texts], ["role", "text"]))
        fixed = s.messages(roles, texts)
        both = pa.chunked_array([fixed, raw]).combine_chunks() if edge.any() else fixed
        cut = off.tolist()
        return pa.RecordBatch.from_pydict(
            {
                "conv_id": ids, "part": pa.array([part] * n, pa.int32()), "seq": pa.array(range(seq, seq + n), pa.int32()), "edge": pa.array(edge),
                "messages": both.take(pa.array(np.arange(n) + n * edge)), "audit": pa.array(s.audit, pa.string()), **{k: pa.array(v.astype(np.int64)) for k, v in counts.items()},
                "low": pa.array(low, mask=~any_turn), "high": pa.array(high, mask=~any_turn), "turns": pa.array(distinct.astype(np.int64)),
                "codes": pa.array([codes[a:z].tobytes() if e else None for a, z, e in zip(cut, cut[1:], edge.tolist())], pa.binary()),
                "digests": pa.array([digest[a:z] if e else None for a, z, e in zip(cut, cut[1:], edge.tolist())], pa.list_(pa.binary())),
            }
        )

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held, begun = None, True  # begun: what is held is, or may be, the rest of a conversation
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            key = t["conv_id"].combine_chunks()
            same = pc.fill_null(pc.equal(key[1:], key[:-1]), False)
            same = pc.or_(same, pc.and_(key[1:].is_null(), key[:-1].is_null()))
            runs = np.concatenate([[0], np.flatnonzero(~np.asarray(same)) + 1, [t.num_rows]])
            size = np.cumsum(np.asarray(pc.binary_length(t["text"].cast(pa.binary())).combine_chunks(), np.int64))
            starts, edges, keep = [], [], 0
            for k, (a, z) in enumerate(zip(runs.tolist(), runs[1:].tolist())):
                open_, rest = z == t.num_rows, begun and k == 0
                while True:
                    to = min(a + piece_rows, max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + piece_bytes, "right"))))
                    if to >= z:
                        break
                    starts.append(a)
                    edges.append(True)
                    a, rest = to, True
                if open_:
                    keep, begun = a, rest
                else:
                    starts.append(a)
                    edges.append(rest)
            if starts:
                yield whole_or_piece(t.slice(0, keep), np.array(starts), np.array(edges), part, seq)
                seq += len(starts)
            held = t.slice(keep).combine_chunks()
        if held is not None:
            yield whole_or_piece(held, np.array([0]), np.array([True]), part, seq)

    schema = f"conv_id {kind}, part int, seq int, edge boolean, messages {_MESSAGES}, audit string, blank long, duplicate long, truncated long, illegal long, cost long, gaps long, low long, high long, turns long, codes binary, digests array<binary>"
    return run, schema


# Pieces of one conversation, joined


def _off(col) -> tuple[np.ndarray, np.ndarray]:
    each = col.to_pylist()
    return np.frombuffer(b"".join(each), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


def _settle(batches):
    """Codes with the duplicates of earlier pieces, and what each piece costs from state to state."""
    for b in batches:
        codes = []
        for raw, digests, seen in zip(*(b.column(c).to_pylist() for c in ("codes", "digests", "seen"))):
            code = np.frombuffer(raw, np.uint8).copy()
            if seen:
                seen = set(seen)
                again = np.array([x in seen for x in digests]) & ((code & 3) < DUPLICATE)
                code[again] = (code[again] & 0xFC) | DUPLICATE
            codes.append(code.tobytes())
        codes = pa.array(codes, pa.binary())
        flat, off = _off(codes)
        number = np.repeat(np.arange(b.num_rows), np.diff(off))
        some = np.diff(off) > 0
        ends = [np.where(some, (flat[np.clip(x, 0, len(flat) - 1)] >> 2).astype(np.int64) if len(flat) else 0, -1) for x in (off[:-1], off[1:] - 1)]
        add = {k: pa.array(np.bincount(number[(flat & 3) == f], minlength=b.num_rows)) for k, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
        yield pa.RecordBatch.from_pydict(
            {k: b.column(k) for k in ("conv_id", "part", "seq", "low", "high", "turns")}
            | {"codes": codes, "matrix": pa.array(_matrices(flat, off).reshape(-1, 16).tolist(), pa.list_(pa.int64())), "first": pa.array(ends[0].astype(np.int32)), "final": pa.array(ends[1].astype(np.int32))}
            | add | {"illegal": pa.array(_illegal(flat, number, b.num_rows))}
        )


def _ends(d: pd.DataFrame) -> pd.DataFrame:
    """Costs to go after each piece of one conversation, from the last piece back; its cost, gaps and pairs over borders."""
    d = d.sort_values(["part", "seq"]).reset_index(drop=True)
    n, to_go = len(d), _END
    ends = np.empty((n, 4), np.int64)
    for i in range(n - 1, -1, -1):
        ends[i] = to_go
        to_go = (np.array(d["matrix"][i]).reshape(4, 4) + to_go).min(1)
    wrong, before = np.zeros(n, np.int64), -1
    for i, (a, z) in enumerate(zip(d["first"], d["final"])):
        wrong[i] = before >= 0 and a >= 0 and not _follows(before, a)
        before = z if z >= 0 else before
    has = d["turns"] > 0
    low, high = d["low"][has].to_numpy("int64"), d["high"][has].to_numpy("int64")
    gaps = int(high[-1] - low[0] + 1 - d["turns"].sum() + (low[1:] == high[:-1]).sum()) if len(low) else 0
    return pd.DataFrame(
        {"part": d["part"], "seq": d["seq"], "piece": np.arange(n), "alone": n == 1, "last": np.arange(n) == n - 1, "end": list(ends), "border": wrong, "gaps": np.where(np.arange(n) == 0, gaps, 0), "cost": np.where(np.arange(n) == 0, to_go[0], 0)}
    )


def _exits(batches):
    """The state after each piece, from every state before it."""
    for b in batches:
        flat, off = _off(b.column("codes"))
        end, last = np.array(b.column("end").to_pylist(), np.int64).reshape(-1, 4), np.asarray(b.column("last"))
        to = [Solved(flat, off, end, np.full(b.num_rows, s), last).state for s in range(4)]
        yield pa.RecordBatch.from_pydict({k: b.column(k) for k in ("conv_id", "part", "seq", "piece")} | {"exits": pa.array(np.array(to).T.tolist(), pa.list_(pa.int64()))})


def _entries(d: pd.DataFrame) -> pd.DataFrame:
    d = d.sort_values("piece").reset_index(drop=True)
    at, entry = 0, []
    for to in d["exits"]:
        entry.append(at)
        at = int(to[at])
    return pd.DataFrame({"part": d["part"], "seq": d["seq"], "entry": entry})


def _finish(batches):
    for b in batches:
        flat, off = _off(b.column("codes"))
        end, last = np.array(b.column("end").to_pylist(), np.int64).reshape(-1, 4), np.asarray(b.column("last"))
        s = Solved(flat, off, end, np.array(b.column("entry").to_pylist(), np.int64), last)
        rows = b.column("messages").flatten()
        yield pa.RecordBatch.from_pydict({k: b.column(k) for k in ("conv_id", "piece", "alone", "gaps", *_COUNTS)} | {"audit": pa.array(s.audit, pa.string()), "messages": s.messages(rows.field("role"), rows.field("text"))})


def _join_pieces(edges: DataFrame, kind: str) -> DataFrame:
    key = ["part", "seq"]
    place = F.struct(*key)
    rows = edges.select("conv_id", *key, F.explode(F.array_distinct("digests")).alias("digest"))
    first = F.min(place).over(Window.partitionBy("conv_id", "digest"))
    seen = rows.withColumn("first", first).where(place > F.col("first")).groupBy(*key).agg(F.collect_list("digest").alias("seen"))
    codes = edges.select("conv_id", *key, "low", "high", "turns", "codes", "digests").join(seen, key, "left").mapInArrow(
        _settle, f"conv_id {kind}, part int, seq int, low long, high long, turns long, codes binary, matrix array<long>, first int, final int, blank long, duplicate long, truncated long, illegal long"
    )
    codes = materialise(codes, "conversation-codes")
    heads = codes.select("conv_id", *key, "matrix", "first", "final", "low", "high", "turns")
    ends = heads.groupBy("conv_id").applyInPandas(_ends, "part int, seq int, piece long, alone boolean, last boolean, end array<long>, border long, gaps long, cost long")
    ends = materialise(codes.drop("low", "high", "turns", "matrix", "first", "final").join(ends, key), "conversation-ends")
    exits = ends.mapInArrow(_exits, f"conv_id {kind}, part int, seq int, piece long, exits array<long>")
    entries = exits.groupBy("conv_id").applyInPandas(_entries, "part int, seq int, entry int")
    told = ends.withColumn("illegal", F.col("illegal") + F.col("border")).join(entries, key)
    full = edges.select(*key, "messages").join(told, key)
    return full.mapInArrow(_finish, f"conv_id {kind}, piece long, alone boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, messages {_MESSAGES}")


def repair(rows: DataFrame, piece_rows: int = PIECE, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(conv_id, piece, alone, gaps, blank, duplicate, truncated, illegal, cost, audit, messages array of role and text) of conversations
    given as rows (conv_id, turn, role, text, gone), of which those with `gone` count for nothing but the conversation's existence.

    A conversation is one row unless it has over `piece_rows` rows or `piece_bytes` bytes, or lies over the border of two tasks: then
    it may be several (not `alone`), in order of `piece`, whose counts add up and whose audits and messages follow one another.
    Rows go by turn, nulls first; rows of one turn by the first 64 characters of role and of text, then by a hash. Null roles and
    texts are empty ones, a role is known by its first letter (s, u, a); rows without a conv_id are one conversation.

    Tasks take ranges of (conv_id, turn, ...), so that a conversation of any length is spread. A piece of one is a matrix of costs from
    state to state; these are chained backwards for the costs to go, and the states between pieces follow forwards.
    """
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema["conv_id"].dataType.simpleString()
    d = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("gone", F.lit(False)).alias("gone"), F.monotonically_increasing_id().alias("_n")
    )
    order: list[Column] = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, 64), F.substring("text", 1, 64), F.xxhash64("text"), F.col("_n")]
    run, schema = _pieces(kind, piece_rows, piece_bytes)
    d = d.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone")
    made = materialise(d.mapInArrow(run, schema), "conversations")
    columns = ["conv_id", "piece", "alone", "gaps", *_COUNTS, "audit", "messages"]
    whole = made.where("not edge").withColumns({"piece": F.lit(0).cast("long"), "alone": F.lit(True)}).select(*columns)
    return whole.unionByName(_join_pieces(made.where("edge"), kind).select(*columns))


def _digest(batches):
    """One row a conversation from its pieces in order; the hash goes on from piece to piece."""
    key, now = None, None

    def close():
        counts, audit, h, _ = now
        return pa.RecordBatch.from_pydict({"conv_id": pa.array([key[0]], key[1])} | {k: pa.array([int(v)]) for k, v in counts.items()} | {"audit": pa.array(["".join(audit)]), "repaired_sha256": pa.array([h.hexdigest()])})

    names = ("gaps", *_COUNTS)
    for b in batches:
        kind = b.column("conv_id").type
        for r in b.to_pylist():
            if now is None or (r["conv_id"], kind) != key:
                if now is not None:
                    yield close()
                key, now = (r["conv_id"], kind), ({k: 0 for k in names}, [], hashlib.sha256(), [False])
            counts, audit, h, begun = now
            for k in names:
                counts[k] += r[k]
            audit.append(r["audit"])
            if r["n"]:
                h.update(b"\n" * begun[0] + r["repaired"].encode())
                begun[0] = True
    if now is not None:
        yield close()


def digests(repaired: DataFrame) -> DataFrame:
    """One row a conversation: counts, audit and the hash of its repaired rows `role:text`, joined by newlines.

    Conversations in several pieces are hashed piece after piece; such a one's audit is held by a task, its texts are not.
    """
    columns = ["conv_id", "gaps", *_COUNTS, "audit"]
    kind = repaired.schema["conv_id"].dataType.simpleString()
    text = F.concat_ws("\n", F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])))
    one = repaired.where("alone").select(*columns, F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))
    many = repaired.where("not alone").select(*columns, "piece", F.size("messages").alias("n"), text.alias("repaired")).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return one.unionByName(many.mapInArrow(_digest, f"conv_id {kind}, gaps long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repair(damage(read(spark, sf_dir, "conversations"))))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
SQL: dict[str, str] = {}
