import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from pathlib import Path

import pytest

from genoflux.llm import conversation_repair as m

DATA = Path("/root/testdata/sf0.001/conversations.parquet")
SCHEMA = "conv_id long, turn long, role string, text string, cost int, piece string, audit string, `_k` long, part int, messages string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{name(c)}:{name(t)}".encode()) % 20
        role, text = name(role), name(text)
        if k in (1, 2):
            text = "" if k == 1 else re.sub("[.!?]", "", text)
        out += [(c, t, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def brute(rows):
    """What is asked, one conversation at a time, by plain recursion."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]]
    for r in damaged(rows):
        groups[r[0]].append(r[1:])
    out = {}
    for c, g in groups.items():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, *_ in g if t is not None]
        seen, faults = set(), []
        for _, role, text in g:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        who = [role[:1] for _, role, _ in g]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(who, who[1:]))

        @lru_cache(None)
        def best(i, s, put):
            need = "a" if s == 2 else "u"
            after = 3 if s == 2 else 2
            found = [(0, "", ())] if i == len(g) and s in (0, 3) else []
            if put < 3:
                cost, audit, kept = best(i, after, put + 1)
                found.append((3 + cost, "I" + audit, ((need, None), *kept)))
            if i < len(g):
                cost, audit, kept = best(i + 1, s, 0)
                found.append((4 + cost, "D" + audit, kept))
                if faults[i] in ("", "truncated"):
                    more = 3 * (faults[i] == "truncated")
                    if who[i] == need or (who[i] == "s" and s == 0):
                        cost, audit, kept = best(i + 1, 1 if who[i] == "s" else after, 0)
                        found.append((more + cost, "K" + audit, ((None, i), *kept)))
                    cost, audit, kept = best(i + 1, after, 0)
                    found.append((more + 3 + cost, "R" + audit, ((need, i), *kept)))
            return min(found, key=lambda x: x[:2]) if found else (10**9, "", ())

        for i in range(len(g), -1, -1):  # from the end, so that no recursion is deep
            for state in range(4):
                best(i, state, 0)
        cost, audit, kept = best(0, 0, 0)
        full = {"u": "user", "a": "assistant"}
        lines = [f"{full[r] if r else g[i][1]}:{'' if i is None else g[i][2]}" for r, i in kept]
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
        )
    return out


def frame(spark, rows, n=3):
    return spark.createDataFrame([(*r, 7, "p", "a", 3, 1, "m") for r in rows], SCHEMA).repartition(n)


def got(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def random_rows(seed, n=150, most=14):
    rng = random.Random(seed)
    texts = ["Hello there.", "So what?", "no end", " \t\n", "", "Fine!  \r", "é中.", "same.", None, "a:b\nc.", " . x"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "Assistant", "ubot"]
    out = []
    for c in [*range(n), None]:
        for t in range(rng.randint(1, most)):
            out.append((c, None if rng.random() < 0.07 else rng.choice([t, t * 2, -t]), rng.choice(roles[: rng.choice([2, 5, 10])]), rng.choice(texts)))
            if rng.random() < 0.1:
                out.append(out[-1])
    return out


@pytest.mark.parametrize("seed,rows,size", [(1, m.PIECE, m.PIECE_BYTES), (2, 3, m.PIECE_BYTES), (3, 1, m.PIECE_BYTES), (4, m.PIECE, 20)])
def test_random_conversations(spark, seed, rows, size):
    given = random_rows(seed)
    made = m.repair(m.damage(frame(spark, given)), rows, size)
    assert got(m.digests(made)) == brute(given)


def test_long_conversation_in_many_tasks(spark):
    rng = random.Random(5)
    given = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["yes.", "no", "maybe?", f"number {t}.", f"open {t}"])) for t in range(1300)]
    given += [(8, None, "user", "Equal rows."), *[(9, 1, "user", "Equal rows.")] * 700, (10, 0, "user", "Hi."), (10, 1, "assistant", "Hi.")]
    made = m.repair(m.damage(frame(spark, given, 5)), 10)
    pieces = made.where("conv_id = 7").collect()
    assert len(pieces) > 100 and max(len(r.messages) for r in pieces) < 32 and sum(r.cost for r in pieces) == sum(r.cost for r in made.where("conv_id = 7 and piece = 0").collect())
    assert got(m.digests(made)) == brute(given)


def test_nothing_left_and_nothing_given(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(m.digests(m.repair(m.damage(frame(spark, [(gone, 0, "user", "Hi.")]))))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert m.digests(m.repair(m.damage(frame(spark, [])))).count() == 0


def test_given_conversations(spark):
    if not DATA.exists():
        pytest.skip("no tables here")
    rows = [tuple(r) for r in spark.read.parquet(str(DATA)).select("conv_id", "turn", "role", "text").collect()]
    assert got(m.op11_conversation_repair(spark, str(DATA.parent))) == brute(rows)


def test_repaired_messages(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "What?"), (1, 2, "user", "  "), (1, 3, "assistant", "cut")]
    d = spark.createDataFrame([(*r, False) for r in rows], "conv_id long, turn long, role string, text string, gone boolean")
    pieces = m.repair(d).orderBy("piece").collect()
    assert "".join(r.audit for r in pieces) == "IKKDK" and sum(r.cost for r in pieces) == 10
    assert [tuple(x) for r in pieces for x in r.messages] == [("user", ""), ("assistant", "Hi."), ("user", "What?"), ("assistant", "cut")]
