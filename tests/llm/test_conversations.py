"""Conversation repair: the run-length DP against enumeration of all edit strings, end to end against plain Python."""
import hashlib
import itertools
import random
import re
import zlib

import pytest

from fleetpulse.llm import conversation_repair as cr

TINY = "/root/testdata/sf0.001"


def enumerate_best(roles, faults, max_inserts=3):
    """The cheapest, then ASCII-least, edit string among all strings with up to `max_inserts` inserts."""
    n, best = len(roles), None
    for size in range(n, n + max_inserts + 1):
        for word in itertools.product("DIKR", repeat=size):
            if word.count("I") != size - n:
                continue
            state, i, cost, ok, lines = 0, 0, 0, True, []
            for ch in word:
                if ch == "I":
                    state = cr._insert_to(state)
                    cost += cr.INSERT
                    lines.append((state, -1, ch))
                    continue
                moves = {m[0]: m for m in cr._row_moves(roles[i], faults[i], state)} if i < n else {}
                if ch not in moves:
                    ok = False
                    break
                cost, state = cost + moves[ch][1], moves[ch][2]
                if ch != "D":
                    lines.append((state, i, ch))
                i += 1
            if ok and i == n and state in cr.ACCEPT and (best is None or (cost, "".join(word)) < best[:2]):
                best = (cost, "".join(word), lines)
    return best


def test_dp_equals_enumeration():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randint(0, 5)
        roles = [rng.choice([0, 1, 2, 3, 1, 2]) for _ in range(n)]
        faults = [rng.choice([0, 0, 1, 2, 3]) for _ in range(n)]
        if n > 2 and rng.random() < 0.5:   # runs of equal symbols
            roles[1:3], faults[1:3] = [roles[1]] * 2, [faults[1]] * 2
        cost, audit, _ = cr.repair(roles, faults)
        assert (cost, audit) == enumerate_best(roles, faults)[:2]


def test_long_runs_use_powers():
    """Runs of thousands of rows: the cost is what the unrolled audit spends."""
    roles, faults = [1] * 3000 + [2] * 5 + [0] * 2000, [0] * 3000 + [3] * 5 + [0] * 2000
    cost, audit, _ = cr.repair(roles, faults)
    spent = audit.count("D") * 2 + audit.count("I") * 5 + audit.count("R") * 1
    assert len(audit) >= len(roles) and cost == spent + 5 * sum(1 for f, a in zip(faults, [c for c in audit if c != "I"]) if f == 3 and a != "D")


def python_repair(rows):
    """Damage, order, faults and counts in plain Python; edits by enumeration."""
    out = {}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, [])
        key = f"{conv if conv is not None else ' '}:{turn if turn is not None else ' '}".encode()
        d = zlib.crc32(key) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if d == 0:
            continue
        text = "" if d == 1 else re.sub(r"[.!?]", "", text) if d == 2 else text
        role = "user" if d == 4 else role
        by_conv[conv] += [(turn, role, text)] * (2 if d == 3 else 1)
    for conv, got in by_conv.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1], r[2]))
        roles, texts = [r[1] for r in got], [r[2] for r in got]
        faults = cr._faults(roles, texts)
        turns = {r[0] for r in got if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(1 for a, b in zip(roles, roles[1:]) if a[:1] + b[:1] not in ("su", "ua", "au"))
        if len(got) > 6:
            out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, None, None, None)
            continue
        cost, audit, lines = enumerate_best([cr.ROLE_CLASS.get(r[:1], 3) for r in roles], faults) if got else (0, "", [])
        text = "\n".join(f"{cr.ROLE_NAME[s]}:" if i < 0 else f"{roles[i] if ch == 'K' else cr.ROLE_NAME[s]}:{texts[i]}" for s, i, ch in lines)
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def compare(df, rows):
    want = python_repair(rows)
    got = {r.conv_id: tuple(r)[1:] for r in df.collect()}
    assert set(got) == set(want)
    for conv, values in want.items():
        n = len([v for v in values if v is not None])
        assert got[conv][:n] == values[:n] if values[5] is None else got[conv] == values, conv


def test_tiny_table(spark):
    conv = spark.read.parquet(f"{TINY}/conversations.parquet")
    compare(cr.repair_conversations(conv), [tuple(r) for r in conv.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", None), (1, 1, "user", None), (1, None, "assistant", "Hi"),
            (2, 3, None, "  \n"), (2, 5, "tool", "x" * 100_000), (None, 0, "user", "who?"), (None, None, None, None),
            (3, 0, "user", "q."), (3, 1, "user", "q."), (3, 2, "assistant", "a!"), (3, 2, "assistant", "a!")]
    names = "conv_id long, turn long, role string, text string, c string, audit string"
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], names)
    out = cr.repair_conversations(df)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    compare(out, rows)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair_conversations(df).count() == 0
