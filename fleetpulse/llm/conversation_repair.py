"""Conversation structure repair: the cheapest edits that give role initials `(s?(ua)+)?`, by a run-length min-plus DP.

A conversation is a sequence of rows; each row is a symbol (role initial class s/u/a/other, fault none/blank/duplicate/
truncated). The grammar is an automaton with states 0 (nothing yet), 1 (after s), 2 (after u), 3 (after a); 0 and 3
accept. A row moves the state by one of: Delete (2, the state stays; the only edit of a blank or duplicate row), Keep
(0; s from 0, u from 0/1/3, a from 2), Rerole (1; to u from 0/1/3, to a from 2, if the role differs). Truncated rows
that stay add 5. Before any row and at the end, empty rows can be inserted (5; u from 0/1/3, a from 2).

Each symbol is a 4×4 min-plus matrix T (insert closure, then the row). Equal consecutive symbols are collapsed into
runs; a run of length k costs T^k, taken from binary powers of T cached per symbol. The backward pass over runs gives
the optimal cost of every state at every run border; the audit is then unrolled row by row inside the runs, taking at
each step the ASCII-least letter (D < I < K < R; ending before any letter) that keeps the optimum, which gives the
ASCII-least audit among the cheapest ones.

Spark: damage and the narrow columns are DataFrame functions; a conversation is one group of `applyInPandas`
(its rows are ordered and read once, the DP holds a few numbers per run).
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INF = float("inf")
# fixed values of the contract
DELETE, REROLE, INSERT, TRUNCATED, KEEP = 2, 1, 5, 5, 0
ACCEPT = (0, 3)
_SOLID = re.compile(r"[^\x20\x09-\x0d]")
_ENDS = re.compile(r"[.!?][\x20\x09-\x0d]*\Z")

NONE, BLANK, DUPLICATE, TRUNC = 0, 1, 2, 3
ROLE_CLASS = {"s": 0, "u": 1, "a": 2}   # anything else: 3


def _insert_to(state: int) -> int:
    return 3 if state == 2 else 2


def _row_moves(role: int, fault: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of one row from `state`, in ASCII order of the letters."""
    moves = [("D", DELETE, state)]
    if fault in (BLANK, DUPLICATE):
        return moves
    extra = TRUNCATED if fault == TRUNC else 0
    if role == 0 and state == 0:
        moves.append(("K", KEEP + extra, 1))
    elif role == 1 and state in (0, 1, 3):
        moves.append(("K", KEEP + extra, 2))
    elif role == 2 and state == 2:
        moves.append(("K", KEEP + extra, 3))
    target = 3 if state == 2 else 2          # the one role a rerole may give here
    if (target == 2 and role != 1) or (target == 3 and role != 2):
        moves.append(("R", REROLE + extra, target))
    return moves


def _closure() -> list[list[float]]:
    """Cheapest insert sequences between states (min-plus closure of one insert)."""
    c = [[0.0 if i == j else INF for j in range(4)] for i in range(4)]
    for _ in range(4):
        for i in range(4):
            for j in range(4):
                if c[i][j] < INF:
                    k = _insert_to(j)
                    c[i][k] = min(c[i][k], c[i][j] + INSERT)
    return c


CLOSURE = _closure()


def _matrix(role: int, fault: int) -> list[list[float]]:
    row = [[INF] * 4 for _ in range(4)]
    for x in range(4):
        for _, cost, y in _row_moves(role, fault, x):
            row[x][y] = min(row[x][y], cost)
    return _mul(CLOSURE, row)


def _mul(a, b):
    return [[min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)] for i in range(4)]


def _apply(m, v):
    return [min(m[i][k] + v[k] for k in range(4)) for i in range(4)]


class _Powers:
    """T, T², T⁴ … per symbol, made once and shared by all runs of the symbol."""

    def __init__(self):
        self.cache: dict[tuple[int, int], list] = {}

    def advance(self, symbol: tuple[int, int], k: int, v: list[float]) -> list[float]:
        """T^k ⊗ v."""
        powers = self.cache.setdefault(symbol, [_matrix(*symbol)])
        bit = 0
        while k:
            if bit == len(powers):
                powers.append(_mul(powers[-1], powers[-1]))
            if k & 1:
                v = _apply(powers[bit], v)
            k >>= 1
            bit += 1
        return v


def repair(roles: list[int], faults: list[int], powers: _Powers | None = None) -> tuple[int, str, list[tuple[str, int]]]:
    """(cost, audit, repaired rows) of one conversation; repaired rows are (letter, state after) of kept, reroled and
    inserted rows in order, with the index of the original row (-1 for an insert)."""
    powers = powers or _Powers()
    n = len(roles)
    runs = []                                   # (start, length, symbol)
    for i in range(n):
        if runs and runs[-1][2] == (roles[i], faults[i]):
            runs[-1][1] += 1
        else:
            runs.append([i, 1, (roles[i], faults[i])])
    end = _apply(CLOSURE, [0.0 if s in ACCEPT else INF for s in range(4)])
    borders = [end]                             # cost to go before each run, from the last run back
    for start, length, symbol in reversed(runs):
        borders.append(powers.advance(symbol, length, borders[-1]))
    borders.reverse()
    total = borders[0][0]
    audit: list[str] = []
    out: list[tuple[str, int, int]] = []
    state = 0
    for r, (start, length, symbol) in enumerate(runs):
        inside = [borders[r + 1]]               # unroll: cost to go before each row of the run, from the end back
        row_matrix = powers.cache[symbol][0]
        for _ in range(length):
            inside.append(_apply(row_matrix, inside[-1]))
        inside.reverse()
        for j in range(length):
            state = _step(state, symbol, inside[j], inside[j + 1], audit, out, start + j)
    while state not in ACCEPT or borders[-1][state] > 0:         # inserts at the end, if any
        nxt = _insert_to(state)
        audit.append("I")
        out.append(("I", nxt, -1))
        state = nxt
    return int(total), "".join(audit), out


def _step(state, symbol, here, after, audit, out, index):
    """One row from `state`: inserts first if the ASCII order and the optimum ask for them, then the row's letter."""
    while True:
        goal = here[state]
        row = [(letter, cost, y) for letter, cost, y in _row_moves(*symbol, state) if cost + after[y] == goal]
        row_letters = {m[0] for m in row}
        insert_ok = INSERT + here[_insert_to(state)] == goal
        if "D" in row_letters:
            audit.append("D")
            return state
        if insert_ok:
            state = _insert_to(state)
            audit.append("I")
            out.append(("I", state, -1))
            continue
        letter, _, y = min(row)
        audit.append(letter)
        out.append((letter, y, index))
        return y


def _faults(roles: list[str], texts: list[str]) -> list[int]:
    seen: set[tuple[str, str]] = set()
    faults = []
    for role, text in zip(roles, texts):
        if not _SOLID.search(text):
            faults.append(BLANK)
        elif (role, text) in seen:
            faults.append(DUPLICATE)
        elif not _ENDS.search(text):
            faults.append(TRUNC)
        else:
            faults.append(NONE)
        seen.add((role, text))
    return faults


ROLE_NAME = {1: "system", 2: "user", 3: "assistant"}          # by the state a row leads to


def _conversation(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["turn_null", "turn", "role", "text"], ascending=[False, True, True, True], kind="stable")
    roles, texts = group["role"].tolist(), group["text"].tolist()
    faults = _faults(roles, texts)
    classes = [ROLE_CLASS.get(r[:1], 3) for r in roles]
    cost, audit, out = repair(classes, faults)
    lines = []
    for letter, state, index in out:
        if letter == "I":
            lines.append(f"{ROLE_NAME[state]}:")
        elif letter == "K":
            lines.append(f"{roles[index]}:{texts[index]}")
        else:
            lines.append(f"{ROLE_NAME[state]}:{texts[index]}")
    initials = [r[:1] for r in roles]
    illegal = sum(1 for a, b in zip(initials, initials[1:]) if a + b not in ("su", "ua", "au"))
    turns = group.loc[~group["turn_null"], "turn"]
    gaps = int(turns.max() - turns.min() + 1 - turns.nunique()) if len(turns) else 0
    return pd.DataFrame({
        "conv_id": [group["conv_id"].iloc[0]], "gaps": [gaps], "blank": [faults.count(BLANK)],
        "duplicate": [faults.count(DUPLICATE)], "truncated": [faults.count(TRUNC)], "illegal": [illegal], "cost": [cost],
        "audit": [audit], "repaired_sha256": [hashlib.sha256("\n".join(lines).encode()).hexdigest()]})


SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by crc32(`conv_id:turn`) % 20 (a null in the key, role or text reads as one space):
    0 drops the row, 1 empties the text, 2 removes its `.`, `!` and `?`, 3 repeats the row (same turn), 4 sets role user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
                                (F.crc32(key.cast("binary")) % 20).alias("damage"))
    rows = rows.where("damage <> 0").select(
        "conv_id", "turn",
        F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", ""))
         .otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per original conv_id (null included): gaps, fault counts, illegal adjacent pairs, cost, audit and the
    sha256 of the repaired `role:text` lines.

    Rows are ordered by turn (nulls first), then role and text, so repeated rows are adjacent. A conversation with no
    rows left after damage gives zeros, an empty audit and the sha256 of the empty string. Empty texts, very long texts,
    ties and extra columns of any name are fine; only conv_id, turn, role and text are read.
    """
    rows = damaged(conversations).withColumn("turn_null", F.col("turn").isNull())
    done = rows.groupBy("conv_id").applyInPandas(_conversation, SCHEMA).withColumnRenamed("conv_id", "c")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    empty = hashlib.sha256(b"").hexdigest()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(done, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce(F.col("audit"), F.lit("")).alias("audit"), F.coalesce(F.col("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))
