"""Conversation repair against a search from the end, on random conversations and on long ones that span batches and recursions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from seedlake.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, fault int, copy string, key int"


def solve(rows):
    """The summary of one conversation's rows (turn, role, text), and its repaired lines."""
    blanks = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows = sorted(blanks, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    faults, seen = [], set()
    for _, r, x in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", x)
        faults.append("blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((r, x))

    @cache
    def rest(i, out, free=2):
        """(cost, audit, lines) from row i on, when `out` is the last initial put out; at most `free` insertions come next."""
        new = "assistant" if out == "u" else "user"
        ways = [edit(i, out)] if i < len(rows) else [(0, "", ())] if out in ("", "a") else []
        if free:
            c, a, lines = rest(i, new[0], free - 1)
            ways.append((c + 3, "I" + a, (f"{new}:", *lines)))
        return min(ways, default=(10**9, "", ()))

    @cache
    def edit(i, out):
        (_, r, x), fault = rows[i], faults[i]
        new = "assistant" if out == "u" else "user"
        c, a, lines = rest(i + 1, out)
        ways = [(c + 4, "D" + a, lines)]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault else 0
            c, a, lines = rest(i + 1, new[0])
            ways.append((c + 3 + more, "R" + a, (f"{new}:{x}", *lines)))
            if r[:1] == "s" and out == "" or r[:1] == "u" and out in ("", "s", "a") or r[:1] == "a" and out == "u":
                c, a, lines = rest(i + 1, r[0])
                ways.append((c + more, "K" + a, (f"{r}:{x}", *lines)))
        return min(ways)

    cost, audit, lines = rest(0, "")
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def some(rnd, n):
    texts = ["Yes.", "No!", "why", "Oh\n", " ", "", None, "Well? \n", "A. b", "äö."]
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "tool", "", None, "ua"]
    return [(rnd.choice([None, i, i, i, i // 2]), rnd.choice(roles), rnd.choice(texts[:5] if rnd.random() < 0.5 else texts)) for i in range(n)]


def table(spark, talks):
    rows = [(k, t, r, x, 7, "c", 3) for k, rows in talks.items() for t, r, x in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def results(found):
    return {r[0]: tuple(r)[1:] for r in found.collect()}


def test_random(spark):
    rnd = random.Random(2)
    talks = {k: some(rnd, rnd.randrange(1, 9)) for k in range(400)} | {None: some(rnd, 5)}
    rows = table(spark, talks)
    found = turns.repair(rows)
    assert results(found) == {k: solve(v)[0] for k, v in talks.items()}
    lines = {k: [] for k in talks}
    for r in turns.repaired_turns(rows, found).orderBy("place").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert lines == {k: list(solve(v)[1]) for k, v in talks.items()}


def test_long(spark, monkeypatch):
    """Conversations over several recursions and Arrow batches: states, audits and hashes go on."""
    monkeypatch.setattr(turns, "DEPTH", 16)
    rnd = random.Random(3)
    talks = {k: some(rnd, 150) for k in range(3)} | {9: [(i, "user", f"{i}.") for i in range(90)], 10: [(i, "tool", "x") for i in range(70)]}
    talks[11] = [(0, "user", "long " * 100_000 + "."), (1, "assistant", "short.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert results(turns.repair(table(spark, talks))) == {k: solve(v)[0] for k, v in talks.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_damage_and_empty(spark):
    rnd = random.Random(5)
    talks = {k: [(i, ("user", "assistant")[i % 2], f"{k} {i}! Yes.") for i in range(rnd.randrange(1, 4))] for k in range(300)}
    want = {}
    for k, rows in talks.items():
        left = []
        for t, r, x in rows:
            kind = zlib.crc32(f"{k}:{t}".encode()) % 20
            if kind:
                x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
                left += [(t, "user" if kind == 4 else r, x)] * (1 + (kind == 3))
        want[k] = solve(left)[0]
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want.values()  # some lose all turns
    hurt = turns.damaged(table(spark, talks))
    assert results(turns.repair(hurt, gone=F.col("gone"))) == want
    assert turns.repair(table(spark, {1: []})).count() == 0


@pytest.mark.parametrize("state", range(4))
def test_moves_are_one_way(state):
    """A state, a turn and letters lead to one state and one cost, so equal audits mean equal repairs."""
    seen = {}
    for s, turn, after, cost, letters in turns.moves():
        if s == state:
            assert seen.setdefault((turn, letters), (after, cost)) == (after, cost)
