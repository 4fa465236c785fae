"""Repair of conversation structure: the cheapest edits after which roles follow the grammar (s?(ua)+)?.

Turns are dealt by conversation and sorted; each batch of a partition goes to a recursive DuckDB query whose every step takes one more turn
of all conversations in it, and keeps the least cost and then the least audit for each state of the grammar. What a batch leaves open
(only its last conversation, by the order) goes on in the next one: up to four states with their costs, that part of their audits in which
they differ, and a running SHA-256 of what each has put out. So memory is bounded by a batch however long a conversation is;
one conversation is one task's rows, as its hash can only be taken in order.

Edits, a letter each: Keep (0), Rerole to user or assistant (3), Delete (4; must be for blank and duplicate turns), Insert an empty
turn (3); a truncated turn that stays costs 3 more. Which role R and I give follows from the grammar: assistant after a user, else user.

Results in special cases: nulls count as one space (a null turn sorts first, a null conv_id is a conversation of its own); turns with
one number go by role, then text; repeated rows are duplicates; a role's initial is its first character, an empty role has none; an empty
or null text is blank; a long text is held whole in its batch; a conversation of which nothing is left has zeros, an empty audit
and the hash of nothing; an empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation that one recursion takes; a longer one goes on from its states.
DEPTH = 256
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
NONE, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def given(state: int) -> int:
    """The state after an inserted or re-roled turn."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: str) -> int | None:
    """The state after a kept turn; None where the grammar doesn't take it."""
    if initial == "s":
        return SYSTEM if state == NONE else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def moves() -> list[tuple[int, str, int, int, str]]:
    """(state, turn's initial and kind, next state, cost, letters): kind d must go, t is truncated, k is neither. Before a turn at most one
    insertion can help: two lead back."""
    out = []
    for state in range(4):
        for initial in "suax":
            for kind in "dtk":
                for before, cost, letters in ((state, 0, ""), (given(state), INSERT, "I")):
                    out.append((state, initial + kind, before, cost + DELETE, letters + "D"))
                    if kind != "d":
                        more = cost + (CUT if kind == "t" else 0)
                        out.append((state, initial + kind, given(before), more + REROLE, letters + "R"))
                        if (after := kept(before, initial)) is not None:
                            out.append((state, initial + kind, after, more, letters + "K"))
    return out


STEPS = f"""
WITH RECURSIVE moves(state, turn, next, cost, letters) AS (VALUES {", ".join(map(str, moves()))}),
best(conv, state, i, cost, audit, origin) USING KEY (conv, state) AS (
    SELECT conv, state, 0::BIGINT, cost, audit, state FROM begun
    UNION
    SELECT conv, next, i + 1, m.cost, m.audit, m.origin FROM (
        SELECT b.conv, m.next, b.i, min({{'cost': b.cost + m.cost, 'audit': b.audit || m.letters, 'origin': b.origin}}) AS m
        FROM best b JOIN turns t ON t.conv = b.conv AND t.i = b.i JOIN moves m ON m.state = b.state AND m.turn = t.turn
        GROUP BY b.conv, m.next, b.i
    )
)
SELECT conv, state, cost, audit, origin FROM best JOIN (SELECT conv, count(*) AS n FROM turns GROUP BY conv) USING (conv) WHERE i = n
"""
#: What ends a conversation in each state, and its cost.
ENDS = {NONE: ("", 0), SYSTEM: ("II", 2 * INSERT), USER: ("I", INSERT), ASSISTANT: ("", 0)}


class Output:
    """What a way through the grammar has put out: its state and a running hash of role:text lines."""

    def __init__(self, state: int = NONE, sha=None):
        self.state, self.sha = state, sha or hashlib.sha256()

    def copy(self) -> Output:
        return Output(self.state, self.sha.copy())

    def line(self, role: str, text: str, state: int) -> None:
        self.sha.update(("\n" if self.state != NONE else "").encode() + f"{role}:{text}".encode())
        self.state = state

    def follow(self, letters: str, turns: Iterator[tuple[str, str]]) -> Output:
        for x in letters:
            role, text = ("", "") if x == "I" else next(turns)
            if x == "K":
                self.line(role, text, kept(self.state, role[:1]))
            elif x != "D":
                after = given(self.state)
                self.line("assistant" if after == ASSISTANT else "user", text, after)
        return self


@dataclass
class Conversation:
    """A conversation that is being read: its counts, and cost, audit and output for each state. done: where all audits begin alike."""

    key: object
    ways: dict[int, tuple[int, str, Output]] = field(default_factory=lambda: {NONE: (0, "", Output())})
    done: list[str] = field(default_factory=list)
    faults: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    role: str | None = None
    turns: tuple[int, int, int] | None = None
    waiting: list[tuple[str, str, str]] = field(default_factory=list)

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = role
        if turn is not None:
            lo, hi, n = self.turns or (turn, turn, 1)
            self.turns = (lo, turn, n + (turn != hi))
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        self.waiting.append((initial + ("t" if fault == TRUNCATED else "d" if fault else "k"), role, text))

    def advance(self, found: list[tuple[int, int, str, int]], taken: list[tuple[str, str, str]]) -> None:
        """found: (state, cost, audit, origin) after the turns taken."""
        ways = {}
        for state, cost, audit, origin in found:
            _, before, output = self.ways[origin]
            ways[state] = (cost, audit, output.copy().follow(audit[len(before) :], ((r, t) for _, r, t in taken)))
        first, last = min(a for _, a, _ in ways.values()), max(a for _, a, _ in ways.values())
        same = next((i for i, (x, y) in enumerate(zip(first, last)) if x != y), min(len(first), len(last)))
        self.done.append(first[:same])
        self.ways = {s: (c, a[same:], o) for s, (c, a, o) in ways.items()}

    def result(self) -> tuple:
        cost, audit, state = min((c + ENDS[s][1], a + ENDS[s][0], s) for s, (c, a, _) in self.ways.items())
        output = self.ways[state][2].follow(ENDS[state][0], iter(()))
        lo, hi, n = self.turns or (0, -1, 0)
        return self.key, hi - lo + 1 - n, *self.faults[1:], self.illegal, cost, "".join(self.done) + audit, output.sha.hexdigest()


def settle(db: duckdb.DuckDBPyConnection, open_: list[Conversation]) -> None:
    """Takes all waiting turns of all conversations, DEPTH of each at a time."""
    while any(c.waiting for c in open_):
        now = [(i, c, c.waiting[:DEPTH]) for i, c in enumerate(open_) if c.waiting]
        rows = [(i, j, t[0]) for i, _, taken in now for j, t in enumerate(taken)]
        ways = [(i, s, cost, audit) for i, c, _ in now for s, (cost, audit, _) in c.ways.items()]
        conv, at, turn = zip(*rows)
        db.register("turns", pa.table({"conv": pa.array(conv, pa.int64()), "i": pa.array(at, pa.int64()), "turn": pa.array(turn)}))
        conv, state, cost, audit = zip(*ways)
        db.register("begun", pa.table({"conv": pa.array(conv, pa.int64()), "state": pa.array(state, pa.int32()), "cost": pa.array(cost, pa.int64()), "audit": pa.array(audit)}))
        found: dict[int, list] = {}
        for i, *way in db.execute(STEPS).fetchall():
            found.setdefault(i, []).append(way)
        for i, c, taken in now:
            c.advance(found[i], taken)
            c.waiting = c.waiting[DEPTH:]


def judged(rows: DataFrame, key: str, turn: str, role: str, text: str, gone: Column | None = None) -> DataFrame:
    """key, gone, turn, role, text, copy, fault of the turns, dealt by key and in order. gone: turns that only name their conversation."""
    word = r"[^\x20\x09-\x0D]"
    rows = rows.select(F.col(key).alias("key"), F.coalesce(gone if gone is not None else F.lit(False), F.lit(False)).alias("gone"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    rows = rows.repartition("key")
    same = Window.partitionBy("key", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("copy", F.row_number().over(same))
    fault = F.when(~F.col("text").rlike(word), BLANK).when(F.col("copy") > 1, DUPLICATE).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(0)
    return rows.withColumn("fault", fault).sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text", "copy")


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """key and gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db, last = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}), None
        names = [key, *(c.split()[0] for c in SUMMARY.split(", "))]

        def out(done: list[Conversation], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*[c.result() for c in done]))
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        kind = None
        for b in batches:
            kind = b["key"].type
            open_ = [last] if last else []
            for k, is_gone, *fields in zip(*(b[c].to_pylist() for c in ("key", "gone", "turn", "role", "text", "fault"))):
                if not open_ or open_[-1].key != k:
                    open_.append(Conversation(k))
                if not is_gone:
                    open_[-1].add(*fields)
            settle(db, open_)
            if len(open_) > 1:
                yield out(open_[:-1], kind)
            last = open_[-1] if open_ else None
        if last:
            yield out([last], kind)

    name = rows.select(key).schema[0].dataType.simpleString()
    return judged(rows, key, turn, role, text, gone).select("key", "gone", "turn", "role", "text", "fault").mapInArrow(step, f"`{key}` {name}, {SUMMARY}")


def repaired_turns(rows: DataFrame, repairs: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, place (from 0), role, text, edit (K, R or I): the repaired conversations of rows, by the audits of repairs (of the same rows)."""
    order = Window.partitionBy("key").orderBy(F.asc_nulls_first("turn"), "role", "text", "copy")
    turns = judged(rows, key, turn, role, text).withColumn("i", F.row_number().over(order)).select("key", "i", "role", "text")
    # an insertion goes with the turn behind it; those at the end stand by themselves
    parts = repairs.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all("audit", F.lit("I*[KRD]|I+"), F.lit(0))).alias("i", "letters"))
    met = parts.alias("p").join(turns.alias("t"), F.col("p.key").eqNullSafe(F.col("t.key")) & (F.col("p.i") + 1 == F.col("t.i")), "left")
    letter = F.posexplode(F.split("letters", "")).alias("j", "edit")
    lines = met.select(F.col("p.key").alias("key"), F.col("p.i").alias("i"), F.col("t.role").alias("role"), F.col("t.text").alias("text"), "letters").select("key", "i", "role", "text", letter).where("edit in ('K', 'R', 'I')")
    place = F.row_number().over(Window.partitionBy("key").orderBy("i", "j")) - 1
    lines = lines.withColumn("place", place)
    # users and assistants take turns, behind a system line or without one
    shift = F.max(F.when((F.col("place") == 0) & (F.col("edit") == "K") & F.startswith("role", F.lit("s")), 1).otherwise(0)).over(Window.partitionBy("key"))
    role_ = F.when(F.col("edit") == "K", F.col("role")).when((F.col("place") - shift) % 2 == 0, "user").otherwise("assistant")
    return lines.select(F.col("key").alias(key), "place", role_.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "edit")


def damaged(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults put in by crc32 of conv_id:turn, and `gone` where a turn is dropped."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).cast("int")
    rows = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 3, 1).otherwise(0))).alias("twice")
    gone = F.col("kind") == 0
    return rows.select("conv_id", "turn", role.alias("role"), F.when(gone, "").otherwise(text).alias("text"), gone.alias("gone"), twice).drop("twice")
