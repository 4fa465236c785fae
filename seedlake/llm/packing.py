"""Best-fit packing of token sequences by linear grouping.

Only a histogram (length -> pieces, at most `capacity` rows) reaches the driver, so the plan costs the same for any number of
documents. Large lengths are cut into groups of equal cardinality and rounded up to the largest of their group; for these few
sizes the best configurations of a sequence come from a linear programme (column generation). Each configuration is then
filled with actual lengths of its groups, and small pieces go, largest first, to the fullest sequence that still takes them.
Sequences that look alike are kept as one run with a count, and a piece finds its place from its rank within its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import library_coder
from .common import durable, slices, utf8

#: Rows of the plan that may be broadcast; a larger plan is joined by a shuffle.
PLAN_ROWS = 200_000


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within capacity that is worth most (unbounded knapsack by dynamic programming)."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        got = worth[c - sizes[fits]] + values[fits]
        k = int(got.argmax())
        worth[c], last[c] = (got[k], fits[k]) if got[k] > worth[c - 1] + 1e-12 else (worth[c - 1], -1)
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(worth[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (how many of each size) and how often to use each: the rounded-down optimum of the linear programme."""
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)  # a column is a pattern
    use = demand / (capacity // sizes)
    for _ in range(40 * n + 200):
        inverse = np.linalg.inv(basis)
        prices = inverse.sum(axis=0)
        worth, pattern = best_pattern(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        way = inverse @ pattern
        up = way > 1e-9
        ratio = np.where(up, use / np.where(up, way, 1), np.inf)
        out = int(ratio.argmin())
        use = np.maximum(use - ratio[out] * way, 0)
        basis[:, out], use[out] = pattern, ratio[out]
    return [(basis[:, k].astype(np.int64), int(use[k] + 1e-6)) for k in range(n) if use[k] + 1e-6 >= 1]


class _Stock:
    """Lengths of one group, longest first, taken in runs."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows

    def take(self, n: int) -> list[tuple[int, int]]:
        got = []
        while n and self.rows:
            length, have = self.rows[0]
            k = min(n, have)
            got.append((length, k))
            n -= k
            if k == have:
                self.rows.pop(0)
            else:
                self.rows[0][1] -= k
        return got


def plan(histogram: dict[int, int], capacity: int = 1024, groups: int = 48, smalls: tuple[float, ...] = (1 / 2, 1 / 4)) -> list[tuple[list[int], int]]:
    """Runs of sequences: (the lengths in one sequence, how many such sequences). Uses every piece of the histogram once. Of the limits between large and small (shares of the capacity), the one that needs fewest sequences."""
    return min((plan_at(histogram, capacity, groups, s) for s in smalls), key=lambda runs: sum(n for _, n in runs))


def plan_at(histogram: dict[int, int], capacity: int, groups: int, small: float) -> list[tuple[list[int], int]]:
    runs: list[tuple[list[int], int]] = []
    if n := histogram.get(capacity, 0):
        runs.append(([capacity], n))
    large = [[x, c] for x, c in sorted(histogram.items(), reverse=True) if small * capacity < x < capacity and c > 0]
    rest = {x: c for x, c in histogram.items() if 0 < x <= small * capacity and x < capacity and c > 0}
    if large:
        each = -(-sum(c for _, c in large) // groups)
        sizes, stocks, held = [], [], 0
        for x, c in large:
            while c:
                if held == 0:
                    sizes.append(x)
                    stocks.append([])
                k = min(c, each - held)
                stocks[-1].append([x, k])
                c, held = c - k, (held + k) % each
        merged: dict[int, list[list[int]]] = {}
        for x, s in zip(sizes, stocks):  # groups that round up to one size are one
            merged.setdefault(x, []).extend(s)
        sizes, stock = np.array([*merged]), [_Stock(s) for s in merged.values()]
        demand = np.array([sum(c for _, c in s) for s in merged.values()], float)
        for pattern, times in configurations(sizes, demand, capacity):
            slots = [k for k in range(len(sizes)) for _ in range(pattern[k])]
            left = np.array([sum(c for _, c in s.rows) for s in stock])
            times = min([times, *(int(left[k] // pattern[k]) for k in set(slots))])
            if not times or not slots:
                continue
            columns = [stock[k].take(times) for k in slots]
            while columns[0]:
                n = min(c[0][1] for c in columns)
                runs.append(([c[0][0] for c in columns], n))
                columns = [[(c[0][0], c[0][1] - n), *c[1:]] if c[0][1] > n else c[1:] for c in columns]
        for s in stock:
            for x, c in s.rows:
                rest[x] = rest.get(x, 0) + c
    open_: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for lengths, n in runs:
        open_[capacity - sum(lengths)].append((lengths, n))
    for x in sorted(rest, reverse=True):
        c = rest[x]
        while c:
            room = min((r for r in open_ if r >= x), default=None)
            if room is None:
                m = capacity // x
                if c // m:
                    open_[capacity - m * x].append(([x] * m, c // m))
                if c % m:
                    open_[capacity - c % m * x].append(([x] * (c % m), 1))
                break
            lengths, n = open_[room].pop()
            k = min(c, n)
            if k < n:
                open_[room].append((lengths, n - k))
            if not open_[room]:
                del open_[room]
            open_[room - x].append(([*lengths, x], k))
            c -= k
    return [x for room in sorted(open_) for x in open_[room]]


def slots(runs: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset): where the pieces of a length go by their rank."""
    at: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, n in runs:
        offset = 0
        for x in lengths:
            out.append((x, at[x], at[x] + n, sequence, offset))
            at[x] += n
            offset += x
        sequence += n
    return out


def pieces(docs: DataFrame, path: str, pattern: str, end_id: int, capacity: int, text: str = "text", keep_ids: bool = False, added: bool = False) -> DataFrame:
    """The pieces of each row: doc_id, piece, start, length, ids_crc32, and part, rank_in_part: which of its length it is in
    its task's share. Only documents over the capacity are cut, into full pieces after a shorter first one. keep_ids: with
    the ids themselves (array<int>). added: the file's added tokens are one id each, else ordinary text."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long" + ", ids array<int>" * keep_ids

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen = library_coder(path, pattern, added), TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            rows = utf8(b.column(text))
            for i, j in slices(rows):
                ids, at = bpe.encode(rows[i:j])
                out = []
                for k, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    own = np.append(ids[x:y], np.int32(end_id)).astype("<i4")
                    n = len(own)
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for p, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        out.append((i + k, p, s, e - s, zlib.crc32(own[s:e].tobytes()), seen[e - s], own[s:e]))
                        seen[e - s] += 1
                take, *columns, lists = zip(*out)
                arrays = [b.column("doc_id").take(pa.array(take))]
                arrays += [pa.array(c, t) for c, t in zip(columns[:4], (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                arrays += [pa.array([part] * len(out), pa.int32()), pa.array(columns[4], pa.int64())]
                if keep_ids:
                    arrays.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part"] + ["ids"] * keep_ids)

    return docs.select("doc_id", text).mapInArrow(step, schema)


def pack(cut: DataFrame, capacity: int = 1024, groups: int = 48) -> DataFrame:
    """A sequence and an offset for each row of pieces(), as sequence_id and offset; gapless, no sequence over the capacity.

    cut must not change when it is read again: pass it through durable(). A piece's rank among those of its length is its
    rank in its part plus what the parts before have, so a length that a third of all pieces share is still counted in
    parallel and no task holds a length's pieces.
    """
    spark = cut.sparkSession
    counts = cut.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = durable(counts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    made = slots(plan(histogram, capacity, groups))
    table = spark.createDataFrame(made or [(0, 0, 0, 0, 0)], "length long, lo long, hi long, first_sequence long, offset long")
    table = F.broadcast(table) if len(made) <= PLAN_ROWS else table
    ranked = cut.join(counts.select("part", "length", "before"), ["part", "length"]).withColumn("rank", F.col("rank_in_part") + F.col("before"))
    placed = ranked.join(table, ["length"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    keep = [c for c in cut.columns if c not in ("part", "rank_in_part")]
    return placed.select(*keep, (F.col("first_sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, pattern: str, end_id: int = 2, capacity: int = 1024, added: bool = False) -> DataFrame:
    """Documents (doc_id, text) as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the end id alone; an empty table gives no rows; rows that share a doc_id are packed each."""
    return pack(durable(pieces(docs, path, pattern, end_id, capacity, added=added)), capacity)
