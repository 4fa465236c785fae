"""A pass over the text against few strings, which are sent to every task: where each place of the text stands among them in order.

A task holds the strings' bases 32 at a time as numbers, in order, and compares its tiles with them as arrays; it gives back a count for each
result, so what is dealt out depends on the strings and not on the text. Callers count the strings' bytes first (few()); more go by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Text

#: Bytes of strings up to which they are sent to every task.
FEW = 4 << 20
#: Tiles that are looked at in one go.
TILES = 256
#: First bases by which places are told apart before anything else.
HEAD = 12
_CODE = np.zeros(256, np.uint8)
_CODE[[*b"CGT"]] = 1, 2, 3
_LAST = np.array([0] + [(1 << 64) - (1 << (64 - 2 * n)) for n in range(1, 33)], np.uint64)


def few(rows: DataFrame, column: str, most: int = FEW) -> list[bytes] | None:
    """The distinct values of a column of strings or bytes, in order, if they are few by a count of their bytes; else None."""
    values = rows.select(F.col(column).cast("binary").alias("b")).where("b is not null").distinct()
    size = values.agg(F.coalesce(F.sum(F.octet_length("b") + 8), F.lit(0))).first()[0]
    return None if size > most else sorted(bytes(r[0]) for r in values.collect())


def successor(x: bytes) -> bytes | None:
    """The least string after all that begin with x; None if there is none."""
    x = x.rstrip(b"T")
    return x[:-1] + b"CGT"[b"ACG".index(x[-1]) :][:1] if x else None


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """The number of the k bases (a power of two) from each place on; those past the end are A."""
    out, size = np.append(codes, np.zeros(k, np.uint8)).astype(np.uint64), 1
    while size < k:
        out[:-size] = (out[:-size] << np.uint64(2 * size)) | out[size:]
        size *= 2
    return out[: len(codes)]


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of their first bases two numbers of 32 bases share."""
    x = a ^ b
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    bits = np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])
    return (64 - bits) >> 1


class Probes:
    """Strings in order, as levels of 32 bases: a level's keys (code, n) in order within groups that share all bases before; `first` and `count`: which of
    the strings in order have the key; `at`: where in `bases` one of them has it; child: the group of the next level."""

    def __init__(self, bases: bytes, at: np.ndarray, size: np.ndarray):
        self.bases, self.number = bases, len(at)
        self.most = int(size.max(initial=0))
        codes = rolling(_CODE[np.frombuffer(bases, np.uint8)], 32)
        group, base, depth = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), 0
        self.levels = []
        while len(at):
            n = np.clip(size - depth, 0, 32)
            code = codes[np.minimum(at + depth, len(codes) - 1)] & _LAST[n] if len(codes) else np.zeros(len(at), np.uint64)
            order = np.lexsort((n, code, group))
            at, size, group, base, n, code = (x[order] for x in (at, size, group, base, n, code))
            index = np.arange(len(at))
            fresh = np.append(True, group[1:] != group[:-1])
            place = base + index - index[fresh][np.cumsum(fresh) - 1]
            new = fresh | np.append(True, (code[1:] != code[:-1]) | (n[1:] != n[:-1]))
            heads = index[new]
            key = np.cumsum(new) - 1
            deeper = n == 32
            ends = np.searchsorted(group[heads], np.arange(group[-1] + 2))
            if self.levels:
                self.levels[-1]["lo"][self.levels[-1]["n"] == 32], self.levels[-1]["hi"][self.levels[-1]["n"] == 32] = ends[:-1], ends[1:]
            self.levels.append({"code": code[heads], "n": n[heads], "first": place[heads], "count": np.diff(np.append(heads, len(at))), "at": at[heads], "lo": np.zeros(len(heads), np.int64), "hi": np.zeros(len(heads), np.int64)})
            named = (np.cumsum(n[heads] == 32) - 1)[key]
            at, size, group, base = at[deeper], size[deeper], named[deeper], place[heads][key][deeper]
            depth += 32

    def heads(self) -> np.ndarray:
        """Which first HEAD bases the strings of as many and more have."""
        top, out = self.levels[0] if self.levels else {"code": np.zeros(0, np.uint64), "n": np.zeros(0, np.int64)}, np.zeros(4**HEAD, bool)
        out[(top["code"][top["n"] >= HEAD] >> np.uint64(64 - 2 * HEAD)).astype(np.int64)] = True
        return out

    def find(self, codes: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the strings of `size` bases at places of a text (codes: rolling, of 32): how many probes are not behind each, how many bases it shares
        with one at most, and where such a probe is."""
        slot, best, where = (np.zeros(len(at), np.int64) for _ in range(3))
        if not self.levels:
            return slot, best, where
        left, depth = np.arange(len(at)), 0
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.levels[0]["code"]))
        for level in self.levels:
            n = np.clip(size[left] - depth, 0, 32)
            code = codes[np.minimum(at[left] + depth, len(codes) - 1)] & _LAST[n]
            keys, most = level["code"], len(level["code"]) - 1
            if not depth:
                i = np.searchsorted(keys, code)
            else:
                i, end = lo.copy(), hi.copy()
                while (open_ := i < end).any():
                    mid = (i + end) >> 1
                    less = open_ & (keys[np.minimum(mid, most)] < code)
                    i, end = np.where(less, mid + 1, i), np.where(open_ & ~less, mid, end)
            same = np.flatnonzero((i < hi) & (keys[np.minimum(i, most)] == code))
            while len(same := same[level["n"][i[same]] < n[same]]):
                i[same] += 1
                same = same[(i[same] < hi[same]) & (keys[np.minimum(i[same], most)] == code[same])]
            j = np.minimum(i, most)
            equal = (i < hi) & (keys[j] == code) & (level["n"][j] == n)
            down = equal & (n == 32)
            deeper = j[down]
            done = np.flatnonzero(~down)
            of, top, bottom = left[done], hi[done], lo[done]
            i, j, n, code = i[done], j[done], n[done], code[done]
            inside, before = i < top, np.maximum(i - 1, 0)
            slot[of] = np.where(inside, level["first"][j] + np.where(equal[done], level["count"][j], 0), level["first"][top - 1] + level["count"][top - 1])
            after_len = np.where(inside, np.minimum(np.minimum(shared(code, keys[j]), level["n"][j]), n), -1)
            before_len = np.where(i > bottom, np.minimum(np.minimum(shared(code, keys[before]), level["n"][before]), n), -1)
            best[of] = depth + np.maximum(after_len, before_len)
            where[of] = np.where(after_len >= before_len, level["at"][j], level["at"][before])
            left, lo, hi, depth = left[down], level["lo"][deeper], level["hi"][deeper], depth + 32
            if not len(left):
                break
        return slot, best, where


def _places(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some tiles at a time: the rolling number of 32 bases everywhere in them, their own places, and how many bases each has (at most `most`)."""
    for batch in batches:
        for first in range(0, batch.num_rows, TILES):
            part = batch.slice(first, TILES)
            own, seq = part.column("size").to_numpy().astype(np.int64), part.column("seq")
            offsets = np.frombuffer(seq.buffers()[1], np.int32)[seq.offset : seq.offset + len(seq) + 1].astype(np.int64)
            if offsets[-1] == offsets[0]:
                continue
            data = np.frombuffer(seq.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            own = np.clip(own, 0, np.diff(offsets))
            i = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            yield rolling(_CODE[data], 32), np.repeat(offsets[:-1] - offsets[0], own) + i, np.minimum(np.repeat(np.diff(offsets), own) - i, most)


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """For some rows (start, lo, hi, seq) at a time: the rolling number of 32 bases everywhere in them, their bytes, the places from lo to hi, what place of the
    text each is, and its row."""
    for batch in batches:
        for first in range(0, batch.num_rows, TILES):
            part = batch.slice(first, TILES)
            seq = part.column("seq")
            start, lo, hi = (part.column(c).to_numpy().astype(np.int64) for c in ("start", "lo", "hi"))
            offsets = np.frombuffer(seq.buffers()[1], np.int32)[seq.offset : seq.offset + len(seq) + 1].astype(np.int64)
            data = np.frombuffer(seq.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            own = hi - lo
            i = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own - lo, own)
            yield rolling(_CODE[data], 32), data, np.repeat(offsets[:-1] - offsets[0], own) + i, np.repeat(start, own) + i, np.repeat(np.arange(len(own)), own), own


def below(text: Text, strings: list[bytes]) -> tuple[np.ndarray, int]:
    """How many places of the text sort before each string (over ACGT, in order), and how many places there are. A number for each string
    and task is dealt."""
    sizes = np.array([len(x) for x in strings], np.int64)
    probes = Probes(b"".join(strings), np.cumsum(sizes) - sizes, sizes)
    text.check(probes.most)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(probes.number + 1, np.int64)
        for codes, at, size in _places(batches, probes.most):
            n += np.bincount(probes.find(codes, at, size)[0], minlength=len(n))
        slots = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(n[slots])], ["slot", "n"])

    rows = text.tiles.select("size", "seq").mapInArrow(tally, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect()
    n = np.zeros(len(strings) + 1, np.int64)
    for slot, count in rows:
        n[slot] = count
    return np.cumsum(n)[:-1], int(n.sum())


def matched(text: Text, strings: list[tuple[bytes, range]], least: int, most: int) -> DataFrame:
    """w, n: what places of the text share with some string at most, if that is at least `least` bases, and at how many places. strings: bases, and the
    places in them that strings begin at; each goes on to the next base that isn't one of ACGT. Lengths are cut to `most`."""
    text.check(most)
    bases = b"N".join(x for x, _ in strings) + b"N"
    begins = np.cumsum([0] + [len(x) + 1 for x, _ in strings])
    at = np.array([b + p for b, (_, places) in zip(begins, strings) for p in places], np.int64)
    other = np.flatnonzero(~np.isin(np.frombuffer(bases, np.uint8), np.frombuffer(b"ACGT", np.uint8)))
    size = np.minimum(other[np.searchsorted(other, at)] - at, most)
    probes = Probes(bases, at[size >= least], size[size >= least])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, seen = probes.heads(), {}
        for codes, at, size in _places(batches, most):
            keep = size >= least if least < HEAD else heads[(codes[at] >> np.uint64(64 - 2 * HEAD)).astype(np.int64)] & (size >= least)
            at, size = at[keep], size[keep]
            _, best, where = probes.find(codes, at, size)
            keys, n = np.unique((where * (most + 1) + best)[best >= least], return_counts=True)
            for k, c in zip(keys.tolist(), n.tolist()):
                seen[k] = seen.get(k, 0) + c
        keys = [*seen]
        for i in range(0, len(keys), 8192):
            some = keys[i : i + 8192]
            w = [probes.bases[k // (most + 1) : k // (most + 1) + k % (most + 1)] for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array([seen[k] for k in some], pa.int64())], ["w", "n"])

    return text.tiles.select("size", "seq").mapInArrow(meet, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


class Sides:
    """How places of a text stand to strings in order: for each string and number of shared bases, how many places between it and the string before
    it (side 0), or the one after it (side 1), share as many with it, and the first such place."""

    #: First bases by which most places are told apart.
    TOP = 10

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(x) for x in strings], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        #: where a string's entries begin: one for each number of bases that it can share
        self.entry = self.begin + np.arange(len(strings))
        self.entries = int((self.sizes + 1).sum())
        self.probes = Probes(b"".join(strings), self.begin, self.sizes)
        self.codes = np.append(rolling(_CODE[np.frombuffer(self.probes.bases, np.uint8)], 32), np.uint64(0))

    def common(self, codes: np.ndarray, at: np.ndarray, size: np.ndarray, string: np.ndarray) -> np.ndarray:
        """How many bases the places share with a string each."""
        most = np.minimum(size, self.sizes[string])
        out, left, depth = most.copy(), np.arange(len(at)), 0
        while len(left := left[most[left] > depth]):
            a, b = codes[at[left] + depth], self.codes[self.begin[string[left]] + depth]
            n = np.minimum(shared(a, b), most[left] - depth)
            whole = n == 32
            out[left[~whole]] = depth + n[~whole]
            left, depth = left[whole], depth + 32
        return out

    def stand(self, codes: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side: which of the places have a string there, and that string's entry."""
        slot, out = self.probes.find(codes, at, size)[0], []
        for string in (slot, slot - 1):
            has = np.flatnonzero((string >= 0) & (string < len(self.sizes)))
            out.append((has, self.entry[string[has]] + self.common(codes, at[has], size[has], string[has])))
        return out


def sides(text: Text, strings: list[bytes]) -> tuple[Sides, np.ndarray, np.ndarray]:
    """The Sides of strings (in order, distinct, over ACGT, none empty) in one pass: counts and first places by side and entry. Places that share no string's
    first bases are counted by their own first bases; only the others are compared."""
    known = Sides(strings)
    text.check(int(known.sizes.max(initial=0)))
    top, none, total = 4**known.TOP, np.iinfo(np.int64).max, text.total

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = np.zeros(top, bool)
        long = known.sizes >= known.TOP
        open_[(known.codes[known.begin[long]] >> np.uint64(64 - 2 * known.TOP)).astype(np.int64)] = True
        heads, first = np.zeros(top, np.int64), np.full(top, none)
        n, least = np.zeros((2, known.entries), np.int64), np.full((2, known.entries), none)

        def add(codes, at, size, pos, times=None):
            for side, (has, entry) in enumerate(known.stand(codes, at, size)):
                n[side] += np.bincount(entry, None if times is None else times[has], known.entries).astype(np.int64)
                np.minimum.at(least[side], entry, pos[has])

        for codes, _, at, pos, _, _ in stretches(batches):
            room = total - pos  # a tile goes on behind its own places, unless the text ends
            head = (codes[at] >> np.uint64(64 - 2 * known.TOP)).astype(np.int64)
            apart = open_[head] | (room < known.TOP)
            at_, pos_ = at[apart], pos[apart]
            add(codes, at_, np.minimum(room[apart], int(known.sizes.max())), pos_)
            head, pos = head[~apart], pos[~apart]
            heads += np.bincount(head, minlength=top)
            np.minimum.at(first, head, pos)
        met = np.flatnonzero(heads)
        add(met.astype(np.uint64) << np.uint64(64 - 2 * known.TOP), np.arange(len(met)), np.full(len(met), known.TOP), first[met], heads[met])
        for side in (0, 1):
            found = np.flatnonzero(n[side])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), side)), pa.array(found), pa.array(n[side][found]), pa.array(least[side][found])], ["side", "entry", "n", "place"])

    whole = text.tiles.select("start", F.lit(0).alias("lo"), F.col("size").alias("hi"), "seq").where("hi > 0")
    rows = whole.mapInArrow(tally, "side long, entry long, n long, place long").groupBy("side", "entry").agg(F.sum("n"), F.min("place")).collect()
    n, place = np.zeros((2, known.entries), np.int64), np.full((2, known.entries), none)
    for side, entry, count, least in rows:
        n[side, entry], place[side, entry] = count, least
    return known, n, place


def prefix_runs(text: Text, strings: list[bytes]) -> dict[bytes, list[tuple[int, int, int, int, int]]]:
    """For each of some strings (in order, distinct, over ACGT, none empty) its prefixes that occur: lo, hi, occ, sa_start, place: those of lo to hi bases
    occur occ times, stand from rank sa_start on, and first at `place`."""
    if not strings:
        return {}
    known, n, place = sides(text, strings)
    count, sizes = len(strings), known.sizes
    near = known.common(known.codes, known.begin[1:], sizes[1:], np.arange(count - 1)) if count > 1 else np.zeros(0, np.int64)
    own = lambda of, i: of[known.entry[i] : known.entry[i] + sizes[i] + 1]

    def carried(side: int, order: range, step: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """By numbers of shared bases, the places on one side of each string: those next to it, and those of its neighbour, which share no more than both do."""
        out, last = [], None
        for i in order:
            here, where = own(n[side], i).copy(), own(place[side], i).copy()
            if last is not None:
                most = int(near[min(i, i - step)])
                here[:most] += last[0][:most]
                here[most] += last[0][most:].sum()
                where[:most] = np.minimum(where[:most], last[1][:most])
                where[most] = min(where[most], last[1][most:].min())
            out.append(last := (here, where))
        return out

    below, above, out = carried(0, range(count), 1), carried(1, range(count - 1, -1, -1), -1)[::-1], {}
    for i, x in enumerate(strings):
        (less, p), (more, q) = below[i], above[i]
        occ = np.cumsum((less + more)[::-1])[::-1]
        start = 1 + less.sum() - np.cumsum(less[::-1])[::-1]
        first = np.minimum.accumulate(np.minimum(p, q)[::-1])[::-1]
        occ, start, first = (v[1:].tolist() for v in (occ, start, first))
        ends = [j for j in range(len(occ)) if occ[j] and (j + 1 == len(occ) or occ[j + 1] != occ[j])]
        out[x] = [(lo + 2, j + 1, occ[j], start[j], first[j]) for lo, j in zip([-1, *ends], ends)]
    return out


def mers(text: Text, k: int) -> DataFrame:
    """w, n: how many places begin with each k-mer (k at most 8), or have only the fewer bases w."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((k + 1) << 2 * k, np.int64)
        for codes, at, size in _places(batches, k):
            n += np.bincount((size << 2 * k) + ((codes[at] & _LAST[size]) >> np.uint64(64 - 2 * k)).astype(np.int64), minlength=len(n))
        found = np.flatnonzero(n)
        letters = np.frombuffer(b"ACGT", np.uint8)
        w = [letters[(int(x) >> 2 * np.arange(k - 1, -1, -1)) & 3].tobytes()[: int(x) >> 2 * k] for x in found]
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(n[found])], ["w", "n"])

    return text.tiles.select("size", "seq").mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
