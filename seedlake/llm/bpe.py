"""Byte-level BPE on numpy matrices.

Distinct pieces of a batch are sorted into length buckets; a bucket is one padded matrix of token ids. In every round each
row merges its leftmost pair of minimum rank, found by a hashed pair lookup; rows that have no pair left leave the matrix
(compaction), so a round costs only what is still being merged.
"""

from __future__ import annotations

import base64
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joined, slices, span_hashes, utf8

#: Pieces over so many bytes are merged one by one with a heap: a matrix round costs their whole width.
WIDEST = 256
#: Entries of a generation that a worker keeps between batches; about 200 bytes each, two generations.
KEPT = 100_000
NONE = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a JSON vocabulary: itself if it is printable Latin-1, else the next code from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a `.tiktoken` or a tokenizer's `.json` file; added (special) tokens are left out."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special, letters = {x["content"] for x in spec.get("added_tokens", [])}, byte_letters()
        return {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())}


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's `.json` file and their ids."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens", [])
    if any(x.get(k) for x in found for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only plain added tokens are known")
    return {x["content"]: x["id"] for x in found}


class Recent(dict):
    """A bounded dictionary: what was asked for lately stays. When `most` entries are full they become the old generation; an old entry that is asked for again moves back."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys: set[str]) -> set[str]:
        """Those of keys that aren't known; the others are kept until the next call."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        new = keys.difference(self)
        if self.old:
            again = new.intersection(self.old)
            self.update(zip(again, map(self.old.__getitem__, again)))
            new -= again
        return new


class Bpe:
    """Encodes and decodes with one vocabulary. `pattern` parts a text into pieces that are encoded separately."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.rx = read_ranks(path), regex.compile(pattern)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        n = max(self.ranks.values()) + 1
        sizes = np.zeros(n, np.int64)
        for t, i in self.ranks.items():
            sizes[i] = len(t)
        self.sizes, self.first = sizes, np.concatenate(([0], np.cumsum(sizes)))
        self.flat = np.zeros(int(sizes.sum()), np.uint8)
        for t, i in self.ranks.items():
            self.flat[self.first[i] : self.first[i + 1]] = np.frombuffer(t, np.uint8)
        self.slot_key = None  # decoding needs no pairs
        self.chunks, self.pieces = Recent(KEPT), Recent(KEPT // 4)  # chunks from space to space; matches of the pattern

    def _hash_pairs(self) -> None:
        """The lookup table: every way to part a token in two tokens is a pair that merges into it."""
        keys, made = array("Q"), array("q")
        for t, i in self.ranks.items():
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(i)
        keys, made = np.frombuffer(keys, np.uint64), np.frombuffer(made, np.int64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys))))) + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_id = np.full(1 << bits, ~np.uint64(0)), np.full(1 << bits, NONE)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):  # linear probing, all keys a step at a time
            free = self.slot_key[at] == ~np.uint64(0)
            _, one = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.slot_key[at[put]], self.slot_id[at[put]] = keys[left[put]], made[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair merges into, NONE where there is none. Ids under 0 are padding."""
        if self.slot_key is None:
            self._hash_pairs()
        out = np.full(a.shape, NONE)
        real = np.flatnonzero(((a >= 0) & (b >= 0)).ravel())
        keys = a.ravel()[real].astype(np.uint64) << np.uint64(32) | b.ravel()[real].astype(np.uint64)
        at, flat = self._slot(keys), out.ravel()
        while len(real):
            found = self.slot_key[at]
            hit = found == keys
            flat[real[hit]] = self.slot_id[at[hit]]
            on = ~hit & (found != ~np.uint64(0))
            real, keys, at = real[on], keys[on], (at[on] + 1) & self.mask
        return flat.reshape(a.shape)

    def merge_matrix(self, rows: list[bytes], width: int) -> list[bytes]:
        """The ids (little-endian int32 bytes) of pieces of `width` bytes at most."""
        ids = np.full((len(rows), width + 1), -1, np.int64)
        sizes = np.array([len(r) for r in rows])
        ids[:, :width][np.arange(width) < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        rest, out, columns = np.arange(len(rows)), [b""] * len(rows), np.arange(width + 1)
        while len(rest):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rest)), at]
            done = best == NONE
            if done.any():
                end = ids[done].astype("<i4")
                flat, to = end[end >= 0].tobytes(), (4 * np.cumsum((end >= 0).sum(axis=1))).tolist()
                for k, i, j in zip(rest[done].tolist(), [0, *to], to):
                    out[k] = flat[i:j]
                go = ~done
                rest, ids, ranks, at, best = rest[go], ids[go], ranks[go], at[go], best[go]
                if not len(rest):
                    break
                used = int((ids >= 0).sum(axis=1).max())
                ids, ranks, columns = ids[:, : used + 1], ranks[:, :used], columns[: used + 1]
            r = np.arange(len(rest))
            ids[r, at] = best
            w = ids.shape[1]
            ids = np.take_along_axis(ids, np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), w - 1), axis=1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(columns[None, :-1] + (columns[None, :-1] > at[:, None]), w - 2), axis=1)
            ranks[:, -1] = NONE
            ranks[r, at] = self.pair_ranks(ids[r, at], ids[r, np.minimum(at + 1, w - 1)])
            before = at > 0
            ranks[r[before], at[before] - 1] = self.pair_ranks(ids[r[before], at[before] - 1], ids[r[before], at[before]])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one very long piece, with a heap of (rank, place): n log n where a matrix row takes n squared."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: self.ranks.get(self.token(ids[i]) + self.token(ids[after[i]])) if after[i] < n else None
        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] is None or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (s := rank(k)) is not None:
                    heapq.heappush(heap, (s, k))
        return np.array([x for x in ids if x is not None], "<i4").tobytes()

    def token(self, i: int) -> bytes:
        return self.flat[self.first[i] : self.first[i + 1]].tobytes()

    def _learn(self, pieces: set[str]) -> None:
        """Encodes the pieces that aren't known yet."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode()
            buckets.setdefault(0 if len(b) > WIDEST else 1 << (len(b) - 1).bit_length(), []).append((p, b))
        for width, rows in buckets.items():
            for k in range(0, len(rows), step := 1 << 14):
                strings, part = zip(*rows[k : k + step])
                self.pieces.update(zip(strings, map(self.merge_long, part) if width == 0 else self.merge_matrix(part, width)))

    def encode_parts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text by the pattern and the merges, without the chunks' shortcut."""
        found = [[t] if t[1:].isalpha() and (t[0] == " " or t[0].isalpha()) else self.rx.findall(t) for t in texts]
        self._learn(self.pieces.missing(set(chain.from_iterable(found))))
        get = self.pieces.__getitem__
        return [get(parts[0]) if len(parts) == 1 else b"".join(map(get, parts)) for parts in found]

    def encode(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows (UTF-8) in one int32 array, and where each row's begin (one more: the end).

        A single space between two other characters always begins a piece. So rows are cut before each space, equal chunks
        are found by a 128-bit hash, and each distinct chunk is encoded once; a row with a chunk that begins or ends in
        (other) white space goes through the pattern as a whole.
        """
        data, at = joined(rows, b"")
        begins = data == 32
        begins[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(at, starts, "right") - 1
        h, check = span_hashes(data, starts, ends, True)
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        text = data.tobytes()
        chunks = [text[i:j] for i, j in zip(starts[one].tolist(), ends[one].tolist())]
        new, odd = [], []
        for c in self.chunks.missing(set(chunks)):
            own = (d := c.decode())[d[0] == " " :]
            (new if own and own == own.strip() else odd).append(c)
        self.chunks.update(zip(new, self.encode_parts([c.decode() for c in new])))
        self.chunks.update(dict.fromkeys(odd))
        known = [*map(self.chunks.__getitem__, chunks)]
        bad = np.array([x is None for x in known], bool)[which] | (check != check[one][which])
        by_rule = np.unique(row[bad])
        known = [x or b"" for x in known]
        sizes = np.array([len(x) for x in known], np.int64) // 4
        first = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(known), "<i4")
        use = ~np.isin(row, by_rule) if len(by_rule) else slice(None)
        which, counts = which[use], np.zeros(len(rows), np.int64)
        each = sizes[which]
        np.add.at(counts, row[use], each)
        where = np.cumsum(each) - each
        ids = flat[np.repeat(first[which] - where, each) + np.arange(int(each.sum()))]
        for c in new:
            if len(c) > 64:  # long ones don't stay
                self.chunks.pop(c, None)
        if len(by_rule):
            own = [np.frombuffer(x, "<i4") for x in self.encode_parts([rows[i].decode() for i in by_rule])]
            parts, k = [], np.concatenate(([0], np.cumsum(counts)))
            last = 0
            for i, x in zip(by_rule.tolist(), own):
                parts += [ids[k[last] : k[i]], x]
                counts[i], last = len(x), i
            ids = np.concatenate([*parts, ids[k[last] :]])
        return ids, np.concatenate(([0], np.cumsum(counts)))

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        shift = self.first[ids] - np.concatenate(([0], np.cumsum(sizes[:-1]))) if len(ids) else sizes
        return self.flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))].tobytes()


class LibraryBpe(Bpe):
    """The same ids from the tiktoken library's merges: for operators that want ids, not this method. added: the file's added
    tokens are one id each wherever a text has them, as in the tokenizers library; else they are ordinary text."""

    def __init__(self, path: str, pattern: str, added: bool = False):
        import tiktoken

        super().__init__(path, pattern)
        special = added_tokens(path) if added else {}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=special)

    def encode(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        made = {t: array("i", self.library.encode(t.decode(), allowed_special="all", disallowed_special=())) for t in set(rows)}
        ids = np.frombuffer(b"".join(made[t].tobytes() for t in rows), "<i4")
        return ids, np.concatenate(([0], np.cumsum([len(made[t]) for t in rows]))).astype(np.int64)


@lru_cache(maxsize=2)
def library_coder(path: str, pattern: str, added: bool = False) -> LibraryBpe:
    return LibraryBpe(path, pattern, added)


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Bpe:
    """One coder for each worker process and vocabulary."""
    return Bpe(path, pattern)


def with_column(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name]).add(name, kind)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the token ids of column `text` in `out` (array<int>). A null text counts as empty and has no ids; texts are encoded whole, special tokens are ordinary text. An earlier column `out` is replaced."""
    schema = with_column(df, out, T.ArrayType(T.IntegerType(), False))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in batches:
            rows = utf8(b.column(text))
            for i, j in slices(rows, 1 << 20):
                ids, at = bpe.encode(rows[i:j])
                column = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(b.column(f.name).slice(i, j - i) for f in schema.fields[:-1]), column], [f.name for f in schema.fields])

    return df.mapInArrow(step, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for in `out` (binary; they need not be valid UTF-8). Null ids decode to no bytes."""
    schema = with_column(df, out, T.BinaryType())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                lists = part.column(ids)
                at = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                made = [bpe.decode(flat[i:j]) for i, j in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in schema.fields[:-1]), pa.array(made, pa.binary())], [f.name for f in schema.fields])

    return df.mapInArrow(step, schema)


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 of its whole text encoded and decoded."""
    both = decode(encode(docs.select("doc_id", "text"), path, pattern).drop("text"), path, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
