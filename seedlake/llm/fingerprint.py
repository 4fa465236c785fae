"""Document fingerprints: an invertible Bloom lookup sketch of paragraph digests.

A paragraph is a line, cut further after a word whose hash says so, so that an edit changes only the paragraphs around it. Each
distinct digest goes into three hashed cells (count, sum of digests, sum of check hashes). The difference of two sketches holds
only the digests that differ; cells with a single digest are peeled until all are recovered, and where peeling gets stuck
both sketches are made again with twice the cells. The likeness of two texts is the Jaccard similarity of their digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import mix64, slices, span_hashes, utf8, words_of

HASHES, CELLS, CUT = 3, 24, 8
_CHECK = np.uint64(0xA24BAED4963EE407)


def digests(texts: list[bytes], cut: int = CUT) -> list[np.ndarray]:
    """The sorted distinct paragraph digests of each text; white space counts only as what parts words and lines."""
    data, starts, ends, row, bounds = words_of(texts)
    h = span_hashes(data, starts, ends)
    if not len(h):
        return [np.zeros(0, np.uint64)] * len(texts)
    feeds = np.concatenate(([0], np.cumsum(data == 10)))
    last = np.ones(len(h), bool)
    last[:-1] = (feeds[starts[1:]] > feeds[ends[:-1]]) | (h[:-1] % np.uint64(cut) == 0)
    first = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    sizes = np.diff(np.append(first, len(h)))
    place = np.arange(len(h)) - np.repeat(first, sizes)
    d = mix64(np.add.reduceat(h * (mix64(place) | np.uint64(1)), first) + sizes.astype(np.uint64))
    at = np.searchsorted(row[first], np.arange(len(texts) + 1))
    return [np.unique(d[i:j]) for i, j in zip(at, at[1:])]


def places(d: np.ndarray, owner: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each digest under each hash: every hash has a third of its owner's cells."""
    third = cells // HASHES
    return [owner * cells + k * third + (mix64(d ^ mix64(np.array([k + 11]))[0]) % np.uint64(third)).astype(np.int64) for k in range(HASHES)]


def sketch(sets: list[np.ndarray], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest sums and check sums of all sets, `cells` cells each."""
    count, keys, checks = np.zeros(len(sets) * cells, np.int64), np.zeros(len(sets) * cells, np.uint64), np.zeros(len(sets) * cells, np.uint64)
    d = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for at in places(d, owner, cells):
        np.add.at(count, at, 1)
        np.add.at(keys, at, d)
        np.add.at(checks, at, mix64(d ^ _CHECK))
    return count, keys, checks


def peel(table: tuple[np.ndarray, np.ndarray, np.ndarray], owners: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """How many digests were recovered of each owner's difference, and whether nothing is left over."""
    count, keys, checks = (t.copy() for t in table)
    got = np.zeros(owners, np.int64)
    for _ in range(64 + cells):
        one = np.flatnonzero(np.abs(count) == 1)
        sign = count[one]
        d = np.where(sign > 0, keys[one], np.uint64(0) - keys[one])
        own = np.where(sign > 0, checks[one], np.uint64(0) - checks[one]) == mix64(d ^ _CHECK)
        one, sign, d = one[own], sign[own], d[own]
        if not len(one):
            break
        owner = one // cells
        _, pick = np.unique(mix64(d + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        owner, sign, d = owner[pick], sign[pick], d[pick]
        np.add.at(got, owner, 1)
        by, check = np.where(sign > 0, d, np.uint64(0) - d), mix64(d ^ _CHECK)
        check = np.where(sign > 0, check, np.uint64(0) - check)
        for at in places(d, owner, cells):
            np.subtract.at(count, at, sign)
            np.subtract.at(keys, at, by)
            np.subtract.at(checks, at, check)
    rest = (count != 0) | (keys != 0) | (checks != 0)
    return got, ~rest.reshape(owners, cells).any(axis=1) if owners else np.zeros(0, bool)


def likeness(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """The similarity of each pair of digest sets by subtracting and peeling, with more cells for those that get stuck."""
    differ = np.zeros(len(left), np.int64)
    todo = np.arange(len(left))
    while len(todo):
        a, b = sketch([left[i] for i in todo], cells), sketch([right[i] for i in todo], cells)
        got, done = peel(tuple(x - y for x, y in zip(a, b)), len(todo), cells)
        differ[todo[done]] = got[done]
        todo = todo[~done]
        cells *= 2
    total = np.array([len(x) + len(y) for x, y in zip(left, right)], np.int64)
    return np.where(total > 0, (total - differ) / np.maximum(total + differ, 1), 1.0)


def written(sets: list[np.ndarray], cells: int = CELLS) -> list[str]:
    """Fingerprints as text: how many digests, then the cells, in base64. Equal texts have equal ones."""
    count, keys, checks = sketch(sets, cells)
    table = np.zeros(len(sets) * cells, [("n", "<i4"), ("key", "<u8"), ("check", "<u8")])
    table["n"], table["key"], table["check"] = count, keys, checks
    return [base64.b64encode(struct.pack("<I", len(s)) + table[i * cells : (i + 1) * cells].tobytes()).decode() for i, s in enumerate(sets)]


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return struct.unpack_from("<I", raw)[0], np.frombuffer(raw, [("n", "<i4"), ("key", "<u8"), ("check", "<u8")], offset=4)


def compare(a: str, b: str) -> float | None:
    """The likeness of two fingerprints of one size alone; None where they differ by more than their cells can hold."""
    (m, x), (n, y) = read(a), read(b)
    got, done = peel(tuple(x[c].astype(t) - y[c].astype(t) for c, t in (("n", np.int64), ("key", np.uint64), ("check", np.uint64))), 1, len(x))
    return ((m + n - got[0]) / max(m + n + got[0], 1) if m + n else 1.0) if done[0] else None


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """docs (doc_id, text) dealt into ordered runs: bucket, tail, doc_id, text, sorted within a partition, where a run's last
    row is a copy (tail) of the first row of the next run, and the last run's of the first of all.

    Texts are shuffled once. The bounds are quantiles of doc_id; the driver gets them and a first id for each run. A null
    doc_id comes before all others; rows that share an id are ordered by text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), "doc_id", "text")
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cuts = sorted(set(rows.approxQuantile("id", [k / buckets for k in range(1, buckets)], 1 / (4 * buckets))))
    cuts = [int(c) for c in cuts]
    wide = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[k : k + wide] for k in range(0, len(cuts), wide)]
    if cuts:  # two levels: about twice the square root of the number of bounds is compared
        outer = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups[1:]]) if len(groups) > 1 else F.array().cast("array<bigint>"), lambda c: c <= F.col("id")))
        inner = F.get(F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups]), outer)
        bucket = outer * wide + F.size(F.filter(inner, lambda c: c <= F.col("id")))
    else:
        bucket = F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    firsts = dict(rows.select("bucket", "id").groupBy("bucket").agg(F.min("id")).collect())
    full = sorted(firsts)
    first = F.array(*[F.lit(firsts.get(b)).cast("long") for b in range(max(full, default=0) + 1)])
    before = {b: full[i - 1] for i, b in enumerate(full)}
    to = F.array(*[F.lit(before.get(b)).cast("int") for b in range(max(full, default=0) + 1)])
    tail = F.struct(F.get(to, F.col("bucket")).alias("bucket"), F.lit(True).alias("tail"))
    copies = F.when(F.col("id") == F.get(first, F.col("bucket")), F.array(F.struct("bucket", F.lit(False).alias("tail")), tail)).otherwise(F.array(F.struct("bucket", F.lit(False).alias("tail"))))
    dealt = rows.select(F.explode(copies).alias("to"), "id", "doc_id", "text").select("to.bucket", "to.tail", "id", "doc_id", "text")
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "tail", "id", "text").drop("id")


def fingerprint_digests(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next row by doc_id, after the last the first; a lone row is its own next. A null text is empty.
    Two texts without words are alike (1).
    """
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def block(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text) in order, of which the last is only the next of the one before."""
        ids = [r[0] for r in rows[:-1]]
        texts = [r[1] for r in rows]
        edited = []
        for t, after in zip(texts, texts[1:]):
            k = len(t) // 4
            edited.append((t[: len(t) - k] + after[:k]).encode())
        own, other = digests([t.encode() for t in texts]), digests(edited)
        columns = [ids, [len(t) for t in texts[:-1]], [hashlib.sha256(e).hexdigest() for e in edited], written(own[:-1]), written(other), likeness(own[:-1], other), likeness(own[:-1], own[1:])]
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one run whose next row is yet to come
        run, ended, size = None, False, 0
        for b in batches:
            for bucket, tail, i, t in zip(b.column("bucket").to_pylist(), b.column("tail").to_pylist(), b.column("doc_id").to_pylist(), utf8(b.column("text"))):
                if bucket != run:
                    held, run, ended, size = [], bucket, False, 0
                if ended:
                    continue
                held.append((i, t.decode()))
                size += len(t)
                ended = tail
                if len(held) > 1 and (tail or size > 1 << 20):
                    yield block(held)
                    held, size = held[-1:], len(t)

    return with_next(docs).mapInArrow(step, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
