"""Presence gates: whether a read's 32-mers are in an index, exactly or by a Bloom filter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bases
from . import scan
from .search import FEW
from .store import durable
from .text import Text

WINDOW = 32
_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def first_window(seq: Column | str) -> Column:
    """The leftmost 32 bases without N; empty if there are none."""
    return F.regexp_extract(seq, f"[ACGT]{{{WINDOW}}}", 0)


def held(text: Text, reads: DataFrame) -> DataFrame:
    """w: keys for the gates on these reads: the reads' windows that the text has; of many reads, the text's windows."""
    given = scan.few(reads, "seq", FEW)
    return text.windows(WINDOW).select("w") if given is None else durable(scan.matched(text, [(x, range(len(x))) for x in given], WINDOW, WINDOW).select("w"))


def present_first(reads: DataFrame, keys: DataFrame) -> DataFrame:
    """rid, present: whether the first clean window of each read (rid, seq) is in keys (w). Both sides are dealt by the
    window, keys that no read asks for are dropped before."""
    asked = reads.select("rid", first_window("seq").alias("w"))
    hit = keys.select(F.col("w").cast("string").alias("w")).join(asked.where("w <> ''").select("w").distinct(), "w", "left_semi").distinct().withColumn("hit", F.lit(True))
    return asked.join(hit, "w", "left").select("rid", F.coalesce("hit", F.lit(False)).alias("present"))


def window_hits(reads: DataFrame, keys: DataFrame) -> DataFrame:
    """rid, at: the places of a read's clean windows that are in keys."""
    all_ = reads.select("rid", F.posexplode(bases.windows("seq", WINDOW)).alias("at", "w")).where(~F.contains("w", F.lit("N")))
    known = keys.select(F.col("w").cast("string").alias("w")).join(all_.select("w").distinct(), "w", "left_semi").distinct()
    return all_.join(known, "w", "left_semi").select("rid", "at")


def present_any(reads: DataFrame, keys: DataFrame) -> DataFrame:
    hits = window_hits(reads, keys).groupBy("rid").agg(F.min("at").alias("first_hit"))
    return reads.select("rid").join(hits, "rid", "left").select("rid", F.col("first_hit").isNotNull().alias("present"), "first_hit")


def misroute(reads: DataFrame, keys: DataFrame) -> DataFrame:
    """bucket, n: reads that some window finds but the first doesn't, by how far in the first hit is."""
    rows = present_any(reads, keys).where("present").join(present_first(reads, keys).withColumnRenamed("present", "by_first"), "rid").where(~F.col("by_first"))
    first = F.position(first_window("seq"), F.col("seq")) - 1
    off = rows.join(reads.select("rid", first.alias("start")), "rid").select((F.col("first_hit") - F.col("start")).alias("d"))
    bucket = F.when(F.col("d") <= 1, "1").when(F.col("d") == 2, "2").when(F.col("d") <= 5, "3-5").when(F.col("d") <= 10, "6-10").otherwise(">10")
    return off.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class BloomParams:
    bits: int
    hashes: int

    @staticmethod
    def for_keys(n: int, rate: float) -> BloomParams:
        """The bits (in whole words of 64) and hashes for n keys at a false positive rate."""
        if not 0 < rate < 1:
            raise ValueError("the rate must lie between 0 and 1")
        if n == 0:
            return BloomParams(64, 1)
        bits = -(-math.ceil(-n * math.log(rate) / math.log(2) ** 2) // 64) * 64
        return BloomParams(bits, min(32, max(1, round(bits / n * math.log(2)))))


def splitmix(x: np.ndarray) -> np.ndarray:
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def key_numbers(kmers: pd.Series) -> np.ndarray:
    """32-mers as unsigned numbers, two bits a base."""
    codes = np.zeros(256, np.uint64)
    codes[[ord(c) for c in "ACGT"]] = np.arange(4)
    rows = np.frombuffer("".join(kmers).encode(), np.uint8).reshape(len(kmers), -1) if len(kmers) else np.zeros((0, WINDOW), np.uint8)
    out = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        out = (out << np.uint64(2)) | codes[rows[:, j]]
    return out


def bit_places(keys: np.ndarray, params: BloomParams) -> np.ndarray:
    """The bits of each key: a second hash is added over and over to the first, and scaled to the number of bits by the high
    word of a 64 by 64 bit product."""
    h1 = splitmix(keys)
    h2 = splitmix(keys ^ _GOLD) | np.uint64(1)
    h = h1[:, None] + h2[:, None] * np.arange(params.hashes, dtype=np.uint64)
    m, low = np.uint64(params.bits), np.uint64(0xFFFFFFFF)
    a, b = h >> np.uint64(32), h & low
    c, d = m >> np.uint64(32), m & low
    mid = a * d + ((b * d) >> np.uint64(32))
    return a * c + (mid >> np.uint64(32)) + ((b * c + (mid & low)) >> np.uint64(32))


def bloom_blocks(keys: DataFrame, params: BloomParams, column: str = "w") -> DataFrame:
    """word, bits: the filter as rows of its non-empty 64-bit words, so that a filter of any size is spread out."""

    def places(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([*bit_places(key_numbers(p), params).astype(np.int64)])

    each = F.pandas_udf(places, "array<long>")
    rows = keys.select(F.explode(each(F.col(column).cast("string"))).alias("bit")).distinct()
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    return rows.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(one).alias("bits"))


def bloom_contains(rows: DataFrame, blocks: DataFrame, params: BloomParams, column: str = "w") -> DataFrame:
    """rows with `maybe`: whether all bits of the key in `column` are set. No key is missed; some are found that weren't put in."""

    def places(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([*bit_places(key_numbers(p), params).astype(np.int64)])

    each = F.pandas_udf(places, "array<long>")
    asked = rows.select(F.col(column).alias("k")).where(F.length("k") == WINDOW).distinct().select("k", F.explode(each("k")).alias("bit"))
    met = asked.join(blocks, F.floor(F.col("bit") / 64) == F.col("word"), "left")
    is_set = F.call_function("shiftrightunsigned", F.coalesce("bits", F.lit(0).cast("long")), (F.col("bit") % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    found = met.groupBy("k").agg(F.bool_and(is_set).alias("maybe"))
    return rows.join(found, rows[column] == found["k"], "left").drop("k").withColumn("maybe", F.coalesce("maybe", F.lit(False)))


def present_bloom_first(reads: DataFrame, blocks: DataFrame, params: BloomParams) -> DataFrame:
    rows = bloom_contains(reads.select("rid", first_window("seq").alias("w")), blocks, params)
    return rows.select("rid", F.col("maybe").alias("present"))


def present_bloom(reads: DataFrame, keys: DataFrame, blocks: DataFrame, params: BloomParams) -> DataFrame:
    """As present_any, with the filter before the exact join."""
    all_ = reads.select("rid", F.explode(F.array_distinct(bases.windows("seq", WINDOW))).alias("w")).where(~F.contains("w", F.lit("N")))
    maybe = bloom_contains(all_, blocks, params).where("maybe")
    hit = maybe.join(keys.select(F.col("w").cast("string").alias("w")).distinct(), "w", "left_semi").select("rid").distinct().withColumn("present", F.lit(True))
    return reads.select("rid").join(hit, "rid", "left").select("rid", F.coalesce("present", F.lit(False)).alias("present"))


def keyset_digest(keys: DataFrame, column: str = "w") -> DataFrame:
    """digest: the sum of the keys' hashes modulo 2^64, whatever their order."""

    def mixed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([str(x) for x in splitmix(key_numbers(p))])

    rows = keys.select(F.pandas_udf(mixed, "string")(F.col(column).cast("string")).cast("decimal(38,0)").alias("x"))
    return rows.agg((F.coalesce(F.sum("x"), F.lit(0).cast("decimal(38,0)")) % F.expr("cast(18446744073709551616 as decimal(38,0))")).cast("decimal(20,0)").alias("digest"))


def accept(smems: DataFrame, reads: DataFrame, present: DataFrame, most: int = 500) -> DataFrame:
    """rid, p1, p2, p3: present; and no seed occurs `most` times or more; and the seeds cover the whole read."""
    from .intervals import merge

    spans = merge(smems.select("rid", F.col("m").alias("start"), (F.col("n") + 1).alias("end")), touching=True, by=("rid",))
    cover = spans.groupBy("rid").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    top = smems.groupBy("rid").agg(F.max("s").alias("top"))
    rows = reads.select("rid", F.length("seq").alias("size")).join(present.select("rid", "present"), "rid").join(top, "rid", "left").join(cover, "rid", "left")
    p2 = F.col("present") & F.coalesce(F.col("top") < most, F.lit(False))
    return rows.select("rid", F.col("present").alias("p1"), p2.alias("p2"), (p2 & (F.coalesce("covered", F.lit(0)) == F.col("size"))).alias("p3"))


#: How often a seed occurs, in the classes of the report.
OCCURRENCES = (1, 2, 3, 4, 5)


def divergences(fast: DataFrame, full: DataFrame) -> DataFrame:
    """rid, m, n, kind, bucket of the spans (rid, m, n, s) in which a read's seeds from the small index differ from those from the full one: missing,
    reduced or inflated occurrences, or over_emit (only the small index has the span). bucket: occurrences in the full index, 5 and more as 5.
    A seed that is there more than once counts once."""
    one = lambda df, name: df.groupBy("rid", "m", "n").agg(F.max("s").alias(name))
    both = one(full, "a").join(one(fast, "b"), ["rid", "m", "n"], "full")
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "over_emit").when(F.col("b") < F.col("a"), "reduced").when(F.col("b") > F.col("a"), "inflated")
    return both.select("rid", "m", "n", kind.alias("kind"), F.when(F.col("a") < OCCURRENCES[-1], F.col("a")).when(F.col("a").isNotNull(), OCCURRENCES[-1]).cast("int").alias("bucket")).where("kind is not null")


def accept_tallies(accepted: DataFrame, diverging: DataFrame, full: DataFrame, most: int = 500) -> DataFrame:
    """p1, p2, p3, same, high, reads: reads by which accept predicates hold (rid, p1, p2, p3), whether their seeds are those of the full index, and
    whether some seed there occurs over `most` times, with all subtotals (null: all of them)."""
    top = full.groupBy("rid").agg((F.max("s") > most).alias("high"))
    rows = accepted.join(diverging.select("rid").distinct().withColumn("same", F.lit(False)), "rid", "left").join(top, "rid", "left")
    rows = rows.select("p1", "p2", "p3", F.coalesce("same", F.lit(True)).alias("same"), F.coalesce("high", F.lit(False)).alias("high"))
    return rows.cube("p1", "p2", "p3", "same", "high").agg(F.count("*").alias("reads"))


def divergence_tallies(diverging: DataFrame) -> DataFrame:
    """kind, bucket, spans: diverging spans by kind, by occurrences, by both and in all (null: all of them; bucket 0: not in the full index)."""
    rows = diverging.select("kind", F.coalesce("bucket", F.lit(0)).alias("bucket"))
    return rows.cube("kind", "bucket").agg(F.count("*").alias("spans"))


def tiered(reads: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads that the small index serves, and those for the full one."""
    rows = reads.join(present.select("rid", "present"), "rid")
    return rows.where("present").drop("present"), rows.where(~F.col("present")).drop("present")
