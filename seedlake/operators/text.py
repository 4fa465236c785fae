"""The indexed text: contigs laid end to end, forward then reverse complement, held as overlapping tiles.

A tile is a fixed stretch of the doubled text with `ahead` further bases, so every window of up to that length lies in one
row, across contigs and strands as the reference text has it. With contig_safe no window crosses a contig or strand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bases
from .intervals import global_offsets, merge
from .store import durable

TILE = 1024
#: Parts that saved tiles are divided into at most, and tiles in a part at least.
PARTS, LEAST = 256, 1024
#: Bytes of asked patterns up to which they are broadcast.
SMALL = 32 << 20


@dataclass
class Text:
    """tiles(start, size, seq): seq has the bases from start on, `size` of them the tile's own; length: of the forward text. part: with
    a column `part` by which tiles are stored, the bases to a part; at() then reads only the parts that it needs (at most PARTS numbers are collected)."""

    tiles: DataFrame
    length: int
    ahead: int
    part: int = 0

    def parted(self) -> Text:
        """The same with a column `part` to store the tiles by."""
        size = max(LEAST * TILE, -(-self.total // PARTS))
        return Text(self.tiles.withColumn("part", F.floor(F.col("start") / size).cast("int")), self.length, self.ahead, size)

    @property
    def total(self) -> int:
        return 2 * self.length

    def check(self, most: int) -> None:
        if most > self.ahead + 1:
            raise ValueError(f"the text is tiled for matches of up to {self.ahead + 1} bases, not {most}")

    def windows(self, k: int) -> DataFrame:
        """pos, w: the k bases from every doubled place that has as many (k at most `ahead` + 1), as bytes."""
        self.check(k)
        own = F.least(F.col("size"), F.octet_length("b") - (k - 1))
        rows = self.tiles.select("start", "size", F.col("seq").cast("binary").alias("b"))
        at = F.explode(F.sequence(F.lit(0), own - 1)).alias("i")
        return rows.where(own > 0).select("start", "b", at).select((F.col("start") + F.col("i")).alias("pos"), F.substr("b", F.col("i") + 1, F.lit(k)).alias("w"))

    def suffixes(self, cap: int, head: DataFrame | None = None, k: int = 0, few: bool | None = None) -> DataFrame:
        """pos, w: up to `cap` bases (at most `ahead` + 1) from every place; with head(h, ...): only places whose k first bases
        are in it, with its other columns, once for each row of it. A head that is small by count (few, if that is known) is sent to all tasks and no
        text is dealt; beyond that places are dealt by h with their `cap` bases, never with their whole tile."""
        self.check(cap)
        b = F.col("seq").cast("binary")
        at = F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i")
        rows = self.tiles.select("start", at, b.alias("__b"))
        pos, w = (F.col("start") + F.col("i")).alias("pos"), F.substr("__b", F.col("i") + 1, F.lit(cap)).alias("w")
        if head is None:
            return rows.select(pos, w)
        h = F.substr("__b", F.col("i") + 1, F.lit(k)).alias("h")
        more = [c for c in head.columns if c != "h"]
        if small(head) if few is None else few:
            return rows.select("start", "i", "__b", h).join(F.broadcast(head), "h").select(pos, w, *more)
        return rows.select(pos, w, h).join(head, "h").select("pos", "w", *more)

    def at(self, rows: DataFrame, cap: int) -> DataFrame:
        """rows (pos, ...) with w: up to `cap` bases from their place on (none at or past the end). Rows meet tiles, not places."""
        self.check(cap)
        block = lambda at: F.floor(at / TILE)
        end = F.col("start") + F.col("size")
        tiles = self.tiles
        if self.part:
            rows = durable(rows)
            near = F.explode(F.array_distinct(F.array(*[F.floor((F.col("pos") - back) / self.part).cast("int") for back in (0, TILE)]))).alias("part")
            tiles = tiles.where(F.col("part").isin([r[0] for r in rows.select(near).distinct().where(f"part between 0 and {self.total // self.part}").collect()]))
        tiles = tiles.where("size > 0").select("start", end.alias("stop"), "seq", F.explode(F.sequence(block(F.col("start")), block(end - 1))).alias("block")).alias("t")
        asked = rows.withColumn("__block", block(F.col("pos"))).alias("q")
        hit = (F.col("q.__block") == F.col("t.block")) & (F.col("q.pos") >= F.col("t.start")) & (F.col("q.pos") < F.col("t.stop"))
        w = F.substr(F.col("t.seq").cast("binary"), (F.col("q.pos") - F.col("t.start")).cast("int") + 1, F.lit(cap))
        return asked.join(tiles, hit, "left").select(*[F.col(f"q.{c}") for c in rows.columns], F.coalesce(w, F.lit("").cast("binary")).alias("w"))

    def piece(self, pos: int, cap: int) -> str:
        """Up to `cap` bases from one place on, read by the driver."""
        self.check(cap)
        start = F.col("start")
        near = self.tiles.where((start > pos - TILE) & (start <= pos)).where(start + F.col("size") > pos)
        return near.select(F.substr("seq", (F.lit(pos) - start).cast("int") + 1, F.lit(cap)).alias("w")).first().w


def small(rows: DataFrame) -> bool:
    """Whether rows are few enough, by a count of their bytes, to be sent to every task."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in rows.columns), F.lit(64))
    return int(rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]) <= SMALL


def contigs(docs: DataFrame, key: str = "doc_id", text: str = "text", encode: bool = True) -> DataFrame:
    """contig_id, name, seq, len, offset: documents as contigs in the order of their key. Null texts are empty contigs."""
    seq = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("contig_id"), F.col(key).cast("string").alias("name"), (bases.encode_text(seq) if encode else F.upper(seq)).alias("seq"))
    # encoding keeps a text's length, so the offsets need no encoded text
    sizes = docs.select(F.col(key).alias("contig_id"), F.col(key).cast("string").alias("name"), F.length(seq if encode else F.upper(seq)).cast("long").alias("len"))
    return rows.join(global_offsets(sizes, ["contig_id"], "len"), ["contig_id", "name"]).select("contig_id", "name", "seq", "len", "offset")


def build(contigs: DataFrame, ahead: int = 512, contig_safe: bool = False, tile: int = TILE, strands: int = 2, fill: str = "A") -> Text:
    """The text of contigs (contig_id, seq, len, offset), N as `fill`; strands 1: forward only. One sum (the length) is read by the driver."""
    if tile > TILE:
        raise ValueError(f"tiles have at most {TILE} bases of their own")
    length = int(contigs.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0])
    rows = contigs.where("len > 0").select("offset", "len", bases.fill_n("seq", fill).alias("seq"))
    both = rows.select(F.col("offset").alias("at"), "seq", "len").unionByName(rows.select((F.lit(2 * length) - F.col("offset") - F.col("len")).alias("at"), bases.reverse_complement("seq").alias("seq"), "len"))
    both = both if strands == 2 else rows.select(F.col("offset").alias("at"), "seq", "len")
    b = F.col("seq").cast("binary")
    # a tile grows to a row for each base later: tiles are few bytes, but their number of partitions must not shrink with them
    parts = int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if contig_safe:
        cut = F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1, F.lit(tile).cast("long"))).alias("i")
        tiles = both.select("at", "seq", "len", cut).select((F.col("at") + F.col("i")).alias("start"), F.least(F.lit(tile).cast("long"), F.col("len") - F.col("i")).cast("int").alias("size"), F.substr(b, F.col("i").cast("int") + 1, F.lit(tile + ahead)).cast("string").alias("seq"))
        return Text(tiles.repartition(parts, "start"), length, ahead)
    # a piece goes to every tile that it has bases in, its own stretch or the stretch ahead
    first = F.greatest(F.floor((F.col("at") - ahead) / tile), F.lit(0))
    last = F.floor((F.col("at") + F.col("len") - 1) / tile)
    pieces = both.select("at", "seq", "len", F.explode(F.sequence(first, last)).alias("t"))
    lo = F.greatest(F.col("at"), F.col("t") * tile)
    hi = F.least(F.col("at") + F.col("len"), F.col("t") * tile + tile + ahead)
    pieces = pieces.where(lo < hi).select("t", lo.alias("lo"), F.substr(b, (lo - F.col("at")).cast("int") + 1, (hi - lo).cast("int")).cast("string").alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "part"))), lambda x: x.part), "")
    tiles = pieces.repartition(parts, "t").groupBy("t").agg(joined.alias("seq")).select((F.col("t") * tile).alias("start"), F.least(F.lit(tile).cast("long"), F.lit(strands * length) - F.col("t") * tile).cast("int").alias("size"), "seq")
    return Text(tiles, length, ahead)


def n_runs(contigs: DataFrame) -> DataFrame:
    """start, end of the maximal runs of N in the flat forward text."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offset, size, seq in zip(*(batch.column(c) for c in ("offset", "len", "seq"))):
                ends = np.array([m.span() for m in re.finditer("N+", seq.as_py())], np.int64).reshape(-1, 2)
                whole = (ends[:, 0] > 0) & (ends[:, 1] < size.as_py())
                ends += offset.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.array(whole)], ["start", "end", "whole"])

    flat = contigs.where("seq like '%N%'").select("offset", "len", "seq").mapInArrow(spans, "start long, end long, whole boolean")
    # a run inside a contig is whole; only those at a contig's ends can go on in the next
    return flat.where("whole").select("start", "end").unionByName(merge(flat.where("not whole"), touching=True).select("start", "end"))


def longest(reads: DataFrame, seq: str = "seq") -> int:
    return int(reads.agg(F.coalesce(F.max(F.length(seq)), F.lit(0))).first()[0])


def strand(pos: Column, length: int) -> Column:
    return F.when(pos < length, "+").when(pos < 2 * length, "-")
