"""Writers of interval files, k-mer histograms and 2-bit sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import global_offsets


def bed3(runs: DataFrame, path: str, name: str = "ref") -> None:
    """One line an interval, in order."""
    lines = runs.orderBy("start").select(F.concat_ws("\t", F.lit(name), "start", "end").alias("value"))
    lines.write.text(path)


def bed12_lines(runs: DataFrame, per_line: int, name: str = "ref") -> DataFrame:
    """start, value: the lines of a BED12 file, `per_line` runs a line."""
    if per_line < 1:
        raise ValueError("a line needs one block or more")
    rows = global_offsets(runs.select("start", "end").withColumn("one", F.lit(1)), ["start"], "one", "i").withColumn("group", F.floor(F.col("i") / per_line))
    b = F.array_sort(F.collect_list(F.struct("start", "end")))
    g = rows.groupBy("group").agg(b.alias("b"), F.min("start").alias("s"), F.max("end").alias("e"))
    sizes = F.array_join(F.transform("b", lambda x: x.end - x.start), ",")
    starts = F.array_join(F.transform("b", lambda x: x.start - F.col("s")), ",")
    return g.select(F.col("s").alias("start"), F.concat_ws("\t", F.lit(name), "s", "e", F.lit("keep"), F.lit("0"), F.lit("+"), "s", "e", F.lit("0"), F.size("b"), sizes, starts).alias("value"))


def bed12(runs: DataFrame, path: str, per_line: int = 1000, name: str = "ref") -> None:
    bed12_lines(runs, per_line, name).orderBy("start").select("value").write.text(path)


def histogram(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws("\t", F.col("key").cast("string"), F.col("count").cast("string")).alias("value")).write.text(path)


def pack_pac(seq: Column) -> Column:
    """Bases as 2-bit bytes, other letters as A, with a last byte that holds the number of bases modulo 4."""

    def step(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes = np.zeros(256, np.uint8)
        for i, c in enumerate("ACGT"):
            codes[ord(c)] = codes[ord(c.lower())] = i
        for p in parts:
            out = []
            for s in p:
                raw = codes[np.frombuffer(s.encode(), np.uint8)]
                body = np.zeros(4 * (len(raw) // 4 + 1), np.uint8)
                body[: len(raw)] = raw
                q = body.reshape(-1, 4)
                out.append((q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]).astype(np.uint8).tobytes() + bytes([len(raw) % 4]))
            yield pd.Series(out)

    return F.pandas_udf(step, "binary")(seq)
