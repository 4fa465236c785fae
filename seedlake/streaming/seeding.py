"""Streams of reads against a fixed index: each micro-batch is one batch query. No state is kept between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import gates, smem
from ..operators.text import Text
from ..plans.index import Index


def seed_stream(reads: DataFrame, text: Text | Index, out: str, checkpoint: str, options: smem.Options = smem.Options(), once: bool = True) -> StreamingQuery:
    """Writes the seeds of a stream of reads (rid, seq) to `out`, one folder a batch, so a batch that is run again replaces itself.
    text: a kept index answers every batch by lookups, and reads the blocks of its tables that the batch's reads need; without one, a
    text is read anew in every batch."""

    def batch(rows: DataFrame, number: int) -> None:
        found = text.collect_smems(rows, options, False) if isinstance(text, Index) else smem.collect(text, rows, options)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _start(reads, batch, checkpoint, once)


def gate_stream(reads: DataFrame, keys: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes rid, present of a stream of reads."""

    def batch(rows: DataFrame, number: int) -> None:
        gates.present_first(rows, keys).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _start(reads, batch, checkpoint, once)


def rates(events: DataFrame, time: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """start, n, present: reads and hits per window of event time, late rows past the watermark left out."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("present")).alias("present")).select(F.col("w.start").alias("start"), "n", "present")


def _start(reads: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    w = reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
