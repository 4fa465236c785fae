"""Interval sets: half-open [start, end) rows, and runs and neighbours in ordered columns.

Every window here is partitioned: by the caller's keys, or by blocks of the coordinate whose edges are carried over in a
second, small step, so that no task gets a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import durable

BLOCK = 1 << 20


def merge(intervals: DataFrame, touching: bool = False, by: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """The union of intervals (by, start, end) as disjoint rows. touching: intervals that only touch become one too.

    Intervals are merged inside blocks of the coordinate first; what is left of a block, at most a row for each gap, is then
    merged by the running end of the blocks before it. Empty intervals are dropped.
    """
    keys = [*by]
    rows = intervals.select(*keys, "start", "end").where("start < end").withColumn("block", F.floor(F.col("start") / block))
    inner = Window.partitionBy(*keys, "block").orderBy("start", "end")
    merged = _islands(rows, inner, [*keys, "block"], touching)
    tops = merged.groupBy(*keys, "block").agg(F.max("end").alias("top"))
    over = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "block", F.max("top").over(over).alias("reach"))
    joined = merged.join(tops, [*keys, "block"])
    # a row that an earlier block reaches over belongs to the last row before it that no earlier block reaches
    own = joined.withColumn("fresh", F.col("reach").isNull() | (F.col("start") > F.col("reach") if touching else F.col("start") >= F.col("reach")))
    starts = own.groupBy(*keys, "block").agg(F.max(F.when(F.col("fresh"), F.col("start"))).alias("last_fresh"))
    back = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*keys, "block", F.max("last_fresh").over(back).alias("before"))
    group = Window.partitionBy(*keys, "block").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    island = F.coalesce(F.max(F.when(F.col("fresh"), F.col("start"))).over(group), F.col("before"))
    return own.join(starts, [*keys, "block"]).withColumn("island", island).groupBy(*keys, "island").agg(F.max("end").alias("end")).select(*keys, F.col("island").alias("start"), "end")


def _islands(rows: DataFrame, order, keys: list[str], touching: bool) -> DataFrame:
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("start") > reach if touching else F.col("start") >= reach
    marked = rows.withColumn("new", F.when(reach.isNull() | apart, 1).otherwise(0)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def pad_and_merge(intervals: DataFrame, pad: int, length: int | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Intervals widened by `pad` on both sides within [0, length), then merged; what becomes empty is dropped."""
    top = F.lit(length) if isinstance(length, int) else length
    rows = intervals.select(*by, F.greatest(F.col("start") - pad, F.lit(0)).alias("start"), F.least(F.col("end") + pad, top).alias("end"))
    return merge(rows, touching=True, by=by)


def runs(points: DataFrame, at: str = "pos", by: tuple[str, ...] = (), flank: int = 0, length: int | None = None) -> DataFrame:
    """Maximal runs of consecutive positions, widened by `flank` and merged."""
    rows = points.select(*by, (F.col(at) - flank).alias("start"), (F.col(at) + 1 + flank).alias("end"))
    rows = rows.select(*by, F.greatest("start", F.lit(0)).alias("start"), (F.least("end", F.lit(length)) if length is not None else F.col("end")).alias("end"))
    return merge(rows, touching=True, by=by)


def covered(points: DataFrame, intervals: DataFrame, at: str = "pos", block: int = 1 << 14, keep: bool = True) -> DataFrame:
    """The rows of points whose place lies in some interval (keep) or in none: a semi (or anti) join on coordinate blocks."""
    cut = merge(intervals).select("start", "end", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("__block"))
    rows = points.withColumn("__block", F.floor(F.col(at) / block)).alias("p")
    inside = (F.col("p.__block") == F.col("i.__block")) & (F.col(f"p.{at}") >= F.col("i.start")) & (F.col(f"p.{at}") < F.col("i.end"))
    return rows.join(cut.alias("i"), inside, "left_semi" if keep else "left_anti").drop("__block")


def fold_doubled(at: Column, length: Column | int) -> Column:
    """A doubled place on the forward strand; the end marker and anything past it: null."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.when(at < n, at).when(at < 2 * n, 2 * n - 1 - at)


def keep_doubled(points: DataFrame, intervals: DataFrame, length: int, at: str = "pos") -> DataFrame:
    """Rows whose doubled place, folded, lies in an interval, and the end marker's."""
    folded = points.withColumn("__at", fold_doubled(F.col(at), length))
    inside = covered(folded.where("__at is not null"), intervals, "__at")
    return inside.drop("__at").unionByName(points.where(F.col(at) == 2 * length))


def neighbours(rows: DataFrame, order: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with next_<value> and prev_<value>: the nearest non-null value after and before each row."""
    w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    after, before = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(f"next_{value}", F.first(value, ignorenulls=True).over(after)).withColumn(f"prev_{value}", F.last(value, ignorenulls=True).over(before))


def global_offsets(rows: DataFrame, order: list[str], value: str, out: str = "offset") -> DataFrame:
    """rows with the sum of `value` over all rows before them: a range sort, a running sum in each partition, and the
    partitions' totals (a row for each partition). What the sort deals out is kept, as its sampled bounds may differ the
    next time."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id())
    dealt = durable(dealt)
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("__own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    totals = dealt.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    return dealt.join(totals, "__part").withColumn(out, (F.col("__own") + F.col("__before")).cast("long")).drop("__part", "__own", "__before")
