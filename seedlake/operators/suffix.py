"""Suffix ranks of a doubled text, and tables that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bases
from . import scan
from .intervals import global_offsets
from .store import durable
from .text import Text

FIRST = 32


def suffix_array(text: Text) -> DataFrame:
    """rank, pos of every suffix, the end marker's (rank 0) with them.

    Prefix doubling: ranks by the first 32 bases are refined by the rank 32, 64, ... bases on, until none is shared; only
    suffixes that still share their rank are looked at, and written, again.
    """
    heads = text.suffixes(FIRST)
    order = global_offsets(heads.groupBy("w").agg(F.count("*").alias("n")), ["w"], "n", "below")
    last = durable(heads.join(order, "w").select("pos", (F.col("below") + 1).alias("rank"), "n"))
    settled, step = last.where("n = 1").select("pos", "rank"), FIRST
    while not (tied := last.where("n > 1")).isEmpty():
        after = settled.unionByName(tied.select("pos", "rank")).select((F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        seen = durable(tied.join(after, "pos", "left").select("pos", "rank", F.coalesce("next", F.lit(0)).alias("next")))
        groups = seen.groupBy("rank", "next").agg(F.count("*").alias("n"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last = durable(seen.join(groups.withColumn("below", below), ["rank", "next"]).select("pos", (F.col("rank") + F.col("below")).alias("rank"), "n"))
        settled = settled.unionByName(last.where("n = 1").select("pos", "rank"))
        step *= 2
    end = settled.sparkSession.range(1).select(F.lit(text.total).cast("long").alias("pos"), F.lit(0).cast("long").alias("rank"))
    return settled.unionByName(end).select("rank", "pos")


def with_keys(sa: DataFrame, text: Text) -> DataFrame:
    """sa with key: the first 32 bases of each suffix, filled up with T."""
    keys = text.suffixes(bases.KEY).select("pos", bases.tokenize(F.col("w").cast("string")).alias("key"))
    return sa.join(keys, "pos", "left").select("rank", "pos", F.coalesce("key", F.lit("T" * bases.KEY)).alias("key"))


def full_key_length(text: Text) -> int:
    """Places before this one have a whole window; the one that ends on the end marker counts as whole."""
    return text.total + 1 - bases.KEY + 1


def inverse(sa: DataFrame) -> DataFrame:
    return sa.select("pos", "rank")


def is_permutation(sa: DataFrame) -> bool:
    """Whether pos and rank both run over 0 to count - 1 without a gap or a repeat."""
    r = sa.agg(F.count("*").alias("n"), F.countDistinct("rank").alias("r"), F.countDistinct("pos").alias("p"), F.max("rank").alias("mr"), F.max("pos").alias("mp"), F.min("rank").alias("lr"), F.min("pos").alias("lp")).first()
    return r.n == r.r == r.p == (r.mr or 0) + 1 == (r.mp or 0) + 1 and r.lr == r.lp == 0


def certify(sa: DataFrame, text: Text) -> int:
    """How many neighbours in rank are out of order, judged by bases and by the ranks of what follows: 0 for a right order."""
    heads = sa.join(text.suffixes(1), "pos", "left").select("rank", "pos", F.coalesce("w", F.lit("").cast("binary")).alias("b"))
    after = sa.select((F.col("pos") - 1).alias("pos"), F.col("rank").alias("rest"))
    rows = heads.join(after, "pos", "left").select("rank", F.struct("b", F.coalesce("rest", F.lit(-1)).alias("rest")).alias("x"))
    next_ = rows.select((F.col("rank") - 1).alias("rank"), F.col("x").alias("y"))
    return rows.join(next_, "rank").where("x >= y").count()


def positions(sa: DataFrame, intervals: DataFrame, step: int = 1, most: int | None = None) -> DataFrame:
    """The places of rank intervals (qid, sa_start, occ): all, or every `step`-th, at most `most` of each. Joined by rank."""
    n = F.floor((F.col("occ") + (step - 1)) / step)
    n = n if most is None else F.least(n, F.lit(most))
    ranks = F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i")
    rows = intervals.where("occ > 0").select("qid", "sa_start", ranks).select("qid", (F.col("sa_start") + F.col("i") * step).alias("rank"))
    return rows.join(sa, "rank").select("qid", "rank", "pos")


def kmer_table(text: Text, k: int) -> DataFrame:
    """m, w, lo, hi: the rank interval of every m-mer, m = 1 to k (k at most 8: 4^k rows); an m-mer that doesn't occur has
    lo = hi, the place where it would stand."""
    if not 1 <= k <= 8:
        raise ValueError("k must be 1 to 8")
    spark = text.tiles.sparkSession
    counts = durable(scan.mers(text, k).select(F.col("w").cast("string").alias("w"), "n"))
    out = None
    for m in range(1, k + 1):
        all_ = spark.range(4**m).select(F.translate(F.lpad(F.conv(F.col("id").cast("string"), 10, 4), m, "0"), "0123", "ACGT").alias("w"), F.lit(0).cast("long").alias("n"))
        own = counts.select(F.left("w", F.lit(m)).alias("w"), "n").unionByName(all_).groupBy("w").agg(F.sum("n").alias("n"))
        # 4^m m-mers and the shorter ends of the text: a constant number of rows
        below = F.coalesce(F.sum("n").over(Window.orderBy("w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
        rows = own.withColumn("lo", below).where(F.length("w") == m).select(F.lit(m).alias("m"), bases.lex_index("w").alias("w"), "lo", (F.col("lo") + F.col("n")).alias("hi"))
        out = rows if out is None else out.unionByName(rows)
    return out
