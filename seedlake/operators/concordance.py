"""Concordance of two alignments of the same reads, and of two seedings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALIGNMENT = "qname string, flag int, rname string, pos long, mapq int, cigar string"
EXTRA = 0x900


def primaries(aln: DataFrame) -> DataFrame:
    """One primary a qname, with n_extra: its secondary and supplementary lines. Paired reads and second primaries are refused."""
    if not aln.where(F.col("flag").bitwiseAND(1) != 0).isEmpty():
        raise ValueError("paired reads are not supported")
    first = aln.where(F.col("flag").bitwiseAND(EXTRA) == 0)
    if not first.groupBy("qname").count().where("count > 1").isEmpty():
        raise ValueError("a read has more than one primary alignment")
    extra = aln.where(F.col("flag").bitwiseAND(EXTRA) != 0).groupBy("qname").agg(F.count("*").alias("n_extra"))
    rows = first.join(extra, "qname", "left").withColumn("n_extra", F.coalesce("n_extra", F.lit(0)).cast("long"))
    return rows.withColumn("unmapped", F.col("flag").bitwiseAND(4) != 0)


def same_cohort(a: DataFrame, b: DataFrame, what: str, key: str = "qname") -> None:
    missing, extra = b.join(a, key, "left_anti").count(), a.join(b, key, "left_anti").count()
    if missing or extra:
        raise ValueError(f"{what}: {missing} reads are missing, {extra} are too many")


def compare(fast: DataFrame, full: DataFrame, present: DataFrame) -> DataFrame:
    """qname, present, and what agrees between the primaries of both. Both must hold the same reads, and each must have its gate."""
    same_cohort(fast, full, "fast alignments")
    missing = full.join(present, "qname", "left_anti").count()
    if missing:
        raise ValueError(f"gate: {missing} reads are missing")
    side = lambda df, x: df.select("qname", *[F.col(c).alias(f"{c}_{x}") for c in ("unmapped", "rname", "pos", "cigar", "mapq", "n_extra")])
    rows = side(fast, "a").join(side(full, "b"), "qname").join(present.select("qname", "present"), "qname")
    none = F.col("unmapped_a") & F.col("unmapped_b")
    both = ~F.col("unmapped_a") & ~F.col("unmapped_b")
    pos = both & (F.col("rname_a") == F.col("rname_b")) & (F.col("pos_a") == F.col("pos_b"))
    place = pos & (F.col("cigar_a") == F.col("cigar_b"))
    delta = F.when(place & (F.col("mapq_a") != F.col("mapq_b")), F.col("mapq_a") - F.col("mapq_b"))
    return rows.select(
        "qname", "present", none.alias("both_unmapped"), (none | pos).alias("pos_same"), (none | place).alias("placement_same"),
        (F.col("unmapped_a") != F.col("unmapped_b")).alias("status_differs"), (place & (F.col("mapq_a") == F.col("mapq_b"))).alias("mapq_same"),
        delta.alias("mapq_delta"), (F.col("n_extra_a") != F.col("n_extra_b")).alias("extra_differs"),
    )


def report(compared: DataFrame) -> DataFrame:
    """Counts for present, absent and all reads (grouping sets); partition says which."""
    n = lambda c: F.count_if(F.col(c)).alias(c)
    rows = compared.rollup("present").agg(F.grouping("present").alias("g"), F.count("*").alias("n"), n("placement_same"), n("pos_same"), n("both_unmapped"), n("status_differs"), n("mapq_same"), F.count("mapq_delta").alias("mapq_differs"), n("extra_differs"))
    return rows.select(F.when(F.col("g") == 1, "all").when(F.col("present"), "present").otherwise("absent").alias("partition"), *[c for c in rows.columns if c not in ("present", "g")])


def mapq_deltas(compared: DataFrame) -> DataFrame:
    return compared.where("mapq_delta is not null").groupBy("mapq_delta").agg(F.count("*").alias("n"))


def seed_differences(fast: DataFrame, full: DataFrame) -> DataFrame:
    """rid, m, n, kind: seeds that only one side has (only_fast, only_full) or that occur differently often (occ); as bags."""
    side = lambda df, x: df.groupBy("rid", "m", "n", "s").agg(F.count("*").alias(x))
    rows = side(fast, "a").join(side(full, "b"), ["rid", "m", "n", "s"], "full_outer")
    only = rows.where(F.coalesce("a", F.lit(0)) != F.coalesce("b", F.lit(0))).withColumn("more", F.when(F.coalesce("a", F.lit(0)) > F.coalesce("b", F.lit(0)), "fast").otherwise("full"))
    kinds = only.groupBy("rid", "m", "n").agg(F.collect_set("more").alias("k"))
    return kinds.select("rid", "m", "n", F.when(F.size("k") == 2, "occ").otherwise(F.concat(F.lit("only_"), F.element_at("k", 1))).alias("kind"))
