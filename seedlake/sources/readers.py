"""Readers of sequence formats, as DataFrames with fixed schemas; malformed input raises when it is read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import global_offsets, merge


def refuse(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """df, which raises `message` and the row's `line` at the first row where bad holds."""
    flag = F.when(bad, F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce(F.col("line").cast("string"), F.lit("null")))).cast("boolean")).otherwise(F.lit(True))
    return df.where(flag)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """no, line: the lines of one text file in order. Lines come in file order from byte-range splits."""
    rows = spark.read.text(path).withColumn("__at", F.monotonically_increasing_id()).withColumn("one", F.lit(1))
    return global_offsets(rows, ["__at"], "one", "no").select("no", F.col("value").alias("line"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig_id, name, seq (as written, upper case), len, offset. Repeated names are refused, as is text before a header.

    Lines are joined contig by contig; a contig is one row, so it must fit in memory once.
    """
    rows = numbered(spark, path).withColumn("line", F.rtrim("line")).where("line <> ''").withColumn("head", F.startswith("line", F.lit(">")).cast("int"))
    rows = global_offsets(rows, ["no"], "head", "before")
    rows = refuse(rows, (F.col("before") == 0) & (F.col("head") == 0), "sequence before the first header")
    rows = rows.withColumn("contig_id", F.col("before") + F.col("head") - 1)
    parts = F.array_sort(F.collect_list(F.when(F.col("head") == 0, F.struct("no", F.upper("line").alias("s")))))
    found = rows.groupBy("contig_id").agg(F.max(F.when(F.col("head") == 1, F.regexp_extract("line", r"^>\s*(\S*)", 1))).alias("name"), F.array_join(F.transform(parts, lambda x: x.s), "").alias("seq"))
    if not found.groupBy("name").count().where("count > 1").isEmpty():
        raise ValueError("a contig name is repeated")
    found = found.withColumn("len", F.length("seq").cast("long"))
    return global_offsets(found, ["contig_id"], "len").select("contig_id", "name", "seq", "len", "offset")


def fasta_stats(contigs: DataFrame) -> DataFrame:
    """contigs, bases, n_bases."""
    n = F.length(F.regexp_replace("seq", "[ACGTacgt]", ""))
    return contigs.agg(F.count("*").alias("contigs"), F.coalesce(F.sum("len"), F.lit(0)).alias("bases"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n_bases"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of whole files (one row's content each)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """rid, qname, seq, qual of four-line records, strictly."""
    rows = numbered(spark, path).withColumn("rid", F.floor(F.col("no") / 4)).withColumn("k", F.col("no") % 4)
    rec = rows.groupBy("rid").agg(*[F.max(F.when(F.col("k") == i, F.col("line"))).alias(c) for i, c in enumerate(("head", "seq", "plus", "qual"))]).withColumn("line", F.col("head"))
    bad = ~F.startswith("head", F.lit("@")) | F.col("plus").isNull() | ~F.startswith("plus", F.lit("+")) | F.col("qual").isNull() | (F.length("seq") != F.length("qual"))
    return refuse(rec, F.coalesce(bad, F.lit(True)), "malformed FASTQ record").select("rid", F.regexp_extract("head", r"^@(\S*)", 1).alias("qname"), F.upper("seq").alias("seq"), "qual")


def unpack_pac(content: Column) -> Column:
    """The bases of a 2-bit file: four a byte, high bits first, a last byte with the number of bases modulo 4."""

    def step(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        letters = np.frombuffer(b"ACGT", np.uint8)
        for p in parts:
            out = []
            for b in p:
                raw = np.frombuffer(b, np.uint8)
                if len(raw) < 2 or raw[-1] > 3:
                    raise ValueError("malformed pac file")
                body = raw[:-1]
                n = 4 * (len(body) - 1) + int(raw[-1])
                codes = (body[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
                out.append(letters[codes.ravel()[:n]].tobytes().decode())
            yield pd.Series(out)

    return F.pandas_udf(step, "string")(content)


def pac(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, len, sha256 of 2-bit files."""
    rows = spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), unpack_pac(F.col("content")).alias("seq"), F.sha2("content", 256).alias("sha256"))
    return rows.select("name", "seq", F.length("seq").cast("long").alias("len"), "sha256")


def check_pac(size: int, bases: int, expected: int) -> None:
    if bases != expected:
        raise ValueError(f"the pac file holds {bases} bases, the index {expected}")
    if size < bases // 4 + 1:
        raise ValueError("the pac file is too short")


def _fields(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and line not like '#%'")
    return rows.where(~F.col("line").rlike(r"^(track|browser)(\s|$)")).select("line", F.split("line", r"\s+").alias("f"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """start, end: a BED file's intervals in flat coordinates, merged where they overlap (touching ones stay apart).

    Of 12 columns and more the blocks count, else the whole interval. The first column is not looked at.
    """
    rows = _fields(spark, path)
    rows = refuse(rows, F.size("f") < 3, "a BED line needs three columns")
    whole = rows.where(F.size("f") < 12).select("line", F.get("f", F.lit(1)).cast("long").alias("start"), F.get("f", F.lit(2)).cast("long").alias("end"))
    whole = refuse(whole, F.col("end") <= F.col("start"), "empty BED interval")
    lists = lambda i: F.transform(F.split(F.rtrim(F.get("f", F.lit(i)), F.lit(",")), ","), lambda x: x.cast("long"))
    twelve = rows.where(F.size("f") >= 12).select("line", F.get("f", F.lit(1)).cast("long").alias("s"), F.get("f", F.lit(2)).cast("long").alias("e"), F.get("f", F.lit(9)).cast("int").alias("k"), lists(10).alias("sizes"), lists(11).alias("starts"))
    twelve = refuse(twelve, (F.size("sizes") != F.col("k")) | (F.size("starts") != F.col("k")), "wrong number of BED blocks")
    blocks = twelve.select("line", "s", "e", F.explode(F.arrays_zip("sizes", "starts")).alias("b"))
    blocks = blocks.select("line", (F.col("s") + F.col("b.starts")).alias("start"), (F.col("s") + F.col("b.starts") + F.col("b.sizes")).alias("end"), "e")
    blocks = refuse(blocks, (F.col("end") <= F.col("start")) | (F.col("end") > F.col("e")), "bad BED block")
    return merge(whole.select("start", "end").unionByName(blocks.select("start", "end")))


def target_bed(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """start, end in flat coordinates of a three-column BED file; unknown contigs and ends past a contig are refused."""
    rows = refuse(_fields(spark, path), F.size("f") != 3, "a target line has exactly three columns")
    rows = rows.select("line", F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).cast("long").alias("s"), F.get("f", F.lit(2)).cast("long").alias("e"))
    rows = rows.join(contigs.select("name", "offset", "len"), "name", "left")
    rows = refuse(rows, F.col("offset").isNull() | (F.col("e") <= F.col("s")) | (F.col("e") > F.col("len")), "bad target")
    return rows.select((F.col("offset") + F.col("s")).alias("start"), (F.col("offset") + F.col("e")).alias("end"))


def histogram(spark: SparkSession, path: str) -> DataFrame:
    """key DECIMAL(20,0), count of a two-column file; comments are skipped, repeated keys refused."""
    rows = spark.read.text(path).select(F.col("value").alias("line")).where("trim(line) <> '' and line not like '#%'").withColumn("f", F.split("line", "\t"))
    rows = refuse(rows, (F.size("f") != 2) | ~F.col("line").rlike(r"^\d{1,20}\t\d{1,19}$"), "malformed histogram line")
    found = rows.select(F.get("f", F.lit(0)).cast("decimal(20,0)").alias("key"), F.get("f", F.lit(1)).cast("long").alias("count"))
    if not found.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        raise ValueError("a histogram key is repeated")
    return found


def kmc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(key, kmer, count) of a k-mer dump, and one row of counters: lines kept, of a wrong length, with other letters, with a bad count."""
    from ..functions import bases

    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.get("f", F.lit(0)) != '').select(F.upper(F.get("f", F.lit(0))).alias("kmer"), F.get("f", F.lit(1)).alias("n"))
    kind = F.when(F.length("kmer") != 32, "length").when(~F.col("kmer").rlike("^[ACGT]+$"), "letters").when(~F.coalesce(F.col("n").rlike(r"^\d{1,18}$"), F.lit(False)), "count").otherwise("kept")
    rows = rows.withColumn("kind", kind)
    counters = rows.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("kept", "length", "letters", "count")])
    return rows.where("kind = 'kept'").select(bases.key_number("kmer").alias("key"), "kmer", F.col("n").cast("long").alias("count")), counters


def sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, rname, pos, mapq, cigar of a SAM file's lines."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("value not like '@%' and trim(value) <> ''")
    return rows.select(F.get(f, F.lit(0)).alias("qname"), F.get(f, F.lit(1)).cast("int").alias("flag"), F.get(f, F.lit(2)).alias("rname"), F.get(f, F.lit(3)).cast("long").alias("pos"), F.get(f, F.lit(4)).cast("int").alias("mapq"), F.get(f, F.lit(5)).alias("cigar"))


def present(spark: SparkSession, path: str) -> DataFrame:
    """qname, present of a table with a header; only 0 and 1, no repeated qname."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.split("value", "\t").alias("f")).where((F.get("f", F.lit(0)) != 'qname') & (F.trim('line') != ''))
    rows = refuse(rows, (F.size("f") != 2) | ~F.get("f", F.lit(1)).isin("0", "1"), "malformed present line")
    found = rows.select(F.get("f", F.lit(0)).alias("qname"), (F.get("f", F.lit(1)) == "1").alias("present"))
    if not found.groupBy("qname").count().where("count > 1").isEmpty():
        raise ValueError("a qname is repeated")
    return found


