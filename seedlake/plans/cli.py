"""Command line: build, info, inspect, keepset, histogram-from-kmc, sa-verify."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators import suffix, text
from ..operators.store import durable
from ..sources import readers, writers
from .index import BuildConfig, Index


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seedlake")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    source = b.add_mutually_exclusive_group(required=True)
    source.add_argument("--fasta")
    source.add_argument("--pac")
    b.add_argument("--out", required=True)
    b.add_argument("--keep-bed")
    b.add_argument("--bloom-rate", type=float)
    b.add_argument("--kmer-table-k", type=int, default=6)
    b.add_argument("--leaves", type=int)
    b.add_argument("--routing-pad", type=int, default=0)
    b.add_argument("--no-mask-n-runs", action="store_true")
    b.add_argument("--mask-homopolymers", type=int, metavar="K")
    b.add_argument("--mask-bed")
    b.add_argument("--prior-bed")
    b.add_argument("--prior-bed-weight", type=float, default=10.0)
    b.add_argument("--prior-fastq-histogram")
    b.add_argument("--prior-fastq-base-weight", type=float, default=1.0)
    for name in ("info", "inspect"):
        sub.add_parser(name).add_argument("index")
    k = sub.add_parser("keepset")
    k.add_argument("--fasta", required=True)
    k.add_argument("--targets", required=True)
    k.add_argument("--out", required=True)
    k.add_argument("--k", type=int, default=32)
    k.add_argument("--max-occ", type=int, default=0)
    k.add_argument("--flank", type=int, default=0)
    k.add_argument("--blocks-per-line", type=int, default=0)
    h = sub.add_parser("histogram-from-kmc")
    h.add_argument("dump")
    h.add_argument("out")
    sub.add_parser("sa-verify").add_argument("--fasta", required=True)
    return p


def check_build(a: argparse.Namespace) -> None:
    """Options of build that don't go together."""
    if a.bloom_rate is not None and not a.keep_bed:
        raise SystemExit("--bloom-rate needs --keep-bed")
    if a.routing_pad and a.bloom_rate is None:
        raise SystemExit("--routing-pad needs --bloom-rate")
    if a.prior_bed and a.prior_bed == a.mask_bed:
        raise SystemExit("--prior-bed and --mask-bed name the same file")
    if a.prior_bed and a.prior_fastq_histogram:
        raise SystemExit("--prior-bed and --prior-fastq-histogram exclude each other")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "build":
        check_build(a)
    spark = spark or SparkSession.builder.appName("seedlake").getOrCreate()
    if a.command == "build":
        if a.fasta:
            contigs = readers.fasta(spark, a.fasta)
        else:
            contigs = readers.pac(spark, a.pac).selectExpr("cast(0 as long) as contig_id", "name", "seq", "len", "cast(0 as long) as offset")
        keep, mask, prior = (readers.bed(spark, path) if path else None for path in (a.keep_bed, a.mask_bed, a.prior_bed))
        histogram = readers.histogram(spark, a.prior_fastq_histogram) if a.prior_fastq_histogram else None
        config = BuildConfig(kmer_table_k=a.kmer_table_k, bloom_rate=a.bloom_rate, leaves=a.leaves, mask_n=not a.no_mask_n_runs, homopolymer=a.mask_homopolymers, prior_weight=a.prior_bed_weight, prior_base=a.prior_fastq_base_weight, routing_pad=a.routing_pad)
        Index.build(contigs, config, keep, mask, prior, histogram).save(a.out)
    elif a.command == "info":
        Index.open(spark, a.index).info().show(100, False)
    elif a.command == "inspect":
        for df in Index.open(spark, a.index).inspect().values():
            df.show(20, False)
    elif a.command == "keepset":
        contigs = readers.fasta(spark, a.fasta)
        runs = Index.keepset(contigs, readers.target_bed(spark, a.targets, contigs), a.k, a.max_occ, a.flank)
        writers.bed12(runs, a.out, a.blocks_per_line) if a.blocks_per_line else writers.bed3(runs, a.out)
    elif a.command == "histogram-from-kmc":
        rows, counters = readers.kmc(spark, a.dump)
        writers.histogram(rows, a.out)
        counters.show()
    else:
        t = text.build(readers.fasta(spark, a.fasta))
        sa = durable(suffix.suffix_array(t))
        wrong = suffix.certify(sa, t)
        print(f"{t.total + 1} ranks, {wrong} out of order")
        return int(wrong > 0 or not suffix.is_permutation(sa))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
