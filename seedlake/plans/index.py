"""The index as one object: build it from contigs, save and open it, and ask it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases
from ..operators import gates, indexed, keepset, learned, passes, places, ranks, search, smem, suffix, text
from ..operators.intervals import keep_doubled, pad_and_merge
from ..operators.store import durable

FORMAT = 2
TABLES = ("tiles", "contigs", "sa", "kmt", "l2", "l1", "bloom", "ranks", "tree", "places")
#: What tables are stored by, so that a search reads only the parts that it needs.
STORED_BY = {"tiles": "part", "ranks": "block"}


class FormatError(ValueError):
    """An index folder that this version can't read."""


class IndexMismatch(ValueError):
    """Tables of an index that don't belong together."""


def digest_of(tiles: DataFrame) -> str:
    """A digest of the indexed text that doesn't depend on the order of its rows."""
    return str(tiles.agg(F.coalesce(F.sum(F.xxhash64("start", "seq").cast("decimal(38,0)")), F.lit(0))).first()[0])


@dataclass(frozen=True)
class BuildConfig:
    ahead: int = 512
    contig_safe: bool = False
    kmer_table_k: int = 6
    store_sa: bool = True
    #: The tree of ranks, by which searches go without reading the text; of places, every so many stretches of 32 are kept.
    tree: bool = True
    places_every: int = 1
    train: bool = True
    bloom_rate: float | None = None
    leaves: int | None = None
    threshold: int = 1000
    partial: int = 20
    mask_n: bool = True
    homopolymer: int | None = None
    prior_weight: float = 10.0
    prior_base: float = 1.0
    routing_pad: int = 0

    def __post_init__(self):
        if self.prior_weight <= 0 or self.prior_base <= 0:
            raise ValueError("prior weights must be over 0")
        if self.routing_pad < 0 or self.routing_pad and not self.bloom_rate:
            raise ValueError("routing_pad widens what the Bloom filter holds: it needs bloom_rate")
        if self.bloom_rate is not None and not 0 < self.bloom_rate < 1:
            raise ValueError("bloom_rate must lie between 0 and 1")
        if self.train and not self.store_sa:
            raise ValueError("training needs the suffix array")
        if self.places_every < 1:
            raise ValueError("places_every must be 1 or more")


class Index:
    """Tables of one text. Every query is a DataFrame; nothing is run before an action but what a method says."""

    def __init__(self, spark: SparkSession, meta: dict, tables: dict[str, DataFrame]):
        self.spark, self.meta, self.tables = spark, meta, tables
        self.text = text.Text(tables["tiles"], meta["length"], meta["ahead"], meta["part"])
        self.ranks = ranks.Ranks(tables["ranks"], tables["tree"], tables["places"], meta["total"] + 1, meta["cap"], meta["every"]) if "ranks" in tables else None

    @staticmethod
    def build(contigs: DataFrame, config: BuildConfig = BuildConfig(), keep: DataFrame | None = None, mask: DataFrame | None = None, prior: DataFrame | None = None, histogram: DataFrame | None = None) -> Index:
        """keep: forward intervals; a tiered index learns and gates on the places in them only (the gate's widened by routing_pad).
        mask: doubled intervals whose places the model doesn't learn, besides windows over N (mask_n) and with long runs of one base
        (homopolymer). prior: doubled intervals that weigh prior_weight; or histogram (key, count), which weighs keys."""
        if prior is not None and histogram is not None:
            raise ValueError("weights come from intervals or from a histogram, not from both")
        if config.routing_pad and keep is None:
            raise ValueError("routing_pad needs intervals to keep")
        spark, tables = contigs.sparkSession, {"contigs": contigs.select("contig_id", "name", "len", "offset")}
        t = text.build(contigs, config.ahead, config.contig_safe).parted()
        tables["tiles"] = durable(t.tiles)
        t = text.Text(tables["tiles"], t.length, t.ahead, t.part)
        meta = {"format": FORMAT, "part": t.part, "length": t.length, "total": t.total, "ahead": t.ahead, "digest": digest_of(tables["tiles"]), "tiered": keep is not None, "masked": mask is not None, "prior": "intervals" if prior is not None else "histogram" if histogram is not None else None, "config": asdict(config)}
        if config.kmer_table_k:
            tables["kmt"] = suffix.kmer_table(t, config.kmer_table_k)
        if config.store_sa:
            tables["sa"] = durable(suffix.suffix_array(t))
        if config.store_sa and config.tree and not config.contig_safe:  # there windows end with their contig, so ranks don't follow from what comes later
            tree = ranks.build(t, tables["sa"], config.places_every)
            tables |= {"ranks": tree.ranks, "tree": tree.tree, "places": tree.places}
            meta |= {"cap": tree.cap, "every": tree.every}
        if config.train:
            runs = text.n_runs(contigs) if config.mask_n else None
            pairs = learned.training_set(tables["sa"], t, mask=mask, keep=keep, n_windows=runs, homopolymer=config.homopolymer)
            if prior is not None:
                pairs = learned.bed_weights(pairs, prior, config.prior_weight)
            if histogram is not None:
                pairs = learned.histogram_weights(pairs, histogram, config.prior_base)
            pairs = durable(pairs)
            n = keep_doubled(tables["sa"], keep, t.length).count() if keep is not None else t.total + 1
            model = learned.train(pairs, n, learned.Config(config.leaves, config.threshold, config.partial))
            tables["l2"], tables["l1"] = model.l2, model.l1
            meta |= {"leaves": model.leaves, "ranks": n, "max_error": learned.max_error_bound(model, pairs)}
        if config.bloom_rate:
            keys = t.windows(32).select("w").distinct() if keep is None else _kept_windows(t, pad_and_merge(keep, config.routing_pad, t.length))
            params = gates.BloomParams.for_keys(keys.count(), config.bloom_rate)
            tables["bloom"] = gates.bloom_blocks(keys, params)
            meta |= {"bloom_bits": params.bits, "bloom_hashes": params.hashes}
        return Index(spark, meta, tables)

    def save(self, path: str) -> None:
        """Parquet tables under path; sa in order of rank, tiles and ranks in folders by what searches read them by."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for name, df in self.tables.items():
            if name == "sa":
                df.repartitionByRange(n, "rank").sortWithinPartitions("rank").write.parquet(f"{path}/{name}")
            elif by := STORED_BY.get(name):
                first = "start" if name == "tiles" else "node"
                df.repartitionByRange(n, by, first).sortWithinPartitions(by, first).write.partitionBy(by).parquet(f"{path}/{name}")
            else:
                df.write.parquet(f"{path}/{name}")
        meta = self.spark.createDataFrame([(json.dumps(self.meta | {"tables": sorted(self.tables)}),)], "value string")
        meta.coalesce(1).write.text(f"{path}/meta")

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        """Reads what the index says of itself and no table; validate() holds the tables against it."""
        meta = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/meta").collect()))
        if meta.get("format") != FORMAT:
            raise FormatError(f"format {meta.get('format')}, not {FORMAT}")
        unknown = set(meta["tables"]) - set(TABLES)
        if unknown:
            raise FormatError(f"unknown tables {sorted(unknown)}")
        return Index(spark, meta, {t: spark.read.parquet(f"{path}/{t}") for t in meta["tables"]})

    def validate(self) -> None:
        """Passes over all tiles, contigs and ranks: IndexMismatch where they don't belong to this index."""
        length = self.tables["contigs"].agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
        if length != self.meta["length"]:
            raise IndexMismatch(f"contigs hold {length} bases, the index {self.meta['length']}")
        if (found := digest_of(self.tables["tiles"])) != self.meta["digest"]:
            raise IndexMismatch(f"the text's digest is {found}, the index's {self.meta['digest']}")
        if "sa" in self.tables and (n := self.tables["sa"].count()) != self.meta["total"] + 1:
            raise IndexMismatch(f"{n} ranks for a text of {self.meta['total']} bases")

    def cache(self) -> Index:
        for df in self.tables.values():
            df.persist()
        return self

    def release(self) -> None:
        for df in self.tables.values():
            df.unpersist()

    def register(self, prefix: str = "idx_") -> None:
        """The tables as temporary views for SQL."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(f"{prefix}{name}")

    @property
    def model(self) -> learned.Model:
        return learned.Model(self.tables["l2"], self.tables["l1"], self.meta["leaves"], self.meta["ranks"])

    @property
    def keys(self) -> DataFrame:
        return self.text.windows(32).select("w")

    def info(self) -> DataFrame:
        return self.spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(self.meta.items())], "name string, value string")

    def inspect(self) -> dict[str, DataFrame]:
        return learned.inspect(self.model)

    def lookup(self, keys: DataFrame) -> DataFrame:
        return self.model.lookup(keys)

    def sa_positions(self, intervals: DataFrame, step: int = 1, most: int | None = None) -> DataFrame:
        return suffix.positions(self.tables["sa"], intervals, step, most)

    @property
    def searcher(self):
        """The learned model for lookups, where the index has one for all its ranks."""
        return self.model if "l2" in self.tables and self.meta["ranks"] == self.meta["total"] + 1 else None

    def isa_at(self, positions: DataFrame) -> DataFrame:
        """positions (pos) with their rank, null where there is no such place."""
        if self.ranks is not None:
            return ranks.isa_at(self.ranks, self.text, positions, self.searcher)
        if "sa" not in self.tables:
            return positions.join(places.ranks_at(self.text, positions), "pos", "left")
        return positions.join(suffix.inverse(self.tables["sa"]), "pos", "left")

    def key_at(self, rows: DataFrame) -> DataFrame:
        """rows (rank) with pos and key (text) of the suffix, null where there is no such rank."""
        if self.ranks is None:
            return rows.join(suffix.with_keys(self.tables["sa"], self.text), "rank", "left")
        found = self.text.at(ranks.at_ranks(self.ranks, rows.select("rank").distinct(), "pos"), bases.KEY)
        return rows.join(found.select("rank", "pos", bases.tokenize(F.col("w").cast("string")).alias("key")), "rank", "left")

    def intervals(self, patterns: DataFrame) -> DataFrame:
        return search.intervals(self.text, patterns) if self.ranks is None else indexed.intervals(self.ranks, patterns, self.searcher)

    def kmer_exists(self, patterns: DataFrame) -> DataFrame:
        if self.ranks is None:
            return search.kmer_exists(self.text, patterns)
        return self.intervals(patterns).select("pattern", (F.col("occ") > 0).alias("found"))

    def mem_search(self, queries: DataFrame, most_occ: int | None = None) -> DataFrame:
        if self.ranks is None:
            return search.mem_search(self.text, queries, True, most_occ)
        found = indexed.mem_search(self.ranks, self.text, queries, self.searcher)
        if most_occ is None:
            return found
        return found.withColumn("sa_start", F.when(F.col("occ") <= most_occ, F.col("sa_start"))).withColumn("occ", F.least("occ", F.lit(most_occ + 1)))

    def mem_search_backward(self, anchors: DataFrame) -> DataFrame:
        return search.mem_search_backward(self.text, anchors)

    def mem_search_warmstart(self, queries: DataFrame) -> DataFrame:
        """As mem_search: a hint changes no result, and a lookup needs no place to start from."""
        return self.mem_search(queries.drop("hint"))

    def mem_search_from_hint(self, queries: DataFrame, interval: bool = False) -> DataFrame:
        return search.from_hint(self.text, self.tables["sa"], queries, interval)

    def mem_search_backward_from_hint(self, anchors: DataFrame, interval: bool = False) -> DataFrame:
        return search.backward_from_hint(self.text, self.tables["sa"], anchors, interval)

    def backward_truncated(self, anchors: DataFrame) -> DataFrame:
        """qid, match_len, sa_start, occ for anchors (qid, seq, pivot, anchor, least_occ)."""
        if self._by_passes():
            return passes.backward_truncated(self.text, anchors)
        return indexed.backward_truncated(self.ranks, self.text, anchors, self.searcher)

    def anchored(self, anchors: DataFrame) -> DataFrame:
        """qid, pos: a place of each anchor (qid, seq, pivot, anchor) in its longest extension to the left; none for anchors that don't occur."""
        if self._by_passes():
            return passes.anchored(self.text, anchors)
        top = indexed.turned(self.ranks, self.text, indexed.leftmost(self.ranks, self.text, anchors, self.searcher)).withColumnRenamed("id", "qid")
        return top.join(anchors.select("qid", "anchor"), "qid").select("qid", (F.col("pos") + F.col("size") - F.col("anchor")).alias("pos"))

    def _by_passes(self) -> bool:
        """Whether the text is asked itself. An index that was built with the tree of ranks must have it."""
        if self.ranks is None and "cap" in self.meta:
            raise ValueError("this needs the tree of ranks that the index was built with")
        return self.ranks is None

    def _counts(self, queries: DataFrame) -> DataFrame | None:
        return None if self.ranks is None else durable(indexed.counts(self.ranks, indexed.best(self.ranks, self.text, queries, self.searcher)))

    def truncated(self, queries: DataFrame, least_occ: int, anchor: int = 0) -> DataFrame:
        return search.truncated(self.text, queries, least_occ, anchor, self._counts(queries))

    def truncate_below_maximal(self, queries: DataFrame, least_occ: int) -> DataFrame:
        return search.truncate_below_maximal(self.text, queries, least_occ, self._counts(queries))

    def first_below(self, queries: DataFrame, longer_than: int, fewer_than: int) -> DataFrame:
        return search.first_below(self.text, queries, longer_than, fewer_than, self._counts(queries))

    def forward_spectrum(self, queries: DataFrame) -> DataFrame:
        """By the tree, else with the k-mer table where the index holds one."""
        if self.ranks is not None:
            return indexed.forward_spectrum(self.ranks, self.text, queries, self.searcher)
        return search.forward_spectrum(self.text, queries, table=self.tables.get("kmt"), k=self.meta["config"]["kmer_table_k"])

    def forward_spectrum_from_hint(self, queries: DataFrame) -> DataFrame:
        if self._by_passes():
            return passes.forward_spectrum_from_hint(self.text, queries)
        return indexed.forward_spectrum_from_hint(self.ranks, self.text, queries, self.searcher)

    def backward_spectrum(self, anchors: DataFrame) -> DataFrame:
        """qid, step_no, match_len, sa_start, occ."""
        if self._by_passes():
            return passes.backward_spectrum(self.text, anchors)
        return indexed.backward_spectrum(self.ranks, self.text, anchors, self.searcher)

    def backward_spectrum_with_seed(self, anchors: DataFrame) -> DataFrame:
        """As backward_spectrum: where a search begins changes no result."""
        return self.backward_spectrum(anchors.drop("seed"))

    def backward_spectrum_from_hint(self, anchors: DataFrame) -> DataFrame:
        if self._by_passes():
            return passes.backward_spectrum_from_hint(self.text, anchors)
        return indexed.backward_spectrum_from_hint(self.ranks, self.text, anchors, self.searcher)

    def minimizers(self, reads: DataFrame, k: int = bases.KEY) -> DataFrame:
        """rid, kmer, at, sa_start, occ: the smallest k-mer of each read and its interval."""
        least = durable(reads.select("rid", bases.minimizer("seq", k).alias("x")).select("rid", "x.kmer", "x.at"))
        found = self.intervals(least.select(F.col("kmer").alias("pattern")))
        return least.join(found.withColumnRenamed("pattern", "kmer"), "kmer", "left").select("rid", "kmer", "at", "sa_start", "occ")

    def windows(self, reads: DataFrame, k: int = bases.KEY) -> DataFrame:
        """rid, at, key, key_hex, pred, err, len, start, occ, present of every window without N of reads: what the learned model says of its rank,
        beside the longest match of the window in the text and its interval. present: the whole window occurs."""
        if k != bases.KEY:
            raise ValueError("the model learns windows of 32 bases")
        each = reads.select("rid", F.posexplode(bases.windows("seq", k)).alias("at", "key")).where(~F.contains("key", F.lit("N")))
        each = durable(each)
        keys = each.select("key").distinct()
        exact = self.mem_search(keys.select(F.col("key").alias("qid"), F.col("key").alias("seq")))
        said = self.lookup(keys).join(exact.withColumnRenamed("qid", "key"), "key")
        rows = each.join(said, "key").withColumn("present", F.col("match_len") == k)
        return rows.select("rid", "at", "key", bases.hex32(bases.key_long("key")).alias("key_hex"), "pred", "err", F.col("match_len").alias("len"), F.col("sa_start").alias("start"), "occ", "present")

    def collect_smems(self, reads: DataFrame, options: smem.Options = smem.Options(), ranks: bool = True) -> DataFrame:
        return smem.collect(self.text, reads, options, ranks, self.ranks, self.searcher if self.ranks is not None else None)

    def present(self, reads: DataFrame, gate: str = "first") -> DataFrame:
        """gate: first, any, bloom (any, with the filter before it) or bloom_first (false positives are possible)."""
        if gate == "first" or gate.startswith("bloom") and "bloom" not in self.tables:
            return gates.present_first(reads, self.keys)
        if gate == "any":
            return gates.present_any(reads, self.keys).select("rid", "present")
        params = gates.BloomParams(self.meta["bloom_bits"], self.meta["bloom_hashes"])
        if gate == "bloom_first":
            return gates.present_bloom_first(reads, self.tables["bloom"], params)
        if gate == "bloom":
            return gates.present_bloom(reads, self.keys, self.tables["bloom"], params)
        raise ValueError(f"no gate {gate}")

    @staticmethod
    def keepset(contigs: DataFrame, targets: DataFrame, k: int = 32, max_occ: int = 0, flank: int = 0) -> DataFrame:
        return keepset.keep_runs(text.build(contigs, k, strands=1, fill="N"), targets, k, max_occ, flank)


def _kept_windows(t: text.Text, keep: DataFrame) -> DataFrame:
    return keep_doubled(t.windows(32), keep, t.length).select("w").distinct()


def tiered_seeds(small: Index, full: Index, reads: DataFrame, options: smem.Options = smem.Options(), gate: str = "first") -> DataFrame:
    """Seeds of each read from the small index if its gate lets the read through, else from the full one; tier says which."""
    near, far = gates.tiered(reads, small.present(reads, gate))
    return small.collect_smems(near, options, False).withColumn("tier", F.lit("small")).unionByName(full.collect_smems(far, options, False).withColumn("tier", F.lit("full")))
