"""Intervals, keep-sets, gates, the learned index, readers and writers, the index and a stream."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from seedlake.functions import bases
from seedlake.functions import sql as sql_functions
from seedlake.operators import concordance, gates, intervals, keepset, learned, smem, suffix, text
from seedlake.operators.store import durable
from seedlake.plans import cli
from seedlake.plans.index import BuildConfig, FormatError, Index
from seedlake.sources import readers, writers
from seedlake.streaming import seeding


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def merged(rows, touching):
    out = []
    for a, b in sorted(x for x in rows if x[0] < x[1]):
        if out and (a <= out[-1][1] if touching else a < out[-1][1]):
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("block", [16, 1 << 20])
@pytest.mark.parametrize("touching", [False, True])
def test_merge(spark, block, touching):
    rnd = random.Random(3)
    rows = [(a := rnd.randint(0, 2000), a + rnd.randint(0, 60)) for _ in range(150)]
    got = intervals.merge(spark.createDataFrame(rows, "start long, end long"), touching, block=block)
    assert sorted(map(tuple, got.collect())) == merged(rows, touching)


def test_covered_and_fold(spark):
    rows = spark.createDataFrame([(3, 6), (5, 9), (9, 9)], "start long, end long")
    points = spark.range(20).withColumnRenamed("id", "pos")
    assert [r.pos for r in intervals.covered(points, rows, block=4).orderBy("pos").collect()] == [3, 4, 5, 6, 7, 8]
    assert intervals.covered(points, rows, keep=False).count() == 14
    kept = intervals.keep_doubled(spark.range(21).withColumnRenamed("id", "pos"), spark.createDataFrame([(0, 2)], "start long, end long"), 10)
    assert sorted(r.pos for r in kept.collect()) == [0, 1, 18, 19, 20]


def test_scalars(spark):
    row = spark.createDataFrame([("ACGTTNACGA",)], "s string").select(
        bases.tokenize("s").alias("key"), bases.key_number(F.lit("T" * 32)).cast("string").alias("n"), bases.key_text(bases.key_number(F.lit("ACGTTGCA" * 4))).alias("t"),
        bases.next_n("s", F.lit(2)).alias("n2"), bases.minimizer("s", 4).alias("m"), bases.reverse_complement_key(F.lit("A" * 32), 0).alias("z"),
        F.hex(bases.pack_position(F.lit(0x1234567890).cast("long"))).alias("p"), bases.unpack_position(bases.pack_position(F.lit(0x1234567890).cast("long"))).alias("u"),
        bases.base_code(F.lit("g")).alias("g"), bases.base_code(F.lit("N")).alias("none"), bases.clamp_to_int(F.lit(float("nan")), 5).alias("nan"), bases.clamp_to_int(F.lit(7.9), 5).alias("top"),
    ).first()
    assert row.n == str(2**64 - 1) and row.t == "ACGTTGCA" * 4 and (row.n2, tuple(row.m)) == (3, ("ACGA", 6))
    assert row.z == "T" * 32 and row.p == "7856341290" and row.u == 0x1234567890 and (row.g, row.none, row.nan, row.top) == (2, None, 0, 5)
    start, size = bases.decode_fallback(bases.encode_fallback(F.lit(77), F.lit(9)))
    assert tuple(spark.range(1).select(start, size).first()) == (77, 9)
    sql_functions.register(spark)
    assert spark.sql("SELECT seq_revcomp('AACN'), seq_next_n('AACN', 1), seq_encode('abé')").first()[:3] == ("NGTT", 2, "CGN")


@pytest.fixture(scope="module")
def genome(spark):
    rnd = random.Random(6)
    draw = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    rep = draw(90)
    rows = [(0, draw(500) + rep), (1, "A" * 60 + rep + "NNNN" + draw(40)), (2, draw(200) + rc(rep)[:60])]
    return "".join(s for _, s in rows), durable(text.contigs(spark.createDataFrame(rows, "doc_id long, text string"), encode=False))


@pytest.mark.parametrize("k, most, flank", [(12, 0, 0), (12, 2, 3)])
def test_keepset(spark, genome, k, most, flank):
    flat, contigs = genome
    targets = [(500, 520), (550, 580)]
    own = [any(a <= i < b for a, b in targets) for i in range(len(flat))]
    kmers = [(i, min(w, rc(w))) for i in range(len(flat) - k + 1) if "N" not in (w := flat[i : i + k])]
    wanted = {w for i, w in kmers if own[i] and (not most or sum(x == w for _, x in kmers) <= most)}
    spans = [*targets, *((i, i + 1) for i, w in kmers if w in wanted)]
    want = merged([(max(0, a - flank), min(len(flat), b + flank)) for a, b in merged(spans, True)], True)
    forward = text.build(contigs, 32, strands=1, fill="N")
    df = spark.createDataFrame(targets, "start long, end long")
    assert sorted(map(tuple, keepset.keep_runs(forward, df, k, most, flank).collect())) == want
    with pytest.raises(ValueError):
        keepset.keep_runs(forward, spark.createDataFrame([(5, 10**6)], "start long, end long"), k)


def test_learned(spark, genome):
    _, contigs = genome
    t = text.build(contigs, 64)
    sa = durable(suffix.suffix_array(t))
    pairs = durable(learned.training_set(sa, t))
    for config in (learned.Config(16), learned.Config(16, threshold=30), learned.Config()):
        model = learned.train(pairs, t.total + 1, config)
        assert sorted(r.leaf for r in model.l2.select("leaf").collect()) == list(range(model.leaves))
        found = learned.errors(model, pairs)
        assert found.where("err_at > err").count() == 0
        errs = sorted(r.err_at for r in found.collect())
        d = learned.error_distribution(model, pairs).first()
        assert (d.p50, d.p90, d.p99, d.max) == (*[errs[int((len(errs) - 1) * p + 0.5)] for p in (0.5, 0.9, 0.99)], errs[-1])
    weighted = learned.histogram_weights(pairs, spark.createDataFrame([(1, 3)], "key long, count long"))
    assert learned.train(weighted, t.total + 1, learned.Config(16)).l2.count() == 16
    few = learned.training_set(sa, t, mask=spark.createDataFrame([(0, 100)], "start long, end long"), homopolymer=20)
    assert few.where("pos < 100").count() == 0 and few.where("key like '%AAAAAAAAAAAAAAAAAAAA%'").count() == 0
    with pytest.raises(ValueError):
        learned.Config(leaves=17)


def test_gates(spark, genome):
    flat, contigs = genome
    t = text.build(contigs, 64)
    keys = durable(t.windows(32).select("w").distinct())
    params = gates.BloomParams.for_keys(keys.count(), 0.01)
    blocks = durable(gates.bloom_blocks(keys, params))
    reads = spark.createDataFrame([(0, flat[100:150]), (1, "ACGTTGCATC" * 5), (2, "N" + flat[200:250]), (3, "ACGTTGCATCACGGTTAACC" + flat[300:360]), (4, "ACG")], "rid int, seq string")
    flags = lambda df: [r.present for r in df.orderBy("rid").collect()]
    assert flags(gates.present_first(reads, keys)) == [True, False, True, False, False]
    assert flags(gates.present_any(reads, keys)) == flags(gates.present_bloom(reads, keys, blocks, params)) == [True, False, True, True, False]
    assert all(b or not a for a, b in zip(flags(gates.present_first(reads, keys)), flags(gates.present_bloom_first(reads, blocks, params))))
    assert [tuple(r) for r in gates.misroute(reads, keys).collect()] == [(">10", 1)]
    assert gates.keyset_digest(keys).first().digest == gates.keyset_digest(keys.repartition(3)).first().digest
    assert gates.BloomParams.for_keys(0, 0.5) == gates.BloomParams(64, 1)


def test_index_and_stream(spark, genome, tmp_path):
    flat, contigs = genome
    index = Index.build(contigs, BuildConfig(ahead=128, kmer_table_k=2, bloom_rate=0.01))
    index.save(str(tmp_path / "ix"))
    again = Index.open(spark, str(tmp_path / "ix"))
    reads = spark.createDataFrame([(0, flat[100:160]), (1, flat[500:590])], "rid int, seq string")
    want = sorted(map(tuple, index.collect_smems(reads).collect()))
    assert want and sorted(map(tuple, again.collect_smems(reads).collect())) == want
    (tmp_path / "ix" / "meta2").mkdir()
    spark.createDataFrame([('{"format": 9, "tables": []}',)], "value string").coalesce(1).write.mode("overwrite").text(str(tmp_path / "bad" / "meta"))
    with pytest.raises(FormatError):
        Index.open(spark, str(tmp_path / "bad"))
    reads.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    seeding.seed_stream(stream, index.text, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("rid", "m", "n", "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, smem.collect(index.text, reads).collect()))


def test_masks_and_priors(spark, genome):
    flat, contigs = genome
    spans = lambda *rows: spark.createDataFrame(list(rows), "start long, end long")
    plain = dict(kmer_table_k=0, leaves=16, tree=False)
    learned_from = lambda config, **more: sum(r.n for r in Index.build(contigs, config, **more).inspect()["kinds"].collect())
    assert learned_from(BuildConfig(**plain, homopolymer=20), mask=spans((0, 400)), prior=spans((500, 600))) == 16
    same = Index.build(contigs, BuildConfig(**plain), histogram=spark.createDataFrame([(7, 2)], "key long, count long"))
    assert same.meta["prior"] == "histogram" and same.meta["config"]["mask_n"]
    index = Index.build(contigs, BuildConfig(ahead=64, bloom_rate=0.001, routing_pad=50, **plain), keep=spans((200, 260)))
    # the read lies 40 bases in front of what is kept: the filter has it only with the pad
    read = spark.createDataFrame([(0, flat[160:200])], "rid int, seq string")
    assert index.present(read, "bloom_first").first().present
    tight = Index.build(contigs, BuildConfig(ahead=64, bloom_rate=0.001, **plain), keep=spans((200, 260)))
    assert not tight.present(read, "bloom_first").first().present and tight.meta["ranks"] == 2 * 60 + 1
    for wrong in (dict(routing_pad=5), dict(prior_weight=0.0), dict(prior_base=-1.0)):
        with pytest.raises(ValueError):
            BuildConfig(**wrong)
    with pytest.raises(ValueError):
        Index.build(contigs, BuildConfig(**plain), prior=spans((0, 9)), histogram=spans((0, 9)))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text(">a\n" + "".join(random.Random(2).choices("ACGT", k=300)) + "\n")
    (tmp_path / "a.bed").write_text("a\t10\t90\n")
    (tmp_path / "h.tsv").write_text("5\t3\n")
    fa, bed, out = (str(tmp_path / x) for x in ("a.fa", "a.bed", "ix"))
    build = ["build", "--fasta", fa, "--out", out]
    for wrong in (["--bloom-rate", "0.1"], ["--routing-pad", "3"], ["--prior-bed", bed, "--mask-bed", bed], ["--prior-bed", bed, "--prior-fastq-histogram", str(tmp_path / "h.tsv")]):
        with pytest.raises(SystemExit):
            cli.main([*build, *wrong], spark)
    assert cli.main([*build, "--kmer-table-k", "2", "--leaves", "16", "--mask-homopolymers", "12", "--mask-bed", bed, "--prior-fastq-histogram", str(tmp_path / "h.tsv")], spark) == 0
    assert cli.main(["info", out], spark) == 0 and "max_error" in capsys.readouterr().out
    assert cli.main(["sa-verify", "--fasta", fa], spark) == 0


def test_files(spark, tmp_path):
    put = lambda name, s: (tmp_path / name).write_text(s) and str(tmp_path / name)
    contigs = readers.fasta(spark, put("a.fa", ">a desc\nACGT\nACGN\n>b\nGGgg\n"))
    assert [tuple(r) for r in contigs.orderBy("contig_id").collect()] == [(0, "a", "ACGTACGN", 8, 0), (1, "b", "GGGG", 4, 8)]
    assert tuple(readers.fasta_stats(contigs).first()) == (2, 12, 1)
    with pytest.raises(ValueError):
        readers.fasta(spark, put("b.fa", ">a\nA\n>a\nC\n"))
    assert [tuple(r) for r in readers.fastq(spark, put("a.fq", "@r1 x\nACGT\n+\nIIII\n")).collect()] == [(0, "r1", "ACGT", "IIII")]
    with pytest.raises(Exception, match="FASTQ"):
        readers.fastq(spark, put("b.fq", "@r1\nACGT\n+\nIII\n")).collect()
    bed = readers.bed(spark, put("a.bed", "#c\ntrack x\nc 5 10\nc 10 12\nc 7 9\nc\t100\t200\tn\t0\t+\t100\t200\t0\t2\t10,20,\t0,80,\n"))
    assert sorted(map(tuple, bed.collect())) == [(5, 10), (10, 12), (100, 110), (180, 200)]
    assert [tuple(r) for r in readers.target_bed(spark, put("t.bed", "b\t1\t3\n"), contigs).collect()] == [(9, 11)]
    with pytest.raises(ValueError):
        readers.histogram(spark, put("h.tsv", "1\t2\n1\t3\n"))
    rows, counters = readers.kmc(spark, put("k.txt", "A" * 32 + " 4\n" + "C" * 31 + " 4\n" + "N" * 32 + " 1\n" + "G" * 32 + " x\n"))
    assert rows.count() == 1 and tuple(counters.first()) == (1, 1, 1, 1)
    for n in (1, 3, 4, 5, 8, 17, 33):
        s = "".join(random.Random(n).choice("ACGT") for _ in range(n))
        b = spark.createDataFrame([(s,)], "s string").select(writers.pack_pac(F.col("s")).alias("b")).first().b
        (tmp_path / f"{n}.pac").write_bytes(bytes(b))
        assert len(b) == n // 4 + 2 and readers.pac(spark, str(tmp_path / f"{n}.pac")).first().seq == s
    lines = writers.bed12_lines(spark.createDataFrame([(1, 3), (5, 6), (9, 12)], "start long, end long"), 2).orderBy("start").collect()
    assert [r.value for r in lines] == ["ref\t1\t6\tkeep\t0\t+\t1\t6\t0\t2\t2,1\t0,4", "ref\t9\t12\tkeep\t0\t+\t9\t12\t0\t1\t3\t0"]


def test_concordance(spark):
    at = lambda q, f, p, m, c: (q, f, "c" if f != 4 else "*", p, m, c)
    full = [at("r1", 0, 1, 60, "76M"), at("r2", 0, 2, 60, "76M"), at("r3", 0, 3, 60, "76M"), at("r4", 0, 4, 60, "76M"), at("r5", 4, 0, 0, "*"), at("r5", 2048, 9, 60, "76M"), at("r6", 0, 6, 60, "76M"), at("r7", 0, 7, 60, "76M")]
    fast = [at("r1", 0, 1, 60, "76M"), at("r2", 0, 2, 40, "76M"), at("r3", 0, 3, 60, "40M2I34M"), at("r4", 0, 5, 60, "76M"), at("r5", 4, 0, 0, "*"), at("r6", 4, 0, 0, "*"), at("r7", 0, 7, 60, "76M")]
    make = lambda rows: concordance.primaries(spark.createDataFrame(rows, concordance.ALIGNMENT))
    present = spark.createDataFrame([(f"r{i}", i < 7) for i in range(1, 8)], "qname string, present boolean")
    compared = concordance.compare(make(fast), make(full), present)
    row = concordance.report(compared).where("partition = 'present'").first()
    assert (row.n, row.placement_same, row.pos_same, row.both_unmapped, row.status_differs, row.mapq_same, row.extra_differs) == (6, 3, 4, 1, 1, 1, 1)
    assert [tuple(r) for r in concordance.mapq_deltas(compared.where("present")).collect()] == [(-20, 1)]
    with pytest.raises(ValueError):
        make([*full, full[0]])
