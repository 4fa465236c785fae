"""A saved index of several blocks: what it answers is what the text gives, and what it reads is what is asked for."""

from __future__ import annotations

import random
import re

import pytest

from seedlake.functions import bases
from seedlake.operators import gates, learned, ranks, search, smem, suffix, text
from seedlake.operators.store import durable
from seedlake.plans.index import BuildConfig, Index, IndexMismatch
from seedlake.streaming import seeding


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rnd = random.Random(21)
    draw = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    motif = draw(90)
    contigs = [(0, draw(2600) + motif + "A" * 50), (1, motif[10:] + "NNN" + draw(2400) + motif)]
    flat = "".join(s for _, s in contigs).replace("N", "A")
    kept, tiles = ranks.LEAST, text.LEAST
    ranks.LEAST, text.LEAST = 2, 1
    frame = durable(text.contigs(spark.createDataFrame(contigs, "doc_id long, text string"), encode=False))
    path = str(tmp_path_factory.mktemp("ix") / "a")
    Index.build(frame, BuildConfig(ahead=200, kmer_table_k=2, places_every=4)).save(path)
    reads = [(0, motif + draw(20)), (1, flat[2000:2120]), (2, draw(70)), (3, flat[2640:2700] + "N" + flat[300:380]), (4, ""), (5, "A" * 45)]
    yield Index.open(spark, path), flat, reads, spark.createDataFrame(reads, "rid int, seq string"), path
    ranks.LEAST, text.LEAST = kept, tiles


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()), key=str)


def test_same_answers(spark, case):
    index, flat, _, reads, _ = case
    q = reads.withColumnRenamed("rid", "qid")
    t = text.Text(index.text.tiles, index.text.length, index.text.ahead)
    assert rows(index.collect_smems(reads, smem.Options(9, 14, 5, 6)), "rid", "m", "n", "k", "l", "s") == rows(smem.collect(t, reads, smem.Options(9, 14, 5, 6), True), "rid", "m", "n", "k", "l", "s")
    columns = ("qid", "match_len", "occ", "sa_start")
    best = index.mem_search(q)
    assert rows(best, *columns) == rows(search.mem_search(t, q, True), *columns)
    by_index, by_text = index._counts(q), durable(search.match_counts(t, q))
    for f, given in ((search.truncated, (2, 12)), (search.truncate_below_maximal, (2,)), (search.first_below, (4, 3))):
        assert rows(f(t, q, *given, counts=by_index)) == rows(f(t, q, *given, counts=by_text))
    pats = spark.createDataFrame([("ACG",), (flat[70:140],), ("T" * 60,), ("ANA",)], "pattern string")
    assert rows(index.intervals(pats), "pattern", "sa_start", "occ") == rows(search.intervals(t, pats), "pattern", "sa_start", "occ")
    assert rows(index.kmer_exists(pats)) == rows(search.kmer_exists(t, pats))


def test_accessors(spark, case):
    """isa_at and key_at against the suffix array, minimizers and the window table against brute force."""
    index, flat, reads, frame, _ = case
    two = flat + flat[::-1].translate(str.maketrans("ACGT", "TGCA"))
    sa = {r["rank"]: r.pos for r in index.tables["sa"].collect()}
    asked = spark.createDataFrame([(p,) for p in (*range(0, len(two), 97), len(two) - 1, len(two), len(two) + 5)], "pos long")
    back = {p: r for r, p in sa.items()}
    assert rows(index.isa_at(asked)) == sorted(((r.pos, back.get(r.pos)) for r in asked.collect()), key=str)
    some = [0, 1, 5, 300, len(two), len(two) + 1]
    want = [(r, sa.get(r), (two[sa[r] : sa[r] + 32] + "T" * 32)[:32] if r in sa else None) for r in some]
    assert rows(index.key_at(spark.createDataFrame([(r,) for r in some], "rank long")), "rank", "pos", "key") == sorted(want, key=str)
    occ = lambda p: sum(two.startswith(p, i) for i in range(len(two)))
    found = {r.rid: r for r in index.minimizers(frame).collect()}
    for k, seq in reads:
        clean = [(seq[i : i + 32], i) for i in range(len(seq) - 31) if "N" not in seq[i : i + 32]]
        least = min(clean, default=(None, None))
        assert (found[k].kmer, found[k]["at"], found[k].occ) == (*least, occ(least[0]) if least[0] else None)
    table = index.windows(frame).collect()
    assert len(table) == sum("N" not in s[i : i + 32] for _, s in reads for i in range(len(s) - 31))
    for r in table[::9]:
        n = next((m for m in range(32, 0, -1) if occ(r.key[:m])), 0)
        first = sum(two[i:] < r.key[:n] for i in range(len(two) + 1))
        assert (r.len, r.start, r.occ, r.present) == (n, first, occ(r.key[:n]), n == 32)
        assert int(r.key_hex, 16) == int("".join(str("ACGT".index(b)) for b in r.key), 4)
        assert not r.present or abs(r.pred - r.start) <= r.err


def test_reads_what_it_needs(spark, case):
    """A lookup reads the blocks of its ranks, a comparison the part of its tile."""
    index, *_ = case
    assert not index.ranks.whole and index.tables["ranks"].select("block").distinct().count() > 4
    one = spark.createDataFrame([(1, 700)], "id int, rank long")
    plan = ranks.at_ranks(index.ranks, one, "pos")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block#\d+ = 1\)", plan)
    plan = index.text.at(spark.createDataFrame([(4000,)], "pos long"), 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "IN (2,3)" in plan


def test_validate(spark, case, tmp_path):
    index, _, _, _, path = case
    index.validate()
    other = Index(spark, index.meta | {"digest": "1"}, index.tables)
    with pytest.raises(IndexMismatch):
        other.validate()
    plain = Index(spark, index.meta, {k: v for k, v in index.tables.items() if k != "ranks"})
    with pytest.raises(ValueError, match="tree of ranks"):
        plain.backward_truncated(spark.createDataFrame([(0, "ACGT", 1, 2, 1)], "qid int, seq string, pivot int, anchor int, least_occ int"))


def test_stream(spark, case, tmp_path):
    """Batches against the kept index give what one search gives."""
    index, _, reads, frame, _ = case
    frame.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seeding.seed_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "ck"), smem.Options(9)).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() > 1
    assert rows(got, "rid", "m", "n", "s") == rows(index.collect_smems(frame, smem.Options(9), False), "rid", "m", "n", "s")


def test_seeds_in_order(spark):
    seeds = spark.createDataFrame([(0, 5, 9, 1), (0, 2, 8, 1), (0, 2, 4, 2), (0, 2, 4, 2), (1, 0, 3, 1)], "rid int, m int, n int, s long")
    assert rows(smem.in_order(seeds), "rid", "at", "m", "n", "needed") == [(0, 0, 2, 4, 4), (0, 1, 2, 4, 4), (0, 2, 2, 8, 4), (0, 3, 5, 9, 4), (1, 0, 0, 3, 1)]
    assert [r.rid for r in smem.in_order(seeds, 3).collect()] == [1] and rows(smem.overfull(seeds, 3)) == [(0, 4)]


def test_leaf_ends(spark):
    rnd = random.Random(6)
    keys = sorted("".join(rnd.choice("ACGT") for _ in range(32)) for _ in range(40))
    pairs = [(rank, key) for rank, key in enumerate(sorted(rnd.choices(keys, k=90) + keys[3:4] * 30))]
    found = {r.leaf: tuple(r)[1:] for r in learned.leaf_ends(spark.createDataFrame(pairs, "rank long, key string").repartition(5), 16).collect()}
    own = {}
    for rank, key in pairs:
        own.setdefault("ACGT".index(key[0]) * 4 + "ACGT".index(key[1]), []).append((rank, key))
    order = sorted(own)
    for i, leaf in enumerate(order):
        ranks_ = [r for r, _ in own[leaf]]
        longest = max(sum(k == key for _, k in own[leaf]) for _, key in own[leaf])
        after, before = (own[order[i + 1]][0][0] if i + 1 < len(order) else None), (own[order[i - 1]][-1][0] if i else None)
        assert found[leaf] == (len(ranks_), min(ranks_), max(ranks_), longest, after, before)
    assert len(found) == len(order)


def test_accept_tallies(spark):
    fast = [(0, 0, 9, 1), (1, 0, 9, 3), (1, 4, 12, 2), (2, 0, 5, 7), (2, 3, 9, 1)]
    full = [(0, 0, 9, 1), (1, 0, 9, 5), (1, 4, 12, 2), (2, 0, 5, 6), (2, 6, 9, 900), (3, 1, 2, 1)]
    seeds = lambda x: spark.createDataFrame(x, "rid int, m int, n int, s long")
    apart = gates.divergences(seeds(fast), seeds(full))
    assert rows(apart) == sorted([(1, 0, 9, "reduced", 5), (2, 0, 5, "inflated", 5), (2, 3, 9, "over_emit", None), (2, 6, 9, "missing", 5), (3, 1, 2, "missing", 1)], key=str)
    accepted = [(0, True, True, True), (1, True, True, False), (2, True, False, False), (3, False, False, False)]
    cube = gates.accept_tallies(spark.createDataFrame(accepted, "rid int, p1 boolean, p2 boolean, p3 boolean"), apart, seeds(full))
    got = {tuple(r)[:5]: r.reads for r in cube.collect()}
    flags = [(*a[1:], a[0] == 0, a[0] == 2) for a in accepted]
    want = {}
    for f in flags:
        for mask in range(32):
            key = tuple(x if mask >> i & 1 else None for i, x in enumerate(f))
            want[key] = want.get(key, 0) + 1
    assert got == want
    assert {tuple(r)[:2]: r.spans for r in gates.divergence_tallies(apart).collect()}[(None, None)] == 5
