"""Search by ranks against brute force on a small repetitive text of several pages."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from seedlake.operators import indexed, learned, ranks, search, smem, suffix, text
from seedlake.operators.store import durable

from test_search import below, longest, occ, rc


def make():
    rnd = random.Random(11)
    draw = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    motif, long = draw(70), draw(330)
    fwd = draw(400) + motif + "A" * 70 + motif[3:] + long + draw(150) + "ACG" * 25 + long[:300] + "G" + draw(90) + motif * 2 + long + "T" * 40
    two = fwd + rc(fwd)
    reads = [motif + draw(30), two[1000:1140], long[200:] + "A", draw(60), "ACG" * 20 + "T", two[-50:], two[-50:] + "C", "A" * 100, "N" + motif, motif[:20] + "N" + motif, "", "G", two[300:380] + "N" + two[500:590], long[220:280] + motif]
    return fwd, two, reads


@pytest.fixture(scope="module")
def case(spark):
    fwd, two, reads = make()
    t = text.build(durable(text.contigs(spark.createDataFrame([(0, fwd)], "doc_id long, text string"), encode=False)), 400, tile=128)
    t = text.Text(durable(t.tiles), t.length, t.ahead)
    sa = durable(suffix.suffix_array(t))
    index = ranks.build(t, sa)
    pairs = durable(learned.training_set(sa, t))
    model = learned.train(pairs, t.total + 1, learned.Config(64))
    order = sorted(range(len(two) + 1), key=lambda i: two[i:])
    return t, two, reads, sa, index, model, order


def shares(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def pages(df, *columns):
    return [x for r in df.orderBy("node").collect() for x in zip(*(r[c] for c in columns))]


def test_tables(case):
    """Pages hold places, keys, skips and common prefixes in order of rank; (key, skip) grows; the tree and the inverse agree."""
    t, two, _, _, index, _, order = case
    rows = pages(index.ranks, "pos", "key", "skip", "low")
    assert [r[0] for r in rows] == order
    assert [r[3] for r in rows] == [-1] + [min(shares(two[a:], two[b:]), index.cap) for a, b in zip(order, order[1:])]
    assert all(a[1:3] < b[1:3] for a, b in zip(rows, rows[1:]))
    assert max(r[3] for r in rows) > 256 and index.top >= 1
    assert [x[0] for x in pages(index.places, "rank")] == [r for _, r in sorted((p, r) for r, p in enumerate(order))]


def test_least(spark, case):
    *_, index, _, order = case
    low = [r[0] for r in pages(index.ranks, "low")]
    rnd = random.Random(3)
    asked = [(i, *sorted((rnd.randrange(len(low)), rnd.randrange(len(low))))) for i in range(300)] + [(900, 0, len(low) - 1), (901, 255, 256), (902, 5, 5), (903, 256, 511)]
    found = ranks.least(spark.createDataFrame(asked, "id int, a long, b long"), ranks.nodes_of(index.ranks.select("node", "low"), index.n))
    assert {r.id: r.low for r in found.collect()} == {i: min(low[a : b + 1]) for i, a, b in asked}


@pytest.mark.parametrize("learn", [False, True])
def test_intervals(spark, case, monkeypatch, learn):
    """By the tree and by the model, from a table of one block and of many."""
    t, two, reads, _, index, model, _ = case
    if learn:
        monkeypatch.setattr(ranks, "LEAST", 1)
        index = ranks.Ranks(durable(index.ranks.withColumn("block", F.floor(F.col("node") / ranks.per_block(index.n)).cast("int"))), index.tree, index.places, index.n, index.cap)
        assert not index.whole
    pats = sorted({r[a : a + n] for r in reads for a, n in ((0, 1), (0, 3), (0, 31), (0, 32), (1, 33), (4, 64), (2, 97), (0, 300), (5, 200))} - {""})
    got = {r.pattern: (r.sa_start, r.occ) for r in indexed.intervals(index, spark.createDataFrame([(p,) for p in pats], "pattern string"), model if learn else None).collect()}
    assert got == {p: (below(two, p) if occ(two, p) else 0, occ(two, p)) for p in pats}


def wanted_steps(two, q):
    steps = {occ(two, q[:m]): m for m in range(1, longest(two, q.split("N")[0]) + 1)}
    return [(i, below(two, q[:m]), o, m) for i, (o, m) in enumerate(sorted(steps.items(), key=lambda x: x[1]))]


def test_mem_search_and_spectra(spark, case):
    """Also from hints: every rank of the longest match's interval gives the same steps; other ranks give what is shared there."""
    t, two, reads, sa, index, model, order = case
    q = spark.createDataFrame(list(enumerate(reads)), "qid int, seq string")
    best = {r.qid: tuple(r)[1:] for r in indexed.mem_search(index, t, q, model).collect()}
    got = {i: [] for i in range(len(reads))}
    for r in indexed.forward_spectrum(index, t, q).collect():
        got[r.qid].append(tuple(r)[1:])
    for i, r in enumerate(reads):
        n = longest(two, r.split("N")[0])
        assert best[i] == ((n, occ(two, r[:n]), below(two, r[:n])) if n else (0, 0, 0))
        assert sorted(got[i]) == wanted_steps(two, r)
    same = [(i * 100 + j, r, best[i][2] + j) for i, r in enumerate(reads) for j in {0, best[i][1] // 2, best[i][1] - 1} if best[i][0]]
    other = [(5000 + j, reads[1], j) for j in (1, 400, 900)] + [(6000, reads[1], None), (6001, reads[1], 0), (6002, reads[1], 10**7)]
    found = {}
    for r in indexed.forward_spectrum_from_hint(index, t, spark.createDataFrame(same + other, "qid int, seq string, hint long")).collect():
        found.setdefault(r.qid, []).append(tuple(r)[1:])
    for k, r, hint in same + other:
        common = r if not hint or hint > len(two) else r[: shares(r.split("N")[0], two[order[hint] :])]
        assert sorted(found.get(k, [])) == wanted_steps(two, common)


def anchors(reads):
    return [(i * 10 + j, r, pivot, size) for i, r in enumerate(reads) for j, (pivot, size) in enumerate(((0, 12), (9, 5), (20, 12), (60, 20))) if len(r) >= pivot + size]


def test_backward(spark, case):
    t, two, reads, _, index, model, order = case
    rows = anchors(reads)
    frame = spark.createDataFrame(rows, "qid int, seq string, pivot int, anchor int")
    got, hinted = {k[0]: [] for k in rows}, {k[0]: [] for k in rows}
    for r in indexed.backward_spectrum(index, t, frame).collect():
        got[r.qid].append(tuple(r)[1:])
    rank = {p: r for r, p in enumerate(order)}
    hints = []
    for k, r, pivot, size in rows:
        want, deep = [], occ(two, r[pivot : pivot + size]) and r[pivot : pivot + size]
        for j in range(1, pivot + 1):
            p = r[pivot - j : pivot + size]
            if not occ(two, p):
                break
            want.append((j - 1, size + j, below(two, p), occ(two, p)))
            deep = p
        assert sorted(got[k]) == want
        if deep:  # the anchor's place in the longest extension
            hints.append((k, r, pivot, size, rank[two.index(deep) + len(deep) - size]))
    for r in indexed.backward_spectrum_from_hint(index, t, spark.createDataFrame([*hints, (99999, reads[1], 9, 5, 0)], "qid int, seq string, pivot int, anchor int, hint long")).collect():
        hinted[r.qid].append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in hinted.items()} == {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize("least", [1, 2, 3, 8])
def test_backward_truncated(spark, case, least):
    t, two, reads, _, index, model, _ = case
    rows = [(*r, least) for r in anchors(reads)]
    found = {r.qid: tuple(r)[1:] for r in indexed.backward_truncated(index, t, spark.createDataFrame(rows, "qid int, seq string, pivot int, anchor int, least_occ int"), model).collect()}
    for k, r, pivot, size, _ in rows:
        longer = [j for j in range(1, pivot + 1) if occ(two, r[pivot - j : pivot + size]) >= least]
        p = r[pivot - max(longer, default=0) : pivot + size]
        assert found[k] == ((len(p), below(two, p), occ(two, p)) if occ(two, p) else (size, 0, 0))


def test_seeds(spark, case):
    t, _, reads, _, index, model, _ = case
    options = smem.Options(8, 12, 5, 6)
    frame = spark.createDataFrame([*enumerate(reads)], "rid int, seq string")
    top = indexed.statistics(index, t, frame, options.min_seed_len, model)
    rows = lambda df: sorted(map(tuple, df.select("rid", "p", "lcp", "n", "occ").collect()))
    assert rows(indexed.occurrences(index, top, options.min_seed_len)) == rows(search.occurrences(search.profile(t, search.queries_at(frame, 8), 8, 400)))


@pytest.mark.parametrize("every", [1, 4, 16])
def test_places(spark, case, every):
    """Places are found whether all are kept or every 4th or 16th stretch; the table shrinks as many times."""
    t, two, _, sa, index, model, order = case
    fewer = index if every == 1 else ranks.Ranks(index.ranks, index.tree, durable(ranks.sparse_places(sa, every)), index.n, index.cap, every)
    asked = [*range(0, len(two) + 1, 7), *range(len(two) - 70, len(two) + 3)]
    found = ranks.isa_at(fewer, t, spark.createDataFrame([(p,) for p in asked], "pos long")).collect()
    rank = {p: r for r, p in enumerate(order)}
    assert sorted((r.pos, r["rank"]) for r in found) == sorted((p, rank.get(p)) for p in asked)
    kept = sum(len(r["rank"]) for r in fewer.places.collect())
    assert abs(kept - len(order) / every) <= 32
