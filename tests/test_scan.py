"""Few reads are compared with the text where it lies: results are those of brute force, and no row for each place is made."""

import random

import numpy as np
import pytest

from seedlake.operators import gates, scan, search, smem, suffix, text


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture
def no_places(monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a row for each place of the text")

    for name in ("suffixes", "windows"):
        monkeypatch.setattr(text.Text, name, refuse)


@pytest.fixture(scope="module")
def given():
    r = random.Random(5)
    docs = ["".join(r.choice("ACGT") for _ in range(r.randint(1, 400))) for _ in range(12)]
    docs += [docs[0], docs[1][5:] + "A" * 40, "NN" + docs[2] + "N", "N" + docs[3], "ACGT" * 20]
    reads = [docs[0][3:90], docs[1][20:60] + docs[4][:50], "ACGTN" + docs[5][:60], turned(docs[2])[:45], "ACG", docs[3] + docs[4][:30], "A" * 50]
    return docs, [x[:200] for x in reads]


def built(spark, docs, **how):
    return text.build(text.contigs(spark.createDataFrame([*enumerate(docs)], "doc_id long, text string"), encode=False), 220, **how)


def test_strings_stand_in_order():
    r = random.Random(2)
    t = "".join(r.choice("AC") for _ in range(300)) * 2 + "A" * 70
    some = sorted({(t[(p := r.randrange(500)) :][: r.randint(1, 100)] + r.choice(["", "A", "GT"])).encode() for _ in range(120)})
    size = np.array([len(x) for x in some])
    probes, at = scan.Probes(b"".join(some), np.cumsum(size) - size, size), np.arange(len(t))
    slot, best, where = probes.find(scan.rolling(scan._CODE[np.frombuffer(t.encode(), np.uint8)], 32), at, np.minimum(len(t) - at, probes.most))
    for i in at:
        w = t[i : i + probes.most].encode()
        assert slot[i] == sum(x <= w for x in some)
        assert best[i] == max(next((k for k in range(len(w), 0, -1) if x[:k] == w[:k]), 0) for x in some)
        assert probes.bases[where[i] : where[i] + best[i]] == w[: best[i]]


def test_searches_make_no_row_for_a_place(spark, given, no_places):
    docs, reads = given
    flat = "".join(docs).replace("N", "A")
    whole = flat + turned(flat)
    t = built(spark, docs)
    places = [whole[i : i + 221] for i in range(len(whole))]
    patterns = sorted({x[:n] for x in reads for n in (1, 3, 7, 24, 60, 150)} | {"T" * 9, "TTTT", "ACNT"})
    rows = spark.createDataFrame([(x,) for x in patterns], "pattern string")
    assert sorted(map(tuple, search.bounds(t, rows).collect())) == [(x, 1 + sum(w < x for w in places), sum(w.startswith(x) for w in places)) for x in patterns]
    assert {tuple(x) for x in search.pattern_counts(t, rows).collect()} == {(x, sum(w.startswith(x) for w in places)) for x in patterns}
    q = spark.createDataFrame([*enumerate(reads)], "qid long, seq string")
    count = lambda x: sum(w.startswith(x) for w in places)
    want = {}
    for i, x in enumerate(reads):
        for m in range(1, len(x) + 1):
            if n := count(x[:m]):
                want[i, n] = m
    assert {(r.qid, r.occ): r.match_len for r in search.forward_spectrum(t, q, starts=False).collect()} == want
    table = suffix.kmer_table(t, 6)
    assert {(r.qid, r.occ): r.match_len for r in search.forward_spectrum(t, q, starts=False, table=table, k=6).collect()} == want
    seeds = {tuple(r) for r in smem.supermaximal_matches(t, q.withColumnRenamed("qid", "rid")).select("rid", "m", "n", "s").collect()}
    for rid, x in enumerate(reads):
        ends = [max((e for e in range(p + 19, len(x) + 1) if count(x[p:e])), default=0) for p in range(len(x))]
        assert {s for s in seeds if s[0] == rid} == {(rid, p, e - 1, count(x[p:e])) for p, e in enumerate(ends) if e and (not p or ends[p - 1] < e)}
    found = {(r.rid, r.pivot): r.occ for r in search.range32(t, q.withColumnRenamed("qid", "rid"), [0, 10]).collect()}
    assert found == {(i, p): count(x[p : p + 32]) if len(x) >= p + 32 else 0 for i, x in enumerate(reads) for p in (0, 10)}


def test_gates_ask_only_for_the_reads_windows(spark, given, no_places):
    docs, reads = given
    inside = [x for d in docs for x in (d.replace("N", "A"), turned(d.replace("N", "A")))]
    r = spark.createDataFrame([*enumerate(reads)], "rid long, seq string")
    hits = {i: [p for p in range(len(x) - 31) if any(x[p : p + 32] in y for y in inside)] for i, x in enumerate(reads)}
    got = gates.present_any(r, gates.held(built(spark, docs, contig_safe=True), r)).collect()
    assert {x.rid: x.first_hit for x in got} == {i: min(h, default=None) for i, h in hits.items()}
