"""Search, seeds and suffix ranks against brute force on a small repetitive text."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from seedlake.operators import search, smem, suffix, text
from seedlake.operators.store import durable

OPTIONS = smem.Options(8, 12, 5, 6)


def make(seed: int = 5):
    rnd = random.Random(seed)
    draw = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    motif = draw(40)
    contigs = [(0, draw(200) + motif + "A" * 40 + draw(50)), (1, motif[5:] + draw(60) + "ACG" * 12 + "NNN" + draw(30)), (2, ""), (3, motif + draw(40) + motif[:30])]
    flat = "".join(s for _, s in contigs).replace("N", "A")
    two = flat + rc(flat)
    reads = [(0, motif[3:] + draw(20)), (1, flat[150:260]), (2, "N" * 5 + flat[20:60] + "N" + motif), (3, draw(50)), (4, "ACG" * 7 + "AAA"), (5, two[-60:] + "C"), (6, "A" * 60), (7, flat[100:130] + "T" + flat[131:190])]
    return contigs, two, reads


def rc(s: str) -> str:
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def case(spark):
    contigs, two, reads = make()
    t = text.build(durable(text.contigs(spark.createDataFrame(contigs, "doc_id long, text string"), encode=False)), 200, tile=64)
    t = text.Text(durable(t.tiles), t.length, t.ahead)
    return t, two, reads, spark.createDataFrame(reads, "rid int, seq string")


def occ(two: str, p: str) -> int:
    return 0 if not p or "N" in p else sum(two.startswith(p, i) for i in range(len(two)))


def longest(two: str, q: str) -> int:
    n = 0
    while n < len(q) and occ(two, q[: n + 1]):
        n += 1
    return n


def below(two: str, p: str) -> int:
    return sum(two[i:] < p for i in range(len(two) + 1))


@pytest.mark.parametrize("most", [None, 0])
def test_intervals(spark, case, monkeypatch, most):
    """Few patterns go to the text, many (most = 0: any) are dealt with it."""
    t, two, reads, _ = case
    if most is not None:
        monkeypatch.setattr(text, "SMALL", most)
    pats = sorted({r[a : a + n] for _, r in reads for a, n in ((0, 3), (0, 14), (4, 9), (2, 30), (7, 1), (5, 11), (3, 12))})
    for x in search.intervals(t, spark.createDataFrame([(p,) for p in pats], "pattern string")).collect():
        n = occ(two, x.pattern)
        assert (x.occ, x.sa_start) == (n, below(two, x.pattern) if n else 0)


def test_mem_search_and_spectra(spark, case):
    t, two, reads, df = case
    q = df.withColumnRenamed("rid", "qid")
    spectrum = defaultdict(list)
    for x in search.forward_spectrum(t, q).collect():
        spectrum[x.qid].append((x.occ, x.match_len, x.sa_start))
    best = {x.qid: x for x in search.mem_search(t, q, starts=True).collect()}
    for k, r in reads:
        n = longest(two, r)
        assert best[k].match_len == n and best[k].occ == occ(two, r[:n])
        steps = {occ(two, r[:m]): m for m in range(1, n + 1)}
        assert sorted(spectrum[k]) == sorted((o, m, below(two, r[:m])) for o, m in steps.items())
    capped = {x.qid: x.occ for x in search.mem_search(t, q, most_occ=2).collect()}
    assert all(capped[k] == min(best[k].occ, 3) for k, _ in reads)


def test_backward(spark, case):
    t, two, reads, _ = case
    rows = [(k, r, 20, 5) for k, r in reads if len(r) > 25]
    anchors = spark.createDataFrame(rows, "qid int, seq string, pivot int, anchor int")
    got = defaultdict(list)
    for x in search.backward_spectrum(t, anchors).collect():
        got[x.qid].append((x.step_no, x.match_len, x.occ))
    deep = {x.qid: x for x in search.mem_search_backward(t, anchors).collect()}
    for k, r, pivot, anchor in rows:
        want = []
        for j in range(1, pivot + 1):
            n = occ(two, r[pivot - j : pivot + anchor])
            if not n:
                break
            want.append((j - 1, anchor + j, n))
        assert sorted(got[k]) == want
        own = occ(two, r[pivot : pivot + anchor])
        assert (deep[k].match_len, deep[k].occ) == (want[-1][1:] if want else (anchor, own) if own else (0, 0))


def end(two, r, p, c):
    n = 0
    while p + n < len(r) and r[p + n] != "N" and occ(two, r[p : p + n + 1]) >= c:
        n += 1
    return p + n


def maximal(two, r, c):
    out = []
    for p in range(len(r)):
        e = end(two, r, p, c)
        if r[p] != "N" and e - p >= OPTIONS.min_seed_len and (p == 0 or r[p - 1] == "N" or e > end(two, r, p - 1, c)):
            out.append((p, e - 1, occ(two, r[p:e])))
    return out


def all_seeds(two, r):
    first = maximal(two, r, 1)
    yield from first
    for m, n, s in first:
        if n - m + 1 >= OPTIONS.split_len and s <= OPTIONS.split_width:
            mid = (m + n + 1) >> 1
            yield from (x for x in maximal(two, r, s + 1) if x[0] <= mid <= x[1])
    x = 0
    while x < len(r):
        clear = (r + "N").index("N", x) - x
        n = max(OPTIONS.min_seed_len + 1, 2)
        while n <= clear and occ(two, r[x : x + n]) >= OPTIONS.max_mem_intv:
            n += 1
        if clear == 0:
            x += 1
        elif n > clear:
            x += clear + (x + clear < len(r))
        else:
            if k := occ(two, r[x : x + n]):
                yield x, x + n - 1, k
            x += n


def test_collect(case):
    t, two, reads, df = case
    want = sorted((k, *x) for k, r in reads for x in all_seeds(two, r))
    assert sorted(map(tuple, smem.collect(t, df, OPTIONS).collect())) == want


def test_suffix_array(spark, case):
    t, two, _, _ = case
    sa = durable(suffix.suffix_array(t))
    assert [r.pos for r in sa.orderBy("rank").collect()] == sorted(range(len(two) + 1), key=lambda i: two[i:])
    assert suffix.is_permutation(sa) and suffix.certify(sa, t) == 0
    hint = spark.createDataFrame([(0, two[30:60], 7)], "qid int, seq string, hint long")
    place = sa.where("rank = 7").first().pos
    shared = next((n for n in range(30) if two[place : place + n + 1] != two[30 : 31 + n]), 30)
    assert search.from_hint(t, sa, hint).first().match_len == shared
    rank = {p: r for r, p in enumerate(sorted(range(len(two) + 1), key=lambda i: two[i:]))}
    rows = [(j, two[p : p + 30] + "N", rank[p]) for j, p in enumerate((0, 250, 333, len(two) - 9))] + [(8, "ACGT", 0), (9, "ACGT", 10**6), (10, "NACG", 5)]
    best = {x.qid: x for x in search.from_hint(t, sa, spark.createDataFrame(rows, "qid int, seq string, hint long"), interval=True).collect()}
    for j, q, h in rows:
        n = longest(two, q) if j < 8 else 0
        assert tuple(best[j]) == ((j, n, below(two, q[:n]), occ(two, q[:n])) if n else (j, 0, 0, 0))
    rows = [(j, "C" * j + two[p - 20 : p + 12], 20 + j, 12, rank[p]) for j, p in enumerate((20, 260, 500, len(two) - 12))] + [(8, two[:12], 0, 12, rank[0]), (9, two[:40], 9, 5, 0)]
    deep = {x.qid: x for x in search.backward_from_hint(t, sa, spark.createDataFrame(rows, "qid int, seq string, pivot int, anchor int, hint long"), interval=True).collect()}
    place = {r: p for p, r in rank.items()}
    for j, q, pivot, anchor, h in rows:
        more = 0
        while h and more < min(pivot, place[h]) and q[pivot - more - 1] == two[place[h] - more - 1]:
            more += 1
        span = q[pivot - more : pivot + anchor]
        assert tuple(deep[j]) == ((j, anchor + more, below(two, span), occ(two, span)) if h else (j, 0, 0, 0))
    q = spark.createDataFrame([(j, r[1]) for j, r in enumerate(case[2])], "qid int, seq string")
    steps = lambda **more: sorted(map(tuple, search.forward_spectrum(t, q, starts=False, **more).collect()))
    assert steps(table=suffix.kmer_table(t, 3), k=3) == steps()
    table = {(r.m, r.w): (r.lo, r.hi) for r in suffix.kmer_table(t, 2).collect()}
    for i, w in enumerate(a + b for a in "ACGT" for b in "ACGT"):
        assert table[2, i] == (below(two, w), below(two, w) + occ(two, w))
