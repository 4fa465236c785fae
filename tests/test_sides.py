"""Prefixes of few queries, by one pass: how often they occur, where they stand and where they are."""

from __future__ import annotations

import random

import pytest

from seedlake.operators import scan, search, text

from test_search import below, occ, rc


def wanted(two: str, q: str) -> list[tuple]:
    out = []
    for j in range(1, len(q) + 1):
        if not (n := occ(two, q[:j])):
            break
        if out and out[-1][2] == n:
            out[-1] = (out[-1][0], j, *out[-1][2:])
        else:
            out.append((j, j, n, below(two, q[:j]), two.index(q[:j])))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_prefix_runs(spark, seed):
    rnd = random.Random(seed)
    of = "ACGT"[: 2 + seed % 3]
    draw = lambda n: "".join(rnd.choice(of) for _ in range(n))
    once = draw(300)
    fwd = once + draw(1500) + once[20:250] + "A" * 70 + once[100:] + draw(5 + seed)
    two = fwd + rc(fwd)
    t = text.build(text.contigs(spark.createDataFrame([(0, fwd[:900]), (1, fwd[900:])], "doc_id long, text string"), encode=False), 511)
    strings = {once[:200], once[20:260], once[20:150] + draw(30), two[-40:], two[-9:], two[-5:] + "A" * 30, "A" * 100, "C", "AC", once[:9], once[:10], once[:11], draw(60), once[:50] + "T" * 40}
    strings |= {once[i : i + 90] for i in range(0, 200, 7)} | {two[i : i + 32] for i in range(0, 900, 111)}
    got = scan.prefix_runs(t, sorted(x.encode() for x in strings))
    assert {x.decode(): runs for x, runs in got.items()} == {x: wanted(two, x) for x in strings}


def test_queries_are_asked_in_one_pass(spark, monkeypatch):
    """Before, counts, short prefixes and places were a pass each."""
    fwd = "".join(random.Random(7).choice("ACGT") for _ in range(3000))
    t = text.build(text.contigs(spark.createDataFrame([(0, fwd)], "doc_id long, text string"), encode=False), 511)
    passes, two = [], fwd + rc(fwd)
    for name in ("sides", "matched", "below"):
        monkeypatch.setattr(scan, name, lambda *a, real=getattr(scan, name), **k: (passes.append(1), real(*a, **k))[1])
    reads = [(0, fwd[100:200]), (1, fwd[500:540] + "N" + fwd[541:600]), (2, ""), (3, "N"), (4, None), (5, fwd[100:200])]
    queries = spark.createDataFrame(reads, "qid int, seq string")
    for ask, key in ((lambda: search.forward_spectrum(t, queries), "qid"), (lambda: search.mem_search(t, queries, True), "qid")):
        passes.clear()
        rows = ask().collect()
        assert len(passes) == 1
        for q, seq in reads:
            runs = wanted(two, (seq or "").split("N")[0])
            mine = sorted((r.match_len, r.occ, r.sa_start) for r in rows if r[key] == q)
            if "step_no" in rows[0]:
                assert mine == [(hi, n, at) for _, hi, n, at, _ in runs]
            else:
                assert mine == [(runs[-1][1], runs[-1][2], runs[-1][3]) if runs else (0, 0, 0)]
