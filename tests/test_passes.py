"""Searches of an index without ranks against brute force, and the queries that ask one against their SQL."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from seedlake import catalog
from seedlake.operators import scan, suffix, text
from seedlake.operators.store import durable
from seedlake.plans.index import Index

from test_ranks import anchors, make, wanted_steps
from test_search import below, longest, occ


@pytest.fixture(scope="module")
def tiled(spark):
    fwd, two, reads = make()
    frame = durable(text.contigs(spark.createDataFrame([(0, fwd)], "doc_id long, text string"), encode=False))
    return Index.build(frame, catalog.TILED), two, reads


@pytest.mark.parametrize("few", [True, False])
def test_without_ranks(spark, tiled, monkeypatch, few):
    index, two, reads = tiled
    if not few:
        monkeypatch.setattr(scan, "few", lambda *a: None)
    assert index.ranks is None
    order = sorted(range(len(two) + 1), key=lambda i: two[i:])
    best = [r[: longest(two, r.split("N")[0])] for r in reads]
    hints = [(i, r, below(two, b) + occ(two, b) // 2 if b else None) for i, (r, b) in enumerate(zip(reads, best))] + [(100 + j, reads[1], j) for j in (1, 400, len(two))] + [(200, reads[1], 0), (201, reads[1], len(two) + 1)]
    got = {}
    for r in index.forward_spectrum_from_hint(spark.createDataFrame(hints, "qid int, seq string, hint long")).collect():
        got.setdefault(r.qid, []).append(tuple(r)[1:])
    for k, r, hint in hints:
        held = two[order[hint] :] if hint and hint <= len(two) else r
        n = next((i for i, (x, y) in enumerate(zip(r, held)) if x != y), min(len(r), len(held)))
        assert sorted(got.get(k, [])) == wanted_steps(two, r[:n])
    rows = anchors(reads)
    frame = spark.createDataFrame(rows, "qid int, seq string, pivot int, anchor int")
    steps = Counter(map(tuple, index.backward_spectrum(frame).collect()))
    want = []
    for k, r, pivot, size in rows:
        for j in range(1, pivot + 1):
            p = r[pivot - j : pivot + size]
            if not occ(two, p):
                break
            want.append((k, j - 1, len(p), below(two, p), occ(two, p)))
    assert steps == Counter(want)
    for least in (1, 3):
        cut = spark.createDataFrame([(*r, least) for r in rows], "qid int, seq string, pivot int, anchor int, least_occ int")
        found = {r.qid: tuple(r)[1:] for r in index.backward_truncated(cut).collect()}
        for k, r, pivot, size in rows:
            longer = [j for j in range(1, pivot + 1) if occ(two, r[pivot - j : pivot + size]) >= least]
            p = r[pivot - max(longer, default=0) : pivot + size]
            assert found[k] == ((len(p), below(two, p), occ(two, p)) if occ(two, p) else (size, 0, 0))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("few")
    some = lambda name, by, n: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").orderBy(by).limit(n).toPandas()
    docs, passages = some("documents", "doc_id", 30), some("benchmark", "item_id", 10)
    docs.loc[:4, "text"] = docs.text[:5] + " " + passages.text[:5] + " " + passages.text[2:7].to_numpy()
    docs.to_parquet(f"{path}/documents.parquet")
    passages.to_parquet(f"{path}/benchmark.parquet")
    return str(path)


NAMES = ("index_intervals", "index_mem_search", "index_forward_spectrum", "index_spectrum_from_hint", "index_backward_spectrum", "index_backward_truncated", "index_smems_pass1")


@pytest.mark.parametrize("name", NAMES)
def test_queries_sort_no_suffixes(spark, folder, monkeypatch, name):
    monkeypatch.setattr(suffix, "suffix_array", lambda t: pytest.fail("all suffixes are ranked"))
    made = catalog.queries()[name](spark, folder)
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    order = sorted(made.columns)
    assert order == sorted(want.columns)
    rows = Counter(tuple(r[c] for c in order) for r in made.collect())
    assert rows and rows == Counter(want.project(", ".join(f'"{c}"' for c in order)).fetchall())
