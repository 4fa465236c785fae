"""Anchors from a hint, and the queries that asked for ranks of all suffixes, by passes."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from seedlake import catalog
from seedlake.operators import scan, suffix

from test_passes import folder, tiled  # noqa: F401
from test_ranks import anchors
from test_search import below, occ


@pytest.mark.parametrize("few", [True, False])
def test_from_hint(spark, tiled, monkeypatch, few):  # noqa: F811
    index, two, reads = tiled
    order = sorted(range(len(two) + 1), key=lambda i: two[i:])
    rows = anchors(reads)
    frame = spark.createDataFrame(rows, "qid int, seq string, pivot int, anchor int")
    if not few:
        real = scan.few
        monkeypatch.setattr(scan, "few", lambda rows, column, most=scan.FEW: None if most == 1 << 18 else real(rows, column, most))
    at = {r.qid: r.pos for r in index.anchored(frame).collect()}
    longest = {}
    for k, r, pivot, size in rows:
        own = [j for j in range(pivot + 1) if occ(two, r[pivot - j : pivot + size])]
        if own:
            j = max(own)
            longest[k] = j
            assert two[at[k] - j : at[k] + size] == r[pivot - j : pivot + size]
    assert set(at) == set(longest)
    if not few:
        return
    asked = [(*r, order.index(at[r[0]])) for r in rows if r[0] in at] + [(100 + j, *rows[1][1:], j) for j in (1, 2, 400, len(two))] + [(200, *rows[1][1:], 0), (201, *rows[1][1:], len(two) + 1), (202, *rows[1][1:], None)]
    got = Counter(map(tuple, index.backward_spectrum_from_hint(spark.createDataFrame(asked, "qid int, seq string, pivot int, anchor int, hint long")).collect()))
    want = []
    for k, r, pivot, size, hint in asked:
        if not hint or hint > len(two) or pivot + size > len(r):
            continue
        pos = order[hint]
        for j in range(1, pivot + 1):
            if pos < j or two[pos - j] != r[pivot - j]:
                break
            p = two[pos - j : pos + size]
            want.append((k, j - 1, size + j, below(two, p), occ(two, p)))
    assert got == Counter(want)


@pytest.mark.parametrize("name", ["index_backward_from_hint", "index_places"])
def test_queries_rank_few_suffixes(spark, folder, monkeypatch, name):  # noqa: F811
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
