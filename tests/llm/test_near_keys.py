"""Near-dedup of rows without a doc_id and of doc_ids that stand for several texts."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline

from seedlake.llm import near

BASE = [[f"{letter}{i}" for i in range(200)] for letter in "uvw"]
A, B, C = (" ".join(x) for x in BASE)
B2, C2 = (" ".join(["new", *x[1:]]) for x in BASE[1:])
ROWS = [(None, A), (None, "alone and clean"), (None, None), (0, A), (1, B), (1, C), (5, B2), (6, C2), (7, B), (20, A)]
GONE = {(5, B2), (6, C2), (7, B), (20, A)}


def test_null_and_repeated_ids(spark):
    got = near.near_duplicates(spark.createDataFrame(ROWS, "doc_id long, text string"), 2, 80).collect()
    want = [*[(None, None, True)] * 3, (0, 0, True), (1, 1, True), (1, 1, True), (5, 1, False), (6, 1, False), (7, 1, False), (20, 0, False)]
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter(want)


def test_shared_id_in_two_groups(spark):
    rows = [(0, A), (1, B), (1, A), (2, B2)]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter([(0, 0, True), (1, 1, True), (1, 0, False), (2, 1, False)])


def test_pipeline_stage(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in [*ROWS, (1, A)]], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == Counter(r for r in ROWS if r not in GONE)
