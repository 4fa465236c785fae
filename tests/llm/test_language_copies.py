"""Copies of a text don't thin out the sample that a language's dictionary is made of."""

from __future__ import annotations

from seedlake.llm import language


def test_copies(spark):
    texts = [f"text number {i} of the copied language" for i in range(30)]
    rows = [(t, "aa") for t in texts for _ in range(100)] + [(f"rare {i}", "bb") for i in range(10)]
    known = language.dictionaries(spark.createDataFrame(rows, "text string, lang string"), sample_rows=40)
    assert set(known["aa"].decode().splitlines()) == set(texts) and len(known["bb"].splitlines()) == 10
