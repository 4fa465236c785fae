"""Runs of N in the flat text."""

from seedlake.operators import text
from seedlake.operators.intervals import merge


def test_whole_runs_of_n_are_not_merged(spark, monkeypatch):
    docs = ["NN" + "ACNGT" * 9 + "N", "NACG", "ACGT" * 20, "ANNA" * 50, "N", "NN", "NAN"]
    flat, met = "".join(docs), []

    def watched(rows, **how):
        met.append(rows.count())
        return merge(rows, **how)

    monkeypatch.setattr(text, "merge", watched)
    contigs = text.contigs(spark.createDataFrame([*enumerate(docs)], "doc_id long, text string"), encode=False)
    places = [i for i, x in enumerate(flat) if x == "N"]
    got = sorted(map(tuple, text.n_runs(contigs).collect()))
    assert [i for a, b in got for i in range(a, b)] == places and all(a[1] < b[0] for a, b in zip(got, got[1:]))
    assert met and met[0] <= 2 * len(docs)
