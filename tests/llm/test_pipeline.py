"""The pipeline on a small table with planted cases; a stage at a time and as a whole."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F


def sentence(rnd, n=12):
    return " ".join(rnd.choice(["the", "of", "and", "that"]) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n)) + "."


def test_pipeline(spark, tmp_path):
    rnd = random.Random(7)
    clean = ["\n".join(sentence(rnd) for _ in range(14)) for _ in range(30)]
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(clean)]
    near = clean[0].split(" ")
    near[5] = "changed"
    junk, secret = "%%% ".join(clean[3].split(" ")), clean[4] + '\npassword = "hunter22x"'
    rows += [(100, clean[1], "en", "src", 0), (101, " ".join(near), "en", "src", 0), (102, junk, "en", "src", 0), (103, None, None, None, None), (104, secret.replace(clean[4][:40], "q" * 9), "en", "src", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert set(docs.columns) == set(corpus_pipeline.COLUMNS)
            assert docs.where(F.col("n_chars") != F.length("text")).where("doc_id < 100").count() == 0
    ids = {n: {r.doc_id for r in d.select("doc_id").distinct().collect()} for n, d in seen.items()}
    assert ids["quality_rules"] == {*range(30), 100, 101, 104}
    assert set(range(30)) <= ids["packing"] and not ids["near_dedup"] & {100, 102, 103}
    assert seen["secret_scan"].where("text like '%hunter22x%'").count() == 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, seen["packing"].select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert corpus_pipeline.ORACLE_SQL is None
