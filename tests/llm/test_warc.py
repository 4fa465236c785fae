"""The WARC archive: which record keeps its payload, exact headers, round trips through the tables and through WARC files."""

from __future__ import annotations

import base64
import hashlib
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seedlake.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, part int, payload string"
LONG = "<p>" + "ä long page \r\n\r\nWARC/1.1\r\n" * 40_000
ROWS = [
    (5, "http://b/", "<p>one</p>"), (3, "http://a/", "<p>one</p>"), (9, None, "<p>one</p>"), (None, "http://c/", "<p>one</p>"),
    (1, "http://d/x y\n", "naïve ☃"), (2, "http://e/", None), (4, "http://f/", ""), (6, "http://g/", LONG), (7, "http://h/", LONG),
    (8, "http://i/", "twice"), (8, "http://i/", "twice"), (8, "http://i/", "twice"), (8, "http://j/", "twice"),
]


def sha1(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def wanted(rows, least=0):
    out, first = [], {}
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    for key, url, html in sorted(rows, key=order):
        b = (html or "").encode()
        revisit = b in first and len(b) >= least
        out.append((key, url, "revisit" if revisit else "response", str(first[b]) if revisit else None, sha1(b), b))
        first.setdefault(b, key)
    return sorted(out, key=str)


def archive(spark, path, rows=ROWS, **more):
    warc.write(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3), path, "page_id", "url", "html", **more)
    return warc.read(spark, path)


def rows_of(found):
    return sorted(((r.key, r.uri, r.record_type, r.refers_to, r.payload_digest, bytes(r.payload)) for r in found.collect()), key=str)


@pytest.mark.parametrize(("least", "share"), [(0, 4096), (8, 2)])
def test_round_trip(spark, tmp_path, monkeypatch, least, share):
    monkeypatch.setattr(warc, "SHARE", share)
    assert rows_of(archive(spark, f"{tmp_path}/a", least=least)) == wanted(ROWS, least)
    store = spark.read.parquet(f"{tmp_path}/a/payloads")
    assert store.count() == store.select("digest").distinct().count() == len({h or "" for _, _, h in ROWS})
    heads = [bytes(r.head).decode() for r in spark.read.parquet(f"{tmp_path}/a/records").collect()]
    ids = [re.search("WARC-Record-ID: (.*)\r\n", h)[1] for h in heads]
    assert len(set(ids)) == len(ROWS) and {re.search("WARC-Refers-To: (.*)\r\n", h)[1] for h in heads if "revisit" in h} <= set(ids)


def test_warc_files(spark, tmp_path):
    """The files parse by their lengths alone, whatever stands in a payload."""
    archive(spark, f"{tmp_path}/a")
    warc.export(spark, f"{tmp_path}/a", f"{tmp_path}/w")
    found = []
    for f in Path(tmp_path, "w").glob("part-*"):
        data, at = f.read_bytes(), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            fields = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
            assert data[at:].startswith(b"WARC/1.1\r\n")
            block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
            at = end + 8 + len(block)
            assert data[at - 4 : at] == b"\r\n\r\n"
            http, body = block.split(b"\r\n\r\n", 1)
            found.append((fields["WARC-Type"], fields["WARC-Payload-Digest"], body))
            assert fields["WARC-Type"] == "revisit" or int(re.search(rb"Content-Length: (\d+)", http)[1]) == len(body)
    want = [(kind, f"sha1:{digest}", body if kind == "response" else b"") for *_, kind, _, digest, body in wanted(ROWS)]
    assert sorted(found) == sorted(want)


def test_empty_and_damaged(spark, tmp_path):
    assert rows_of(archive(spark, f"{tmp_path}/none", [])) == []
    archive(spark, f"{tmp_path}/a")
    store = spark.read.parquet(f"{tmp_path}/a/payloads")
    other = bytes(store.where("size = 5").first().pack)  # another payload's bytes under a digest
    store.withColumn("pack", F.when(F.col("size") == 10, F.lit(other)).otherwise(F.col("pack"))).write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/records").write.parquet(f"{tmp_path}/b/records")
    with pytest.raises(Exception, match="doesn't have its digest"):
        warc.read(spark, f"{tmp_path}/b").collect()
