"""A content-addressed WARC archive: payloads once each by SHA-256, record headers as they are, records put together by a join.

write() makes two tables under a folder. payloads(digest, size, copies, first, pack): the bytes of each distinct payload, compressed in
the task that read them, before anything is dealt. records(key, uri, digest, copies, head): the exact bytes of each record's WARC and
HTTP headers. read() joins them again and checks every payload against its digest; export() writes the records as WARC files.

A record whose payload others have too is a `revisit` of the one with the smallest key (then uri), as WARC 1.1's profile for identical
payloads has it, if the payload has at least `least` bytes. Copies of one payload, however many, are merged before they are dealt; when
records meet payloads, one that many share is there once for every SHARE of its records, so that none gathers in a task.

Results in special cases: a null payload is an empty one; null keys and uris come last, and have an empty id and no target line; of
records that are equal in all (repeated rows) the first is the response, the others revisit it; a uri with blanks or control characters
is percent-coded in its header line and kept as it is in the table; a long payload is held whole by its task; an empty table gives empty tables.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records that meet one copy of a payload.
SHARE = 4096
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# The digits of base 32 as Spark's conv() has them, and as RFC 4648 has them.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: five hex digits are four digits of it."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substr(hexed, F.lit(i), F.lit(5)), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def packed(rows: DataFrame) -> DataFrame:
    """rows with their last column, `payload`, compressed as `pack`."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            pack = pa.array([tool.compress(x) for x in b["payload"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pack], names=[*b.schema.names[:-1], "pack"])

    kept = rows.schema.fields[:-1]
    return rows.mapInArrow(step, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["pack binary"]))


def unpacked(rows: DataFrame) -> DataFrame:
    """rows with their last column, `pack`, as the `payload` it was."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(0, b.num_rows, 256):  # payloads are larger than packs
                part = b.slice(i, 256)
                payload = pa.array([tool.decompress(x) for x in part["pack"].to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], payload], names=[*b.schema.names[:-1], "payload"])

    kept = rows.schema.fields[:-1]
    return rows.mapInArrow(step, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["payload binary"]))


def record_id(key: Column, uri: Column, digest: Column, copy: Column) -> Column:
    """<urn:x-record:key:hash>: the key can be read off it, the hash tells records with one key apart."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.concat(F.lit("<urn:x-record:"), F.url_encode(text), F.lit(":"), F.md5(F.to_json(F.struct(text.alias("key"), uri.alias("uri"), digest.alias("digest"), copy.alias("copy")))), F.lit(">"))


def write(rows: DataFrame, path: str, key: str, uri: str, payload: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """The archive of rows (key, uri, payload), every record with the date given."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    given = rows.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), body.alias("payload"))
    given = given.select("key", "uri", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"), "payload")
    order = F.struct(F.col("key").isNull().alias("no_key"), "key", F.col("uri").isNull().alias("no_uri"), "uri")
    contents = packed(given.select("digest", "size", F.xxhash64("payload").alias("check"), order.alias("first"), "payload")).groupBy("digest")
    contents = contents.agg(F.min("size").alias("size"), F.max("size").alias("most"), F.min("check").alias("a"), F.max("check").alias("b"), F.count("*").alias("copies"), F.min("first").alias("first"), F.first("pack").alias("pack"))
    same = (F.col("size") == F.col("most")) & (F.col("a") == F.col("b"))
    digest = F.when(same, F.col("digest")).otherwise(F.raise_error(F.lit("two payloads have one SHA-256")))
    contents.select(digest.alias("digest"), "size", "copies", "first", "pack").write.parquet(f"{path}/payloads", compression="zstd")
    store = rows.sparkSession.read.parquet(f"{path}/payloads")

    # equal rows are counted, then told apart by a number, so that just one of them can be the response
    ids = given.select("key", "uri", "digest", "size", base32_sha1(F.col("payload")).alias("sha1")).groupBy("key", "uri", "digest", "size", "sha1").agg(F.count("*").alias("n"))
    ids = ids.select("key", "uri", "digest", "size", "sha1", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    shared = store.where("copies > 1").select("digest", "copies", "first")
    met = ids.join(shared, "digest", "left").select(*ids.columns, F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "first")
    is_first = (F.col("copies") == 1) | (F.col("copy") == 1) & F.col("key").eqNullSafe(F.col("first.key")) & F.col("uri").eqNullSafe(F.col("first.uri"))
    revisit = ~is_first & (F.col("size") >= least)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END + END))
    safe = lambda x: F.when(x.rlike(r"[\x00-\x20\x7F]"), F.url_encode(x)).otherwise(x)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    maybe = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    target = record_id(F.col("first.key"), F.col("first.uri"), F.col("digest"), F.lit(1).cast("long"))
    more = F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", target), maybe("WARC-Refers-To-Target-URI", safe(F.col("first.uri"))))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", record_id(F.col("key"), F.col("uri"), F.col("digest"), F.col("copy"))),
        line("WARC-Date", F.lit(date)), maybe("WARC-Target-URI", safe(F.col("uri"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), F.when(revisit, more).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", size.cast("string")), F.lit(END), http,
    )
    met.select("key", "uri", "digest", "copies", head.cast("binary").alias("head")).write.parquet(f"{path}/records", compression="zstd")


def field(name: str) -> Column:
    """A field of a record's WARC header, null where it has none. The header ends before the first empty line."""
    return F.nullif(F.regexp_extract(F.substring_index(F.col("head").cast("string"), END + END, 1), rf"\r\n{name}: ([^\r]*)", 1), F.lit(""))


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, uri, record_type, refers_to (the key in the id of the record it refers to, as text), payload_digest (as the header has it), head, payload
    (whole, for revisits too) of the archive's records. A payload that doesn't have its digest is an error."""
    parts = F.greatest(F.ceil(F.col("copies") / SHARE), F.lit(1)).cast("long")
    store = spark.read.parquet(f"{path}/payloads")
    store = store.select("digest", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "pack")
    records = spark.read.parquet(f"{path}/records").withColumn("part", F.pmod(F.xxhash64("head"), parts))
    rows = unpacked(records.join(store, ["digest", "part"]).select("key", "uri", "digest", "head", "pack"))
    digest = F.substring_index(field("WARC-Payload-Digest"), ":", -1)
    right = (F.sha2("payload", 256) == F.col("digest")) & (base32_sha1(F.col("payload")) == digest)
    refers = F.url_decode(F.regexp_extract(field("WARC-Refers-To"), r"^<urn:x-record:([^:]*):[0-9a-f]{32}>$", 1))
    checked = F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("a payload doesn't have its digest")))
    return rows.select("key", "uri", field("WARC-Type").alias("record_type"), F.nullif(refers, F.lit("")).alias("refers_to"), digest.alias("payload_digest"), "head", checked.alias("payload"))


def export(spark: SparkSession, path: str, out: str, compression: str = "none") -> None:
    """The archive's records as WARC files: headers, for responses the payload, and two line ends, which the text writer puts between them."""
    record = F.concat("head", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary")))
    read(spark, path).select(record.cast("string").alias("value")).write.option("lineSep", END + END).text(out, compression=compression)
