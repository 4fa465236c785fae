"""Language identification by compression: a text belongs to the language whose dictionary compresses it best.

Each language has a raw-content zstandard dictionary of at most `dictionary_bytes`, made of segments of labelled training
texts. A text is encoded with every dictionary; the smallest encoding wins, and where the second is close the prediction is
marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, utf8

LEVEL, BLOCK, SEGMENT = 7, 4096, 600
#: A count for each of so many languages may be broadcast.
FEW_LANGUAGES = 50_000
LETTER = re.compile(r"[^\W\d_]")


def fold(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds. A null id is in fold 1, so it is used to learn."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds, F.lit(1))


def dictionaries(docs: DataFrame, dictionary_bytes: int = 48_000, sample_rows: int = 400) -> dict[str, bytes]:
    """A dictionary for each lang of docs (text, lang; rows without either are left out).

    The sample is bounded: about `sample_rows` distinct texts of a language, all where it has fewer, taken by their hash however
    often each is copied, and of their segments as many as fill `dictionary_bytes`. Only those reach the driver.
    """
    rows = docs.where("lang is not null and text is not null and trim(text) <> ''").select("lang", "text")
    counts = durable(rows.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").agg(F.count("*").alias("n")))
    if counts.count() <= FEW_LANGUAGES:  # else texts would be dealt by language, a few keys
        counts = F.broadcast(counts)
    span = 1 << 40
    picked = rows.join(counts, "lang").where(F.pmod(F.xxhash64("text"), F.lit(span)) < F.lit(span) * F.lit(float(sample_rows)) / F.col("n"))
    parts = picked.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))).alias("part")).distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("part", F.lit(1)), "part")
    few = parts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= dictionary_bytes // (SEGMENT // 2))
    out: dict[str, bytes] = {}
    for r in few.orderBy("lang", "k").collect():
        part = r["part"].lower().encode() + b"\n"
        if len(out.get(r["lang"], b"")) + len(part) <= dictionary_bytes:
            out[r["lang"]] = out.get(r["lang"], b"") + part
    return out


@lru_cache(maxsize=4)
def compressors(pairs: tuple[tuple[str, bytes], ...]):
    import zstandard as z

    made = []
    for _, data in pairs:
        d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def predict(docs: DataFrame, known: dict[str, bytes], margin: float = 0.01, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected.

    The whole text is encoded, in blocks of `BLOCK` characters so that the dictionary counts everywhere in a long text; only
    the text is looked at. score is the share by which the best size is under the second (0 to 1; with one language 1),
    rejected: that share is under `margin`. A null text, one without letters, or no known language: `und`, 0, true.
    """
    pairs = tuple(sorted(known.items()))
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "rejected")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors(pairs)
        for b in batches:
            out, seen = [], {}
            for t in utf8(b.column(text)):
                if t not in seen:
                    s = t.decode().lower()
                    if not tools or not LETTER.search(s):
                        seen[t] = ("und", 0.0, True)
                    else:
                        blocks = [s[k : k + BLOCK].encode() for k in range(0, len(s), BLOCK)]
                        sizes = sorted((sum(len(c.compress(x)) for x in blocks), lang) for c, (lang, _) in zip(tools, pairs))
                        score = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
                        seen[t] = (sizes[0][1], score, score < margin)
                out.append(seen[t])
            arrays = [b.column(f.name) for f in kept] + [pa.array(x, t) for x, t in zip(zip(*out) if out else ([], [], []), (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in kept] + ["lang_pred", "score", "rejected"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string, score double, rejected boolean"])
    return docs.mapInArrow(step, schema)


def language_id(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score, rejected; learned outside fold 0."""
    known = dictionaries(docs.where(fold("doc_id", folds) != 0))
    rows = docs.select("doc_id", "text", (fold("doc_id", folds) == 0).alias("held_out"))
    return predict(rows, known).select("doc_id", "held_out", "lang_pred", "score", "rejected")
