"""The queries opN_<name> over the test tables, and SQL with the same results where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, fingerprint, html, language, licenses, lines, near, oracle, packing, quality, secrets, turns, warc
from .common import documents, shared_folder


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), width=2, percent=80)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(documents(spark, sf_dir, "doc_id", "text"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_digests(documents(spark, sf_dir, "doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir, "doc_id", "text"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir, "doc_id", "text"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", "n_chars")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = clusters.clusters(vectors, "vec_id", "embedding", k=8, rounds=10, dims=64, scale=1024, salt="3:")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive is written to the shared folder; what is returned comes from its records as they are read again."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    warc.write(pages, path, "page_id", "url", "html", least=0)
    size, kind = F.octet_length("payload").cast("long").alias("payload_bytes"), pages.schema["page_id"].dataType
    return warc.read(spark, path).select(F.col("key").alias("page_id"), size, "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), gone=F.col("gone"))


OPERATORS = (
    op1_byte_bpe, op2_minhash_near_dedup, op3_language_id, op4_secret_scan, op5_fingerprints,
    op6_line_dedup, op7_best_fit_packing, op8_quality_rules, op9_license_scan, op10_html_extraction,
    op11_centroid_clusters, op12_warc_archive, op13_conversation_repair,
)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


# ---- those columns of the operators' results that SQL can express; each query runs its operator, as far as they need it, and keeps them


def base2_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes stand in the operator's sketches, before any link is looked for."""
    return near.sketches(documents(spark, sf_dir, "doc_id", "text"), width=2).select("doc_id", "n_shingles")


def base4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base5_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def base8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "base_labels")


BASES = (base2_shingles, base4_secrets, base5_edits, base8_quality, base9_licenses)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*OPERATORS, pipeline, *BASES)}


def oracle_sql() -> dict[str, str]:
    spaces = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]+"
    small = f"translate(coalesce(text, ''), '{licenses.CAPITALS}', '{licenses.SMALL}')"
    assign = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)".replace("'", "''")
    found = lambda pattern, group, least: f"len(list_filter(regexp_extract_all(coalesce(text, ''), '{pattern}', {group}), lambda x: length(x) >= {least}))"
    phrases = [(label, "".join(f" {w} " for w in phrase.split())) for label, phrase in licenses.PHRASES]
    times = {label: f"(length(s) - length(replace(s, '{p}', ''))) // {len(p)}" for label, p in phrases}
    return {
        "op11_centroid_clusters": oracle.centroid_clusters(),
        "op12_warc_archive": oracle.warc_archive(),
        "op13_conversation_repair": oracle.conversation_repair(),
        "base2_shingles": f"SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) = 1 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END::BIGINT AS n_shingles FROM (SELECT doc_id, regexp_extract_all({small}, '{word}') AS w FROM documents)",
        "base4_secrets": f"SELECT doc_id, {found(assign, 2, 6)} AS n_assign, {found('AKIA[A-Z0-9]+', 0, 20)} AS n_access, {found('[0-9a-f]+', 0, 24)} AS n_hex FROM documents",
        "base5_edits": "SELECT doc_id, n AS n_chars, sha256(left(t, n - n // 4) || left(after, n // 4)) AS edited_sha256 FROM (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS after FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))",
        "base8_quality": f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents), g AS (SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g, i FROM d, range(1, 100000) r(i) WHERE i + 2 <= len(w)), c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g), p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, range(0, 3) r(k) WHERE n > 1 GROUP BY doc_id), l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{word}') GROUP BY doc_id), x AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{spaces}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)) SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x",
        "base9_licenses": f"SELECT doc_id, len(w) AS n_words, ({' + '.join(times.values())})::BIGINT AS n_base, array_to_string(list_filter([{', '.join(f'CASE WHEN {x} > 0 THEN {chr(39)}{label}{chr(39)} END' for label, x in sorted(times.items()))}], lambda x: x IS NOT NULL), ',') AS base_labels FROM (SELECT doc_id, w, coalesce(array_to_string(list_transform(w, lambda x: ' ' || x || ' '), ''), '') AS s FROM (SELECT doc_id, regexp_extract_all({small}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents))",
    }
