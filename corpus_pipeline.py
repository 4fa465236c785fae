"""The corpus pipeline: quality rules, line dedup, near-dedup, secrets taken out, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is written and read again before the next stage.
All but the last return the columns of documents. Rows keep their doc_id; n_chars follows the text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedlake.llm import lines, near, packing, quality, secrets
from seedlake.llm.common import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def like_documents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The references come from this stage's own input."""
    rows = quality.judged(docs.select(*COLUMNS), quality.references(docs), extra=COLUMNS)
    return rows.where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later places of repeated three-line windows go; a document of which nothing but white space is left goes too."""
    return like_documents(lines.dedup_lines(docs.select(*COLUMNS)).where("trim(text) <> ''"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8): the one with the smallest doc_id. Rows without a doc_id stay."""
    kept = near.near_duplicates(docs.select("doc_id", "text"), width=5, percent=80, keys=True).where("kept").select(F.col("row").alias("__row"))
    return docs.select(*COLUMNS).withColumn("__row", near.row_key()).join(kept, "__row", "left_semi").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each found secret replaced by its kind."""
    return like_documents(secrets.redact(docs.select(*COLUMNS)))


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packing_plan)]

#: Learned and iterative stages (distances, components, merges) are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; between stages Parquet in the shared folder."""
    top = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{top}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
