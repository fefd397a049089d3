"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Toxic documents go, one document of each group of near copies stays, documents that hold a test item go, secrets are
masked in the text, and the last stage gives token counts and digests of what is left. Rows with a null doc_id pass the
filtering stages unless their text is toxic.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, near_dup, secret_scan, sentencepiece_codec, toxicity
from tessera.llm.common import shared_dir, table
from tessera.llm.queries import guess_words, piece_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; n_chars of a changed text is its new length."""
    before = f"before_{uuid.uuid4().hex}"  # clashes with no column of docs
    masked = secret_scan.redact(docs.withColumn(before, F.col("text")), guess_words())
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        masked = masked.withColumn("n_chars", F.when(F.col("text").eqNullSafe(F.col(before)), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return masked.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(docs, piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("secrets", mask_secrets),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/tessera-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
