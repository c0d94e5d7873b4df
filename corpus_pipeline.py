"""The document pipeline: quality, exact and near duplicates, mixing, encoding.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is
written and read again for the next one.  All but the last return the columns of the
documents; the last one returns the digests of ids and decoded texts.
"""

from __future__ import annotations

from functools import wraps

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from vocabbridge.llm import bpe, dedup, mixing, near, quality
from vocabbridge.storage import stored

VOCABULARY = "byte_bpe_50k.json"
# Bytes of a batch on its way to a Python worker.  Texts differ in length by factors of
# thousands, so the usual bound on rows says little about memory.
BATCH_BYTES = "8m"


def bounded(stage):
    """The stage with batches of bounded bytes."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that importance resampling draws."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@bounded
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of equal texts, the one with the largest id."""
    return dedup.drop_duplicates(docs)


@bounded
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates, the one with the smallest id."""
    return near.drop_near_duplicates(docs)


@bounded
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents as the mix of sources takes their words."""
    return mixing.repeat_documents(docs)


@bounded
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text, decode its ids, and return the digests of both."""
    return bpe.round_trip(docs, tokenizer_path(VOCABULARY))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

# Shingle signatures, draws and merges are not expressible in SQL; tests compare the
# stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
