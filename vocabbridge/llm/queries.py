"""The operators as queries over the given tables, and SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabbridge.llm import (
    bpe, centroids, dedup, langid, mixing, mtree, near, packing, quality, secrets, sharding, spelling, unigram,
)

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts over all documents; the largest id of each stays."""
    return dedup.duplicate_report(_documents(spark, folder))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes; equal texts share a shard."""
    placed = sharding.assign_shards(_documents(spark, folder), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every text, learned from the labels that are not held out."""
    return langid.identify(_documents(spark, folder))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The words that a mix of all sources at weights 1, 2, 3 takes from each document."""
    return mixing.mix(_documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram-model token counts of every text."""
    return unigram.count_tokens(_documents(spark, folder), tokenizer_path(PIECES))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded with a byte-level BPE vocabulary and decoded again, as digests."""
    return bpe.round_trip(_documents(spark, folder), tokenizer_path(BYTE_BPE))


def op7_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 highest inner products for every twentieth vector, over all other vectors."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return mtree.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Importance weights of all documents and which of them are drawn."""
    return quality.judge(_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of near-duplicate documents; the smallest id of each stays."""
    return near.near_classes(_documents(spark, folder))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every text: fixed patterns and lexed assignments."""
    return secrets.scan(_documents(spark, folder))


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents' ids in windows of at most 1,024 tokens, as pieces with their place."""
    pieces = packing.pack(_documents(spark, folder), tokenizer_path(BYTE_BPE))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Forty centroids over all vectors after five rounds, and each vector's nearest."""
    return centroids.cluster(spark.read.parquet(f"{folder}/embeddings.parquet"), k=40, rounds=5, dims=64)


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """The spelling variants among the words of all documents, with their forms and roots."""
    return spelling.spelling_variants(_documents(spark, folder))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the document pipeline."""
    return corpus_pipeline.run(spark, folder)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sharding": op2_sharding,
    "op3_token_counts": op3_token_counts,
    "op4_bpe": op4_bpe,
    "op5_language": op5_language,
    "op6_mixing": op6_mixing,
    "op7_top_k": op7_top_k,
    "op8_quality": op8_quality,
    "op9_near_dedup": op9_near_dedup,
    "op10_secrets": op10_secrets,
    "op11_packing": op11_packing,
    "op12_centroids": op12_centroids,
    "op13_spelling": op13_spelling,
    "pipeline": pipeline,
}

# Lower-cases A-Z only, as the operator does.
_NORM = f"translate(coalesce(text, ''), '{dedup.UPPER}', '{dedup.LOWER}')"


def _centroid_rounds(rounds: int) -> str:
    """Steps of assignment and floor of the mean, as SQL.  Vectors here are all usable."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
            SELECT vec_id, c AS cluster, distance FROM (
                SELECT e.vec_id, k.c, sum((e.x - k.x) * (e.x - k.x))::BIGINT AS distance
                FROM e JOIN c{n} k USING (d) GROUP BY e.vec_id, k.c)
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
            SELECT k.c, k.d, coalesce(m.x, k.x) AS x FROM c{n} k LEFT JOIN (
                SELECT cluster AS c, d, floor(sum(x) / count(*))::BIGINT AS x
                FROM a{n} JOIN e USING (vec_id) GROUP BY cluster, d) m USING (c, d))""")
    return ",".join(steps)


SQL = {
    "op1_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_NORM} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id IS NULL) AS kept,
               sha256(norm) AS text_sha256
        FROM n JOIN g USING (norm)
    """,
    # Vectors here have no null or non-finite components.
    "op7_top_k": """
        WITH v AS (
            SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ),
        r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
            FROM s
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op12_centroids": f"""
        WITH e AS MATERIALIZED (
            SELECT vec_id, generate_subscripts(embedding, 1) AS d,
                floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM embeddings),
        s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM embeddings),
        c0 AS MATERIALIZED (SELECT c, d, x FROM s JOIN e USING (vec_id) WHERE c < 40),
        {_centroid_rounds(5)},
        h AS (SELECT c AS cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c5 GROUP BY c)
        SELECT vec_id, cluster::INTEGER AS cluster, distance,
            (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
            (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a5 JOIN h USING (cluster)
    """,
}
