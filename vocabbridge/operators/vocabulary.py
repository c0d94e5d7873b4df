"""Vocabularies: counting, ranking, overlap, extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabbridge.operators.rowindex import with_row_index

# Fixed value: tokens seen less often get no vector.
MIN_COUNT = 5
# Added tokens are cut out of texts by one pattern, of at most so many bytes of tokens.
ADDED_BYTES = 8 << 20


def token_counts(df: DataFrame, tokens: Column, min_count: int = 1) -> DataFrame:
    """Occurrences per token; ``tokens`` is an array column of words or ids."""
    # An outer explode: the plain one would add a filter that computes the array again.
    counts = (
        df.select(F.explode_outer(tokens).alias("token"))
        .where(F.col("token").isNotNull())
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return counts.where(F.col("cnt") >= min_count) if min_count > 1 else counts


def build_vocabulary(df: DataFrame, tokens: Column, min_count: int = 1) -> DataFrame:
    """``token_id, token, cnt``: ids by falling count, ties by token."""
    ranked = with_row_index(
        token_counts(df, tokens, min_count), F.desc("cnt"), F.asc("token"), name="token_id"
    )
    return ranked.withColumn("token_id", F.col("token_id").cast("int"))


def check_vocabulary(vocab: DataFrame) -> DataFrame:
    """``token, token_id``; raises if the table is not a vocabulary."""
    if not {"token", "token_id"} <= set(vocab.columns):
        raise ValueError(f"a vocabulary needs token and token_id, found {vocab.columns}")
    return vocab.select(F.col("token").cast("string"), F.col("token_id").cast("int"))


def vocabulary_size(vocab: DataFrame) -> DataFrame:
    """Highest id plus one."""
    return vocab.agg((F.max("token_id") + 1).alias("vocab_size"))


def vocabulary_overlap(target: DataFrame, source: DataFrame) -> DataFrame:
    """``tgt_id, src_id`` of the tokens both vocabularies spell the same way."""
    return target.select("token", F.col("token_id").alias("tgt_id")).join(
        source.select("token", F.col("token_id").alias("src_id")), "token"
    ).select("tgt_id", "src_id")


def overlap_ratio(target: DataFrame, source: DataFrame) -> DataFrame:
    """Overlap size, target vocabulary size and the share in percent."""
    marked = target.select("token").join(
        source.select("token", F.lit(1).alias("shared")), "token", "left"
    )
    n_overlap = F.count("shared")
    n_vocab = F.count(F.lit(1))
    return marked.agg(
        n_overlap.alias("n_overlap"),
        n_vocab.alias("n_vocab"),
        F.try_divide(n_overlap * 100.0, n_vocab).alias("percent"),
    )


def extend_vocabulary(vocab: DataFrame, new_tokens: DataFrame, *order: str) -> DataFrame:
    """Append the tokens of a list that the vocabulary lacks.

    ``new_tokens`` holds ``token`` and the ``order`` columns; a token listed twice
    counts at its first place.  New ids follow the highest old one.
    """
    unseen = new_tokens.join(vocab.select("token"), "token", "left_anti")
    first = unseen.groupBy("token").agg(F.min(F.struct(*order)).alias("_first"))
    added = with_row_index(first, "_first", name="_rank")
    size = vocabulary_size(vocab).scalar()
    return vocab.select("token", F.col("token_id").cast("int"), F.lit(False).alias("added")).unionByName(
        added.select("token", (size + F.col("_rank")).cast("int").alias("token_id"), F.lit(True).alias("added"))
    )


def added_tokens(extended: DataFrame, limit_bytes: int = ADDED_BYTES) -> list[str]:
    """The tokens that :func:`extend_vocabulary` has added, in the order of their ids.

    They become one pattern, so the list is measured first.
    """
    added = extended.where("added").select("token", "token_id")
    size = added.agg(F.sum(F.octet_length("token"))).first()[0] or 0
    if size > limit_bytes:
        raise ValueError(f"{size} bytes of added tokens, more than {limit_bytes}")
    return [row["token"] for row in added.orderBy("token_id").collect()]
