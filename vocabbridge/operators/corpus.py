"""Corpus preparation: cleaning, token budget, splits and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabbridge.functions.text import strip
from vocabbridge.operators.rowindex import head_rows, row_count, running_before, with_batch

# The workload's defaults.
MIN_CHARS = 50
BATCH_ROWS = 1000
VALIDATION_PERCENT = 5


def mark_rows(df: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Strip the text and add ``fate``: ``kept``, ``empty`` or ``short``."""
    length = F.length(text)
    fate = F.when(length == 0, "empty").when(length < min_chars, "short").otherwise("kept")
    return df.withColumn(text, strip(F.col(text))).withColumn("fate", fate)


def keep_rows(df: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Stripped rows of at least ``min_chars`` characters (and at least one)."""
    stripped = df.withColumn(text, strip(F.col(text)))
    return stripped.where(F.length(text) >= max(min_chars, 1))


def batch_totals(marked: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Per batch of raw rows: rows kept and skipped, tokens, and tokens of all batches before.

    ``marked`` holds ``row_idx``, ``fate`` and ``n_tokens``.
    """
    totals = (
        with_batch(marked, batch_rows)
        .groupBy("batch")
        .agg(
            F.count_if(F.col("fate") == "kept").alias("kept"),
            F.count_if(F.col("fate") == "empty").alias("skipped_empty"),
            F.count_if(F.col("fate") == "short").alias("skipped_short"),
            F.coalesce(
                F.sum(F.when(F.col("fate") == "kept", F.col("n_tokens"))), F.lit(0)
            ).alias("tokens"),
        )
    )
    return running_before(totals, "batch", "tokens", "tokens_before")


def within_budget(
    marked: DataFrame, target: int, batch_rows: int = BATCH_ROWS
) -> DataFrame:
    """Rows of the batches up to the one that reaches ``target`` tokens.

    Whole batches are taken in order, so the last one may overshoot; the first is
    always taken.  Running totals never fall, so the taken batches are a prefix and
    one scalar says where it ends.
    """
    totals = batch_totals(marked, batch_rows)
    last = totals.where((F.col("batch") == 0) | (F.col("tokens_before") < target)).agg(
        F.max("batch").alias("last")
    )
    return with_batch(marked, batch_rows).where(F.col("batch") <= last.scalar())


def corpus_statistics(rows: DataFrame) -> DataFrame:
    """Kept rows, tokens, and rows skipped as empty or short."""
    kept = F.col("fate") == "kept"
    return rows.agg(
        F.count_if(kept).alias("kept"),
        F.coalesce(F.sum(F.when(kept, F.col("n_tokens"))), F.lit(0)).alias("tokens"),
        F.count_if(F.col("fate") == "empty").alias("skipped_empty"),
        F.count_if(F.col("fate") == "short").alias("skipped_short"),
    )


def head_split(df: DataFrame, percent: int = VALIDATION_PERCENT) -> DataFrame:
    """First ``percent`` of the rows are ``validation``, the rest ``train``.

    The cut is rounded to the nearest row, halves to even.  ``split_idx`` is the
    place of the row inside its split.
    """
    cut = F.bround(row_count(df) * F.lit(float(percent)) / 100.0).cast("bigint")
    framed = df.withColumn("_cut", cut)
    held_out = F.col("row_idx") < F.col("_cut")
    return (
        framed.withColumn("split", F.when(held_out, "validation").otherwise("train"))
        .withColumn(
            "split_idx",
            F.when(held_out, F.col("row_idx")).otherwise(F.col("row_idx") - F.col("_cut")),
        )
        .drop("_cut")
    )


def given_split(train: DataFrame, validation: DataFrame) -> DataFrame:
    """Both tables, numbered each, as the splits of one corpus; validation rows come first."""
    before = row_count(validation)
    head = validation.select("*", F.lit("validation").alias("split"), F.col("row_idx").alias("split_idx"))
    rest = train.select("*", F.lit("train").alias("split"), F.col("row_idx").alias("split_idx"))
    return head.unionByName(rest.withColumn("row_idx", F.col("row_idx") + before))


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows per split."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


def evaluation_split(splits: list[str]) -> str:
    """``test`` if there is one, else ``validation``."""
    return "test" if "test" in splits else "validation"


def chars_per_token(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Characters per token; 1 for a corpus without text.

    All rows count, or the first ``rows`` if given; ``df`` holds ``row_idx``, ``text``
    and ``n_tokens``.
    """
    head = df if rows is None else head_rows(df, rows)
    if "text" not in df.columns:
        return head.agg(F.lit(1.0).alias("chars_per_token"))
    return head.agg(
        F.try_divide(F.sum(F.length("text")), F.sum("n_tokens")).alias("chars_per_token")
    )
